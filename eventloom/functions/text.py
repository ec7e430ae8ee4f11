"""Text expressions: all of them stay inside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a redaction replaces, by name (patterns of public secret formats).
SECRETS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ipv4": r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b", "hex_token": r"\b[0-9a-f]{32,}\b"}


def redact(text: Column) -> Column:
    for name, pattern in SECRETS.items():
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def half_up(x: Column) -> Column:
    """Rounds halves toward positive infinity."""
    return F.floor(x + 0.5).cast("long")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; zero for zero vectors and for unequal lengths."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), total(a, b) / norm).otherwise(F.lit(0.0))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('<a href="([^"]+)"'), F.lit(1))
