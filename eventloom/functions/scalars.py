"""Small functions of text, time, numbers, lists, maps and JSON; all are expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What redaction looks for, in its order.
BEARER, JWT = r"(?i)\bBearer\s+[A-Za-z0-9\-._~+/]+=*", r"\beyJ[A-Za-z0-9_-]*\.[A-Za-z0-9._-]+\.[A-Za-z0-9._-]+\b"
ASSIGNED, SECRET = r"(?i)\b([A-Z0-9_]*(?:TOKEN|SECRET|PASSWORD|API_KEY|KEY))\s*[:=]\s*([^\s,;]+)", r"\b(?:sk|pk|rk)_[A-Za-z0-9]{10,}\b"
FORBIDDEN_KEYS = ("apiKey", "password", "secret", "token", "authorization")
BREAKER_NEAR = 0.85


def redacted(text: Column, most: int | None = None) -> Column:
    """Tokens, secrets and absolute paths replaced, white space compacted, cut with an ellipsis (SC5)."""
    out = F.regexp_replace(text, BEARER, "Bearer <redacted-token>")
    out = F.regexp_replace(out, JWT, "<redacted-token>")
    out = F.regexp_replace(out, ASSIGNED, "$1=<redacted-secret>")
    out = F.regexp_replace(out, SECRET, "<redacted-secret>")
    tail = r"""(?:[^\s"'<>/\\]+[/\\])*?([^\s"'<>/\\]+(?:[/\\][^\s"'<>/\\]+)?)(?=[\s"'<>]|$)"""
    one = r"""(?:[^\s"'<>/\\]+[/\\])*([^\s"'<>/\\]+)"""
    out = F.regexp_replace(out, r"(?i)\b[A-Z]:[/\\]Users[/\\][^\s\\/]+[/\\]AppData[/\\]Local[/\\]Temp[/\\]" + tail, "<temp>/$1")
    out = F.regexp_replace(out, r"(?i)(?<![\w<>/])/(?:tmp|private/tmp|var/folders)/" + tail, "<temp>/$1")
    out = F.regexp_replace(out, r"(?i)(?:\b[A-Z]:[/\\]Users[/\\]|(?<![\w<>/])/Users/|(?<![\w<>/])/home/)[^\s/\\\"'<>]+[/\\]" + tail, "<home>/$1")
    out = F.regexp_replace(out, r"\b[A-Za-z]:[/\\]" + one, "<path>/$1")
    out = F.regexp_replace(out, r"(?<![\w<>/])/(?:opt|srv|workspace|app|data)/" + one, "<path>/$1")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"\\", "/"), r"\s+", " "))
    return out if most is None else F.when(F.length(out) > most, F.concat(F.substring(out, 1, most - 1), F.lit("…"))).otherwise(out)


def base_name(path: Column) -> Column:
    """The last part of a path, in lower case (SC2)."""
    return F.lower(F.regexp_extract(F.regexp_replace(path, r"\\", "/"), "([^/]*)/*$", 1))


def class_name(label: Column) -> Column:
    """What stands before the bracket, after the last dot, as plain words (SC7)."""
    head = F.trim(F.regexp_extract(label, r"^([^(]*)", 1))
    return F.trim(F.regexp_replace(F.lower(F.regexp_extract(head, r"([^.]*)$", 1)), "[^a-z0-9]+", " "))


def namespace_tail(label: Column) -> Column:
    """The words of a namespace's label; null for others (SC7)."""
    return F.when(F.lower(label).contains("(namespace)"), F.trim(F.regexp_replace(F.lower(F.regexp_extract(label, r"^([^(]*)", 1)), "[^a-z0-9]+", " ")))


def imports(text: Column) -> Column:
    """Module names of import, export-from, dynamic import and require, in order of kind (SC12)."""
    q = r"""["']([^"']+)["']"""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (rf"""\bimport\s+(?:[^"';]+?\s+from\s+)?{q}""", rf"""\bexport\s+[^"';]+?\s+from\s+{q}""", rf"\bimport\(\s*{q}\s*\)", rf"\brequire\(\s*{q}\s*\)")]
    return F.array_distinct(F.concat(*found))


def evidence_path(path: Column) -> Column:
    """A relative path as it is; of an absolute one the name alone (SC13)."""
    normal = F.regexp_replace(path, r"\\", "/")
    return F.when(normal.rlike(r"^(/|[A-Za-z]:/)"), F.regexp_extract(normal, r"([^/]*)$", 1)).otherwise(normal)


def is_test_command(label: Column) -> Column:
    return label.rlike(r"(?i)\b(test|vitest|jest|playwright|pytest|phpunit)\b")


def retrieval_id(prefix: str, kind: Column, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), kind, *parts)


def retrieval_parts(prefix: str, id: Column, kinds: tuple[str, ...] = ("node", "community", "doc", "path", "benchmark")) -> tuple[Column, Column, Column]:
    """kind, first and second part of a retrieval id; null for what is none. A path has two parts (SC14)."""
    kind, rest = F.regexp_extract(id, rf"^{prefix}:([a-z]+):(.+)$", 1), F.regexp_extract(id, rf"^{prefix}:([a-z]+):(.+)$", 2)
    ok = kind.isin(*kinds)
    two = (kind == "path") & rest.contains(":")
    return F.when(ok, kind), F.when(ok, F.when(two, F.regexp_extract(rest, "^([^:]*):", 1)).otherwise(rest)), F.when(ok & two, F.regexp_extract(rest, "^[^:]*:(.*)$", 1))


def parsed_time(text: Column) -> Column:
    """A timestamp, or null for text that is none (SC16)."""
    return F.try_to_timestamp(text)


def age_days(now: Column, then: Column) -> Column:
    """Whole days between two times (SC17)."""
    return F.floor((F.unix_millis(now) - F.unix_millis(then)) / 86_400_000).cast("long")


def is_stale(made: Column, graph: Column) -> Column:
    """A report that is missing, or older than the graph; unreadable times don't count (SC18)."""
    a, b = parsed_time(made), parsed_time(graph)
    return F.when(made.isNull() | (made == ""), True).when(a.isNull() | b.isNull(), False).otherwise(a < b)


def unix_nanos(time: Column) -> Column:
    """Nanoseconds since 1970 as text (SC19)."""
    return (F.unix_micros(time) * 1000).cast("string")


def clamped(score: Column) -> Column:
    """A whole score between 0 and 100, halves upwards (SC21)."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(score + 0.5))).cast("long")


def breaker(observed: Column, limit: Column) -> Column:
    """hit at the limit, near from 85 %, else ok (SC23)."""
    return F.when(observed >= limit, "hit").when((limit > 0) & (observed / limit >= BREAKER_NEAR), "near").otherwise("ok")


def scan_rates(files: Column, size: Column, seconds: Column, most: Column) -> Column:
    """Files and megabytes a second, and milliseconds until the limit is reached; null for no speed (SC24)."""
    s = F.greatest(seconds, F.lit(0.001))
    speed = files / s
    return F.struct(F.round(speed, 2).alias("files"), F.round(size / (1024 * 1024) / s, 2).alias("megabytes"), F.when(speed > 0, F.floor(F.greatest(most - files, F.lit(0)) / speed * 1000 + 0.5).cast("long")).alias("eta_ms"))


def listed(values: Column, most: int = 480) -> Column:
    """Distinct values in order, comma-joined, cut (SC25)."""
    return F.substring(F.array_join(F.array_sort(F.array_distinct(values)), ", "), 1, most)


def bounded(text: Column, most: int = 240) -> Column:
    """White space compacted, cut with three dots; null for nothing (SC26)."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(out == "", None).when(F.length(out) > most, F.concat(F.rtrim(F.substring(out, 1, most - 3)), F.lit("..."))).otherwise(out)


def compact(m: Column) -> Column:
    """A map without null values (SC27)."""
    return F.map_filter(m, lambda k, v: v.isNotNull())


def text_of(m: Column, key: str) -> Column:
    """A map's text that isn't blank, trimmed (SC28)."""
    return F.nullif(F.trim(F.try_element_at(m, F.lit(key))), F.lit(""))


def number_of(m: Column, key: str) -> Column:
    """A map's finite number, zero for none (SC28)."""
    return F.coalesce(F.try_element_at(m, F.lit(key)).try_cast("double"), F.lit(0.0))


def sanitised(m: Column) -> Column:
    """A map without forbidden keys, its texts redacted (SC29)."""
    bad = F.lit("(?i)(" + "|".join(FORBIDDEN_KEYS) + ")")
    return F.transform_values(F.map_filter(m, lambda k, v: ~F.regexp_like(k, bad)), lambda k, v: redacted(v))


def forbidden(json: Column) -> Column:
    """What a serialised document must not hold, by name (SC31)."""
    return F.array_compact(F.array(F.when(json.rlike(r'(?i)"[^"]*(' + "|".join(FORBIDDEN_KEYS) + r')[^"]*"\s*:'), "forbidden_key"), F.when(json.rlike(SECRET), "secret_value"), F.when(json.rlike(JWT) | json.rlike(BEARER), "token")))


def script_safe(json: Column) -> Column:
    """JSON that can stand in a script tag (SC32)."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(json, "<", r"\\\\u003c"), ">", r"\\\\u003e"), "&", r"\\\\u0026")
