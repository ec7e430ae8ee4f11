"""Documentation text to rows: sections, links, code references, tags; links resolved to files; broken ones classified.

Documents: path, body. Everything is one row's text exploded into lines, and windows within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRONT = r"^---\r?\n([\s\S]*?)\r?\n---\r?\n?"


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def front_matter(body: Column) -> Column:
    """What stands between the dashes at the top, with them; empty without (SC11)."""
    return F.regexp_extract(body, FRONT, 0)


def tags(body: Column) -> Column:
    """The tags that the front matter lists, inline or as items, each once, in order (SC11)."""
    text = F.regexp_extract(body, FRONT, 1)
    inline = F.split(F.regexp_extract(text, r"(?m)^tags:\s*\[([^\]]*)\]", 1), ",")
    items = F.regexp_extract_all(F.regexp_extract(text, r"(?m)^tags:\s*\n((?:\s*-\s+.+\n?)*)", 1), F.lit(r"-\s+(.+)"), F.lit(1))
    clean = F.transform(F.concat(inline, items), lambda t: F.regexp_replace(F.trim(t), "^['\"]|['\"]$", ""))
    return F.array_distinct(F.filter(clean, lambda t: t != ""))


def without_fences(text: Column) -> Column:
    return F.regexp_replace(text, r"```[\s\S]*?```", "\n")


def _lines(docs: DataFrame, fences: bool) -> DataFrame:
    """path, line, text of the body after its front matter; lines count from the file's top."""
    front = front_matter(F.col("body"))
    offset = F.length(front) - F.length(F.regexp_replace(front, "\n", ""))
    rest = F.substring(F.col("body"), F.length(front) + 1, F.length("body"))
    rows = docs.select("path", offset.alias("offset"), F.posexplode(F.split(without_fences(rest) if fences else rest, "\n")).alias("i", "text"))
    return rows.select("path", (F.col("i") + 1 + F.col("offset")).alias("line"), "text")


def sections(docs: DataFrame) -> DataFrame:
    """path, line, level, heading, slug, parent: slugs are unique in a file, a parent is the nearest heading above of a smaller level (EX22, WI10, WI12)."""
    rows = _lines(docs, False).withColumn("level", F.length(F.regexp_extract("text", r"^(#{1,3})\s+(.+?)\s*$", 1))).filter("level > 0")
    rows = rows.select("path", "line", "level", F.trim(F.regexp_extract("text", r"^(#{1,3})\s+(.+?)\s*$", 2)).alias("heading"))
    base = F.when(slug(F.col("heading")) == "", "section").otherwise(slug(F.col("heading")))
    nth = F.row_number().over(Window.partitionBy("path", "base").orderBy("line")) - 1
    rows = rows.withColumn("base", base).withColumn("nth", nth)
    rows = rows.withColumn("slug", F.when(F.col("nth") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", "nth")))
    above = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda most: F.last(F.when(F.col("level") <= most, F.struct("level", "slug")), ignorenulls=True).over(above)
    return rows.withColumn("one", last(1)).withColumn("two", last(2)).select("path", "line", "level", "heading", "slug", F.when(F.col("level") == 2, F.col("one.slug")).when(F.col("level") == 3, F.col("two.slug")).alias("parent"))


def _with_section(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """rows (path, line, ...) with the slug of the last heading at or above their line (WI11): headings and rows in one ordered pass."""
    marks = heads.select("path", "line", F.lit(0).alias("turn"), "slug", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in ("path", "line")])
    both = marks.unionByName(rows.select("path", "line", F.lit(1).alias("turn"), F.lit(None).cast("string").alias("slug"), *[c for c in rows.columns if c not in ("path", "line")]))
    w = Window.partitionBy("path").orderBy("line", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("section", F.last("slug", ignorenulls=True).over(w)).filter("turn = 1").drop("turn", "slug")


def split_target(target: Column) -> tuple[Column, Column]:
    """File and anchor of a link's target; the anchor is null where there is none (SC10)."""
    at = F.instr(target, "#")
    return F.when(at > 0, F.substring(target, F.lit(1), at - 1)).otherwise(target), F.when(at > 0, F.substring(target, at + 1, F.length(target)))


def links(docs: DataFrame) -> DataFrame:
    """path, line, kind, target, anchor, section of links to files and wiki links; web and mail addresses are left out (EX22)."""
    lines = _lines(docs, True)
    mark = lines.select("path", "line", F.lit("markdown_link").alias("kind"), F.posexplode(F.regexp_extract_all("text", F.lit(r"\[([^\]]+)\]\(([^)]+)\)"), F.lit(2))).alias("n", "raw"))
    wiki = lines.select("path", "line", F.lit("wikilink").alias("kind"), F.posexplode(F.regexp_extract_all("text", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).alias("n", "raw"))
    named = F.when(F.col("kind") == "wikilink", F.trim(F.regexp_extract("raw", r"^([^|]*)", 1))).otherwise(F.trim("raw"))
    rows = mark.unionByName(wiki).withColumn("raw", named).filter(~((F.col("kind") == "markdown_link") & F.col("raw").rlike("(?i)^(https?:|mailto:)")))
    file, anchor = split_target(F.col("raw"))
    return _with_section(rows.select("path", "line", "kind", "n", file.alias("target"), anchor.alias("anchor")), sections(docs))


def code_references(docs: DataFrame) -> DataFrame:
    """path, line, reference, kind, section of what stands in backticks, without shell commands (EX22)."""
    rows = _lines(docs, True).select("path", "line", F.posexplode(F.regexp_extract_all("text", F.lit("`([^`]+)`"), F.lit(1))).alias("n", "r"))
    rows = rows.select("path", "line", "n", F.trim("r").alias("reference")).filter((F.col("reference") != "") & (F.length("reference") <= 120) & ~F.col("reference").rlike("(?i)^(?:npm run|git |cd |curl )"))
    r = F.col("reference")
    kind = F.when(r.rlike(r"(?i)\.[a-z0-9]{1,8}$") | r.contains("/"), "file").when(r.rlike("^[A-Za-z][A-Za-z0-9_]*$"), "symbol").otherwise("ambiguous")
    return _with_section(rows.withColumn("kind", kind), sections(docs))


def normal_path(path: Column) -> Column:
    """A path without empty and single-dot parts, each double dot taking the part before it (SC10)."""
    def step(acc: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != "..")
        return F.when((s == "") | (s == "."), acc).when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s))

    return F.array_join(F.aggregate(F.split(F.regexp_replace(path, r"\\", "/"), "/"), F.array().cast("array<string>"), step), "/")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def resolved(found: DataFrame, files: DataFrame, heads: DataFrame) -> DataFrame:
    """Links with the file and the section that they lead to, null where nothing matches; candidates go in order (JO23).

    A target is tried as it is, as Markdown, as a folder's readme and, if it is a bare name, below docs folders.
    """
    own = F.when(F.col("target") == "", F.col("path")).when(F.col("target").startswith("/"), F.substring("target", F.lit(2), F.length("target"))).otherwise(normal_path(F.concat_ws("/", folder(F.col("path")), "target")))
    bare = ~F.col("target").contains("/") & ~F.col("target").rlike(r"(?i)\.[a-z0-9]+$") & (F.col("target") != "")
    plain = ~F.col("to").rlike(r"(?i)\.[a-z0-9]+$")
    also = F.when(plain, F.array(F.concat("to", F.lit(".md")), F.concat("to", F.lit("/README.md")))).otherwise(F.array().cast("array<string>"))
    home = folder(F.col("path"))
    join = lambda *parts: normal_path(F.concat_ws("/", *parts))
    below = F.when(bare, F.array(join(home, F.lit("docs"), "target"), join(home, F.lit("docs"), F.concat("target", F.lit(".md"))), join(F.lit("docs"), "to"), join(F.lit("docs"), F.concat("to", F.lit(".md"))))).otherwise(F.array().cast("array<string>"))
    rows = found.withColumn("to", own).withColumn("tries", F.concat(F.array("to"), also, below))
    tries = rows.select("path", "line", "kind", "n", F.posexplode("tries").alias("k", "file")).join(files.select(F.col("path").alias("file")), "file")
    best = tries.groupBy("path", "line", "kind", "n").agg(F.min_by("file", "k").alias("file"))
    out = found.join(best, ["path", "line", "kind", "n"], "left").withColumn("want", slug(F.coalesce("anchor", F.lit(""))))
    heads = heads.select(F.col("path").alias("file"), F.col("slug").alias("want"), F.col("slug").alias("to_section"))
    return out.join(heads, ["file", "want"], "left").select("path", "line", "kind", "target", "anchor", "section", "file", "to_section")


def diagnostics(rows: DataFrame) -> DataFrame:
    """One line of text for each link without a file, or with an anchor that its file lacks."""
    bad = F.when(F.col("file").isNull(), "link").when(F.col("anchor").isNotNull() & (F.col("anchor") != "") & F.col("to_section").isNull(), "anchor")
    raw = F.concat("target", F.coalesce(F.concat(F.lit("#"), "anchor"), F.lit("")))
    return rows.withColumn("bad", bad).filter("bad IS NOT NULL").select(F.concat(F.lit("Broken doc "), "bad", F.lit(" in "), "path", F.lit(":"), F.col("line").cast("string"), F.lit(": "), raw).alias("text"))


def parsed_diagnostics(lines: DataFrame) -> DataFrame:
    """path, line, target, reason of diagnostic lines, each once; other lines are left out (FI24)."""
    part = lambda k: F.regexp_extract("text", r"^Broken doc (link|anchor) in ([^:]+?)(?::(\d+))?:\s*(.+)$", k)
    rows = lines.select(part(1).alias("what"), F.trim(part(2)).alias("path"), F.expr("try_cast(nullif(regexp_extract(text, '^Broken doc (link|anchor) in ([^:]+?)(?::(\\\\d+))?:\\\\s*(.+)$', 3), '') AS INT)").alias("line"), F.trim(part(4)).alias("target")).filter("what <> ''")
    target = F.coalesce(F.nullif(F.trim(F.regexp_extract("target", r"^\[[^\]]+\]\(([^)]+)\)$", 1)), F.lit("")), F.nullif(F.trim(F.regexp_extract("target", r"^\[\[([^\]|]+)(?:\|[^\]]+)?\]\]$", 1)), F.lit("")), F.col("target"))
    rows = rows.withColumn("target", target)
    file, _ = split_target(F.col("target"))
    rooted = file.rlike(r"^([a-zA-Z]:[\\/]|/|\\)")
    away = rooted | normal_path(F.concat_ws("/", F.nullif(folder(F.col("path")), F.lit("")), file)).rlike(r"^\.\.(/|$)")
    reason = F.when((F.col("what") == "link") & F.col("target").rlike("(?i)^(https?:|mailto:)"), "unsupported_scheme").when(away & (file != ""), "outside_workspace").when(F.col("what") == "anchor", "missing_anchor").otherwise("missing_file")
    return rows.select("path", "line", "target", reason.alias("reason")).distinct()


def hygiene(found: DataFrame) -> DataFrame:
    """Broken links by reason (GA20)."""
    return found.groupBy("reason").agg(F.count("*").alias("n"))


def heading_similarity(a: Column, b: Column) -> Column:
    """1 for equal, 0.82 where one holds the other, else the share of common words among the more numerous (SEA20)."""
    x, y = slug(a), slug(b)
    wx, wy = F.array_distinct(F.split(x, "-")), F.array_distinct(F.split(y, "-"))
    both = F.size(F.array_intersect(wx, wy)) / F.greatest(F.size(wx), F.size(wy), F.lit(1))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.82).otherwise(F.round(both, 6))


def repairs(broken: DataFrame, files: DataFrame) -> DataFrame:
    """path, line, target, file, score, ambiguous: the best file for each broken link by equal path, case, name and stem (SEA19).

    All files of a key have its score, so only the two least paths of a key can be a link's best or second candidate.
    """
    file, _ = split_target(F.col("target"))
    asks = broken.filter("reason = 'missing_file'").select("path", "line", "target", F.lower(normal_path(file)).alias("low"))
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    stem = lambda c: F.regexp_replace(name(c), r"\.[^.]+$", "")
    key = lambda kind, c: F.struct(F.lit(kind).alias("by"), c.alias("key"))
    keys = lambda c: F.array(key("case", c), key("name", name(c)), key("stem", stem(c)))
    index = files.select(F.col("path").alias("file"), F.explode(keys(F.lower("path"))).alias("k")).select("file", "k.*").filter("key <> ''")
    count = index.groupBy("by", "key").agg(F.count("*").alias("m"))
    least = F.row_number().over(Window.partitionBy("by", "key").orderBy("file"))
    index = index.withColumn("k", least).filter("k <= 2").drop("k").join(count, ["by", "key"])
    found = asks.withColumn("k", F.explode(keys(F.col("low")))).select("path", "line", "target", "k.*").join(index, ["by", "key"])
    score = F.when(F.col("by") == "case", 0.92).when((F.col("by") == "name") & (F.col("m") == 1), 0.8).when(F.col("by") == "name", 0.45).when(F.col("m") == 1, 0.85).otherwise(0.45)
    one = found.groupBy("path", "line", "target", "file").agg(F.max(score).alias("score"))
    w = Window.partitionBy("path", "line", "target")
    ranked = one.withColumn("k", F.row_number().over(w.orderBy(F.desc("score"), "file"))).withColumn("next", F.lead("score").over(w.orderBy(F.desc("score"), "file")))
    unsure = F.coalesce((F.col("score") - F.col("next") < 0.04) | (F.col("score") < 0.8), F.col("score") < 0.45)
    return ranked.filter("k = 1").select("path", "line", "target", "file", "score", unsure.alias("ambiguous"))
