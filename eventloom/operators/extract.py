"""Source text to rows: symbols and imports by line, and imports resolved to files.

Rules are data: for each language the patterns of a symbol's line with its kind, of an import's line, and of lines to pass
over. The first pattern that a trimmed line meets decides. Files: path, language, body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.docs import folder, normal_path

# Fixed values: (pattern with the name as first group, kind), in order; then import patterns; then what starts a comment.
LANGUAGES = {
    "python": ([(r"^class\s+(\w+)", "class"), (r"^(?:async\s+)?def\s+(\w+)", "function")], [r"^from\s+([\w.]+)\s+import", r"^import\s+([\w.]+)"], "#"),
    "go": ([(r"^package\s+(\w+)", "package"), (r"^func\s+(?:\([^)]+\)\s+)?(\w+)", "function"), (r"^type\s+(\w+)\s+struct\b", "struct"), (r"^type\s+(\w+)\s+interface\b", "interface")], [r'^import\s+(?:\w+\s+)?"([^"]+)"', r'^"([^"]+)"$'], "//"),
    "rust": ([(r"^(?:pub\s+)?mod\s+(\w+)", "module"), (r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", "function"), (r"^(?:pub\s+)?struct\s+(\w+)", "struct"), (r"^(?:pub\s+)?enum\s+(\w+)", "enum"), (r"^(?:pub\s+)?trait\s+(\w+)", "trait"), (r"^impl(?:<[^>]+>)?\s+(\w+)", "impl")], [r"^use\s+([^;]+);"], "//"),
    "java": ([(r"^package\s+([\w.]+)\s*;", "package"), (r"^(?:public\s+|private\s+|protected\s+)?(?:abstract\s+|final\s+|sealed\s+)*class\s+(\w+)", "class"), (r"^(?:public\s+)?interface\s+(\w+)", "interface"), (r"^(?:public\s+)?enum\s+(\w+)", "enum"), (r"^(?:public\s+)?record\s+(\w+)", "record"),
              (r"^(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?[\w.<>,\[\]]+\s+(\w+)\s*\([^;]*\)\s*(?:throws\s+[\w.,\s]+)?\s*\{?\s*$", "method")], [r"^import\s+(?:static\s+)?([\w.*]+)\s*;"], "//"),
    "kotlin": ([(r"^package\s+([\w.]+)", "package"), (r"^(?:public\s+|internal\s+|private\s+)?(?:data\s+|open\s+|sealed\s+|abstract\s+)*class\s+(\w+)", "class"), (r"^(?:fun\s+)?interface\s+(\w+)", "interface"), (r"^object\s+(\w+)", "object"), (r"^(?:suspend\s+|override\s+|private\s+)*fun\s+(\w+)", "function")], [r"^import\s+([\w.*]+)"], "//"),
    "ruby": ([(r"^module\s+([\w:]+)", "module"), (r"^class\s+([\w:]+)", "class"), (r"^def\s+(?:self\.)?(\w+[?!]?)", "method")], [r"""^require(?:_relative)?\s+["']([^"']+)["']"""], "#"),
    "php": ([(r"^namespace\s+([\w\\]+)", "namespace"), (r"^(?:abstract\s+|final\s+)?class\s+(\w+)", "class"), (r"^interface\s+(\w+)", "interface"), (r"^trait\s+(\w+)", "trait"), (r"^(?:public\s+|private\s+|protected\s+|static\s+)*function\s+(\w+)", "function")], [r"^use\s+([\w\\]+)"], "//"),
    "swift": ([(r"^(?:public\s+|final\s+)*class\s+(\w+)", "class"), (r"^(?:public\s+)?struct\s+(\w+)", "struct"), (r"^(?:public\s+)?protocol\s+(\w+)", "protocol"), (r"^(?:public\s+)?enum\s+(\w+)", "enum"), (r"^(?:public\s+|private\s+|static\s+)*func\s+(\w+)", "function")], [r"^import\s+(\w+)"], "//"),
    "csharp": ([(r"^namespace\s+([\w.]+)", "namespace"), (r"^(?:public\s+|internal\s+|sealed\s+|abstract\s+|static\s+|partial\s+)*class\s+(\w+)", "class"), (r"^(?:public\s+|internal\s+)?interface\s+(\w+)", "interface"), (r"^(?:public\s+|internal\s+)?(?:record|struct)\s+(\w+)", "record"), (r"^(?:public\s+|internal\s+)?enum\s+(\w+)", "enum")], [r"^using\s+(?:static\s+)?([\w.]+)\s*;"], "//"),
    "cpp": ([(r"^(?:class|struct)\s+(\w+)\s*[:{]?[^;]*$", "class"), (r"^enum\s+(?:class\s+)?(\w+)", "enum"), (r"^namespace\s+(\w+)", "namespace")], [r'^#include\s+["<]([^">]+)[">]'], "//"),
    "dart": ([(r"^(?:abstract\s+)?class\s+(\w+)", "class"), (r"^mixin\s+(\w+)", "mixin"), (r"^enum\s+(\w+)", "enum")], [r"""^import\s+["']([^"']+)["']"""], "//"),
    "gdscript": ([(r"^class_name\s+(\w+)", "class"), (r"^func\s+(\w+)", "function"), (r"^signal\s+(\w+)", "signal")], [r"""preload\(["']([^"']+)["']\)"""], "#"),
    "terraform": ([(r'^resource\s+"[^"]+"\s+"([^"]+)"', "resource"), (r'^module\s+"([^"]+)"', "module"), (r'^variable\s+"([^"]+)"', "variable")], [r'^source\s*=\s*"([^"]+)"'], "#"),
    "shell": ([(r"^(?:function\s+)?(\w+)\s*\(\)\s*\{?", "function"), (r"^function\s+(\w+)", "function")], [r"^(?:source|\.)\s+(\S+)"], "#"),
    "powershell": ([(r"(?i)^function\s+([\w-]+)", "function"), (r"(?i)^class\s+(\w+)", "class")], [r"^\.\s+(\S+)"], "#"),
    "typescript": ([(r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "class"), (r"^(?:export\s+)?interface\s+(\w+)", "interface"), (r"^(?:export\s+)?type\s+(\w+)\s*=", "type"), (r"^(?:export\s+)?enum\s+(\w+)", "enum"),
                    (r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)", "function"), (r"^(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\(", "function")], [r"""^(?:import|export)\s+(?:[^"';]+?\s+from\s+)?["']([^"']+)["']"""], "//"),
}
ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".mjs", ".cts", ".cjs")
TEST_FILE = r"(?i)((?:^|/)tests?/|_test\.(py|go)$|(^|/)test_[^/]*$|Test\.(java|kt|php|swift)$|\.(test|spec)\.[^/]*$|_spec\.rb$)"


def lines(files: DataFrame) -> DataFrame:
    """path, language, line, indent, text of the lines that are neither blank nor comments."""
    rows = files.select("path", "language", F.posexplode(F.split("body", "\n")).alias("i", "raw"))
    rows = rows.select("path", "language", (F.col("i") + 1).alias("line"), (F.length("raw") - F.length(F.ltrim("raw"))).alias("indent"), F.trim("raw").alias("text")).filter("text <> ''")
    comment = F.lit(False)
    for name, (_, _, mark) in LANGUAGES.items():
        # a directive of C starts as a comment does elsewhere
        comment = comment | ((F.col("language") == name) & F.col("text").startswith(mark))
    return rows.filter(~comment)


def symbols(files: DataFrame) -> DataFrame:
    """path, language, line, name, kind, parent: a parent is the nearest class-like line above that is less indented (EX3, EX5 to EX16, EX21)."""
    name, kind = None, None
    for language, (rules, _, _) in LANGUAGES.items():
        for pattern, what in rules:
            hit = (F.col("language") == language) & F.col("text").rlike(pattern)
            name = F.when(hit, F.regexp_extract("text", pattern, 1)) if name is None else name.when(hit, F.regexp_extract("text", pattern, 1))
            kind = F.when(hit, what) if kind is None else kind.when(hit, what)
    rows = lines(files).withColumn("name", name).withColumn("kind", kind).filter("kind IS NOT NULL")
    type_ = F.col("kind").isin("class", "interface", "struct", "enum", "trait", "record", "protocol", "object", "module", "impl", "mixin")
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    over = F.last(F.when(type_, F.struct("name", "indent")), ignorenulls=True).over(w)
    inner = F.col("kind").isin("function", "method")
    return rows.withColumn("over", over).select("path", "language", "line", "name", "kind", F.when(inner & (F.col("over.indent") < F.col("indent")), F.col("over.name")).alias("parent"))


def imports(files: DataFrame) -> DataFrame:
    """path, language, line, target of import lines (SC12, EX11)."""
    target = None
    for language, (_, patterns, _) in LANGUAGES.items():
        for pattern in patterns:
            hit = (F.col("language") == language) & F.col("text").rlike(pattern)
            target = F.when(hit, F.regexp_extract("text", pattern, 1)) if target is None else target.when(hit, F.regexp_extract("text", pattern, 1))
    return lines(files).withColumn("target", target).filter("target IS NOT NULL").select("path", "language", "line", "target")


def file_facts(files: DataFrame) -> DataFrame:
    """path, language, symbols, imports, is_test: one row a file (EX11)."""
    s, i = symbols(files).groupBy("path").agg(F.count("*").alias("symbols")), imports(files).groupBy("path").agg(F.count("*").alias("imports"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return files.select("path", "language").join(s, "path", "left").join(i, "path", "left").select("path", "language", zero("symbols"), zero("imports"), F.col("path").rlike(TEST_FILE).alias("is_test"))


def _swapped(base: Column) -> Column:
    """A base path as it is, with each ending in place of its own, with each added, and as a folder's index."""
    bare = F.regexp_replace(base, r"\.[A-Za-z]+$", "")
    each = lambda stem, tail="": [F.concat(stem, F.lit(tail + e)) for e in ENDINGS]
    return F.array(base, *each(bare), *each(base), *each(base, "/index"))


def tries(psr4: dict[str, str] = {}) -> Column:
    """The paths that an import (path, language, target) may mean, in the order in which they are tried (JO5, JO6, JO16 to JO22).

    psr4: namespace prefixes of PHP and their folders; the longest prefix counts first.
    """
    t, here, lang = F.col("target"), folder(F.col("path")), F.col("language")
    at = lambda *parts: normal_path(F.concat_ws("/", *parts))
    dotted = F.regexp_replace(F.regexp_replace(t, r"\.\*$", ""), r"\.", "/")
    none = F.array().cast("array<string>")
    php = [F.when(t.startswith(p), F.concat(F.lit(f"{d}/"), F.regexp_replace(F.substring(t, F.lit(len(p) + 1), F.length(t)), r"\\", "/"), F.lit(".php"))) for p, d in sorted(psr4.items(), key=lambda x: -len(x[0]))]
    relative = t.startswith(".")
    return (
        F.when((lang == "typescript") & relative, _swapped(at(here, t)))
        .when(lang == "python", F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")), at(here, F.concat(dotted, F.lit(".py")))))
        .when(lang.isin("java", "kotlin"), F.array(F.concat(F.lit("src/main/java/"), dotted, F.lit(".java")), F.concat(F.lit("src/main/kotlin/"), dotted, F.lit(".kt")), F.concat(dotted, F.lit(".java")), F.concat(dotted, F.lit(".kt"))))
        .when(lang == "php", F.array_compact(F.array(*php)) if php else none)
        .when((lang == "ruby") & relative, F.array(at(here, t), at(here, F.concat(t, F.lit(".rb"))))).when(lang == "ruby", F.array(F.concat(t, F.lit(".rb")), F.concat(F.lit("lib/"), t, F.lit(".rb")), F.concat(F.lit("lib/"), t, F.lit("/"), t, F.lit(".rb"))))
        .when(lang == "cpp", F.array(at(here, t), at(F.lit("include"), t), t, at(F.lit("src"), t)))
        .when(lang == "dart", F.array(F.regexp_replace(t, r"^package:[^/]+/", "lib/"), at(here, t)))
        .when(lang == "gdscript", F.array(F.regexp_replace(t, "^res://", "")))
        .when(lang.isin("shell", "powershell"), F.array(at(here, t))).otherwise(none))


def resolved(found: DataFrame, files: DataFrame, psr4: dict[str, str] = {}) -> DataFrame:
    """Imports with file and resolution: file for the first path that exists, unresolved for relative ones that none matches, else external."""
    rows = found.select("*", F.posexplode_outer(tries(psr4)).alias("k", "file"))
    hit = rows.join(files.select(F.col("path").alias("file")), "file").groupBy("path", "line").agg(F.min_by("file", "k").alias("file"))
    relative = F.col("target").startswith(".")
    return found.join(hit, ["path", "line"], "left").select("path", "language", "line", "target", "file", F.when(F.col("file").isNotNull(), "file").when(relative, "unresolved").otherwise("external").alias("resolution"))


def dependencies(rows: DataFrame) -> DataFrame:
    """Resolved imports by file and target: count, first line, distinct names (AG3)."""
    return rows.filter("file IS NOT NULL AND file <> path").groupBy("path", "file").agg(F.count("*").alias("n"), F.min("line").alias("line"), F.array_join(F.array_sort(F.collect_set("target")), ",").alias("targets"))


def external_nodes(rows: DataFrame) -> DataFrame:
    """One node for each language's outside name (EX23)."""
    return rows.filter("resolution = 'external'").groupBy("language", "target").agg(F.count("*").alias("imports")).select(F.concat(F.lit("external:"), "language", F.lit(":"), "target").alias("id"), "imports")


def tested_files(files: DataFrame) -> DataFrame:
    """(test, file): a test and the first file of its name without the test's mark that exists (JO7)."""
    tests = files.filter(F.col("path").rlike(r"(?i)\.(test|spec)\.[^./]+$")).select(F.col("path").alias("test"))
    stem = F.regexp_replace("test", r"(?i)\.(test|spec)\.[^./]+$", "")
    rows = tests.select("test", F.posexplode(F.array(*[F.concat(stem, F.lit(e)) for e in ENDINGS])).alias("k", "file"))
    return rows.join(files.select(F.col("path").alias("file")), "file", "left_semi").groupBy("test").agg(F.min_by("file", "k").alias("file"))


def linked_paths(run_paths: DataFrame, files: DataFrame) -> DataFrame:
    """(run_path, file): paths that are equal, or one the end of the other after a slash, in any case (JO8).

    Each path meets the ends of the others, after any slash, as a key: only paths that belong together meet, however many share
    a name.
    """
    a = run_paths.select(F.col("path").alias("run_path"), F.lower("path").alias("key")).distinct()
    b = files.select(F.col("path").alias("file"), F.lower("path").alias("key")).distinct()
    parts = F.split("key", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    tails = lambda df, name: df.select(name, F.explode(ends).alias("key"))
    return tails(a, "run_path").join(b, "key").select("run_path", "file").unionByName(a.join(tails(b, "file"), "key").select("run_path", "file")).distinct()
