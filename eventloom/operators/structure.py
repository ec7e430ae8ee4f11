"""What source says about types: their nesting, what they extend, implement, call and test, and which declared names that means.

A file's text is cut into tokens by one pattern (strings, comments, the rest), so that nothing inside a string or a comment is
read as code and statements may run over several lines. Statements end at a brace or a semicolon; depths are running sums of
braces; of one file and depth, opening and closing braces take turns, which gives each scope its end. Names are looked up by
what files declare (packages, namespaces, types), not by where they lie. Files: path, language, body; a file is a row, and
every step is a column expression, a window within a file, or a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.extract import TEST_FILE
from eventloom.session import kept

#: Languages of braces, and those whose statements end with their line.
BRACES, LINES = ("java", "kotlin", "php", "swift", "csharp", "typescript"), ("kotlin", "swift")
_C_TOKENS = r'"""[\s\S]*?"""|"(?:[^"\\\n]++|\\.)*+"|' + r"'(?:[^'\\\n]++|\\.)*+'" + r"|`(?:[^`\\]++|\\[\s\S])*+`|//[^\n]*|/\*[\s\S]*?\*/|[^\"'`/]+|[\s\S]"
_PHP_TOKENS = _C_TOKENS.replace("|//[^", r"|#(?!\[)[^\n]*|//[^").replace("`/]+", "`/#]+")
_HASH_TOKENS = r'"(?:[^"\\]++|\\[\s\S])*+"|' + r"'(?:[^'\\]++|\\[\s\S])*+'" + r"|#[^\n]*|[^\"'#]+|[\s\S]"
_MODIFIERS = "public|private|protected|internal|fileprivate|open|data|sealed|abstract|final|static|override|suspend|inner|indirect|lateinit|const|weak|lazy|mutating|convenience|required|enum|annotation|inline"
_STARTS = rf"\n(?=[ \t]*(?:@\w|(?:(?:{_MODIFIERS})\s+)*(?:package|import|fun|func|val|var|let|class|interface|object|struct|enum|protocol|extension|actor|init|return|if|for|while|when|switch|typealias)\b))"
_TYPE = r"(?s)^(?:.*?(?<![.\w$]))??(enum\s+class|class|interface|trait|enum|struct|protocol|object|record|extension|actor|module)\s+([A-Za-z_$][\w$]*(?:::\w+)*)(.*?)[;{}]?$"


def masked(files: DataFrame) -> DataFrame:
    """files with tokens and code: the text without comments, and each string as its token's number in quotes; lines stay lines (EX3)."""
    ruby = F.col("language") == "ruby"
    cut = lambda pattern: F.regexp_extract_all("body", F.lit(pattern), F.lit(0))
    php = F.col("language") == "php"
    tokens = F.when(ruby, cut(_HASH_TOKENS)).when(php, cut(_PHP_TOKENS)).otherwise(cut(_C_TOKENS))
    rows = files.withColumn("tokens", tokens)
    breaks = lambda t: F.regexp_replace(t, "[^\n]", "")
    string = lambda t: (F.length(t) > 1) & F.substring(t, 1, 1).isin('"', "'", "`")
    comment = lambda t: F.when(ruby, t.startswith("#")).otherwise(t.startswith("//") | t.startswith("/*") | php & t.startswith("#") & ~t.startswith("#["))
    part = lambda t, i: F.when(comment(t), breaks(t)).when(string(t), F.concat(F.lit('"'), i.cast("string"), F.lit('"'), breaks(t))).otherwise(t)
    code = F.array_join(F.transform("tokens", part), "")
    ended = F.regexp_replace(code, _STARTS, ";\n")
    # Ruby's blocks as braces; those of one line have none
    code_ = F.regexp_replace(code, r"(?m);[ \t]*end[ \t]*$", ";")
    blocks = F.regexp_replace(F.regexp_replace(code_, r"(?m)^([ \t]*(?:class|module|def|if|unless|case|while|until|for|begin)\b[^\n;]*|[^\n]*\bdo(?:[ \t]*\|[^|\n]*\|)?)[ \t]*$", "$1 {"), r"(?m)^[ \t]*end\b", "}")
    return rows.withColumn("code", F.when(ruby, blocks).when(F.col("language").isin(*LINES), ended).otherwise(code))


def statements(rows: DataFrame) -> DataFrame:
    """path, language, pos, line, text, term, depth: statements in order, with what ends them and the braces open before (masked rows)."""
    s = rows.select("path", "language", F.posexplode(F.regexp_extract_all("code", F.lit(r"[^;{}]*[;{}]|[^;{}]+$"), F.lit(0))).alias("pos", "raw"))
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    term = F.when(F.col("raw").rlike("[;{}]$"), F.substring("raw", -1, 1)).otherwise("")
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    s = s.withColumn("term", term).withColumn("step", F.when(F.col("term") == "{", 1).when(F.col("term") == "}", -1).otherwise(0))
    lead = F.regexp_extract("raw", r"^\s*", 0)
    line = 1 + F.coalesce(F.sum(breaks(F.col("raw"))).over(before), F.lit(0)) + breaks(lead)
    return s.select("path", "language", "pos", line.cast("int").alias("line"), F.trim(F.regexp_replace("raw", r"\s+", " ")).alias("text"), "term", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("depth"))


def scopes(rows: DataFrame) -> DataFrame:
    """The statements that open a brace, with closes: the place of the one that closes it (statements)."""
    level = F.when(F.col("term") == "{", F.col("depth")).otherwise(F.col("depth") - 1)
    turn = Window.partitionBy("path", "level").orderBy("pos")
    ends = rows.filter("term IN ('{', '}')").withColumn("level", level).withColumn("closes", F.coalesce(F.lead("pos").over(turn), F.lit((1 << 31) - 1)))
    return ends.filter("term = '{'").drop("level")


def types(rows: DataFrame) -> DataFrame:
    """path, language, pos, line, kind, name, rest, depth, closes: declared types; one without a body closes where it is (statements)."""
    part = lambda k: F.regexp_extract("text", _TYPE, k)
    found = rows.withColumns({"kind": F.regexp_extract(F.regexp_replace(part(1), r"\s+", " "), r"(\w+)$", 1), "name": part(2), "rest": F.trim(part(3))}).filter("name <> '' AND term <> '}'")
    ruby = F.col("language") == "ruby"
    found = found.filter(F.when(ruby, F.col("kind").isin("class", "module")).otherwise(F.col("kind") != "module"))
    ends = scopes(rows).select("path", "pos", "closes")
    return found.join(ends, ["path", "pos"], "left").select("path", "language", "pos", "line", "kind", "name", "rest", "depth", F.coalesce("closes", "pos").alias("closes"))


def declared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The namespace of each file (path, space), and its types with owner and qualified name, dots between all parts (JO16, JO22)."""
    text = F.col("text")
    space = F.regexp_extract(text, r"^(?:<\?php )?(?:package|namespace) ([\w.\\]+)", 1)
    spaces = rows.select("path", "pos", F.replace(space, F.lit("\\"), F.lit(".")).alias("space")).filter("space <> ''").groupBy("path").agg(F.min_by("space", "pos").alias("space"))
    t = types(rows)
    over = t.select("path", F.col("pos").alias("o"), F.col("closes").alias("o_end"), F.col("name").alias("o_name"))
    inside = t.select("path", "pos").join(over, "path").filter("o < pos AND pos < o_end").groupBy("path", "pos").agg(F.sort_array(F.collect_list(F.struct("o", "o_name"))).alias("owners"))
    t = t.join(inside, ["path", "pos"], "left").join(spaces, "path", "left")
    names = F.concat(F.coalesce(F.transform("owners", lambda x: x["o_name"]), F.array().cast("array<string>")), F.array("name"))
    qualified = F.concat_ws(".", F.col("space"), F.replace(F.array_join(names, "."), F.lit("::"), F.lit(".")))
    return spaces, t.select("path", "language", "pos", "line", "kind", "name", "rest", "closes", "space", F.element_at(F.col("owners.o_name"), -1).alias("owner"), qualified.alias("qualified"))


def supertypes(t: DataFrame) -> DataFrame:
    """path, pos, relation, wanted: what the heads of types name (EX14, EX18 to EX20).

    extends and implements as written in Java, PHP, TypeScript and Ruby (where only classes extend). After a colon: in Kotlin what
    is called is extended; in C# and Swift a class extends what comes first, unless its name starts as an interface's does (I
    and a capital).
    """
    bare = F.col("rest")
    colon = F.col("language").isin("kotlin", "swift", "csharp")
    for _ in range(3):
        bare = F.regexp_replace(bare, "<[^<>]*>", "")
    args = F.regexp_replace(F.regexp_replace(bare, r"\([^()]*\)", "()"), r"\([^()]*\)", "()")
    named = lambda word, stop: F.regexp_extract(bare, rf"\b{word} (.+?)(?= (?:{stop})\b|$)", 1)
    after = F.regexp_extract(args, r"^[^:]*:\s*(.+?)(?= where\b|$)", 1)
    entries = lambda text, relation: F.transform(F.split(text, ","), lambda e, i: F.struct(F.trim(e).alias("e"), i.alias("i"), F.lit(relation).alias("r")))
    ruby = F.regexp_extract(bare, r"^<\s*([\w:]+)", 1)
    raw = F.when(colon, entries(after, "")).when(F.col("language") == "ruby", entries(ruby, "extends")).otherwise(F.concat(entries(named("extends", "implements|permits"), "extends"), entries(named("implements", "extends|permits"), "implements")))
    rows = t.select("path", "language", "pos", "kind", F.explode(raw).alias("x")).select("path", "language", "pos", "kind", "x.*").filter("e <> ''")
    first = (F.col("i") == 0) & (F.col("kind") == "class") & ~((F.col("language") == "csharp") & F.col("e").rlike("^I[A-Z]"))
    relation = F.when(F.col("r") != "", F.col("r")).when(F.col("language") == "kotlin", F.when(F.col("e").contains("("), "extends").otherwise("implements")).when(first, "extends").otherwise("implements")
    return rows.select("path", "pos", relation.alias("relation"), F.regexp_extract("e", r"^\\?([\w.\\:$]+)", 1).alias("wanted")).filter("wanted <> ''")


def calls(rows: DataFrame, t: DataFrame) -> DataFrame:
    """path, pos (of the innermost type around), relation, wanted, member: types that are constructed, and called by name."""
    text = F.col("text")
    made = F.transform(F.regexp_extract_all(text, F.lit(r"\bnew ([A-Z][\w.\\]*)"), F.lit(1)), lambda x: F.struct(F.lit("constructs").alias("relation"), x.alias("wanted"), F.lit(None).cast("string").alias("member")))
    said = F.regexp_extract_all(text, F.lit(r"(?<![\w.])(?<!new )([A-Z]\w*(?:\.|::)\w+)\s*\("), F.lit(1))
    called = F.transform(said, lambda x: F.struct(F.lit("calls").alias("relation"), F.regexp_extract(x, r"^(\w+)", 1).alias("wanted"), F.regexp_extract(x, r"(\w+)$", 1).alias("member")))
    found = rows.select("path", F.col("pos").alias("at"), F.explode(F.concat(made, called)).alias("x")).select("path", "at", "x.*")
    around = t.select("path", "pos", "closes").join(found, "path").filter("pos < at AND at <= closes")
    return around.groupBy("path", "at", "relation", "wanted", "member").agg(F.max("pos").alias("pos")).groupBy("path", "pos", "relation", "wanted", "member").count().drop("count")


def imported(rows: DataFrame, files: DataFrame) -> DataFrame:
    """path, line, target, alias, whole: names and modules that files import, over several lines as well; whole: of all names below (SC12, EX3)."""
    text = F.col("text")
    name = F.when(F.col("language").isin("java", "kotlin"), F.regexp_extract(text, r"^import (?:static )?(\w+(?:\.\w+)*(?:\.\*)?)", 1)).when(F.col("language") == "csharp", F.regexp_extract(text, r"^(?:global )?using (?:static )?(?:\w+ = )?([\w.]+) ?;$", 1)).when(F.col("language") == "php", F.regexp_extract(text, r"^use (?:function |const )?\\?([\w\\]+)(?: as \w+)? ?;$", 1))
    alias = F.nullif(F.regexp_extract(text, r"^(?:import [\w.]+|use [\w\\]+) as (\w+)|^using (\w+) =", 1), F.lit(""))
    alias = F.coalesce(alias, F.nullif(F.regexp_extract(text, r"^using (\w+) = ", 1), F.lit("")))
    plain = rows.withColumn("t", name).filter("t IS NOT NULL AND t <> ''").select("path", "line", F.replace(F.regexp_replace("t", r"\.\*$", ""), F.lit("\\"), F.lit(".")).alias("target"), alias.alias("alias"), (F.col("t").endswith("*") | (F.col("language") == "csharp") & alias.isNull()).alias("whole"))
    script = files.filter("language = 'typescript'").select("path", "code", "tokens", F.explode(F.regexp_extract_all("code", F.lit(r'(?s)\b(?:import|export)\b[^;"()]*?\bfrom\s*"\d+"|\bimport\s*"\d+"'), F.lit(0))).alias("said"))
    before = F.expr("substring(code, 1, instr(code, said))")
    line = 1 + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    token = F.element_at("tokens", F.regexp_extract("said", r'"(\d+)"$', 1).cast("int") + 1)
    script = script.select("path", line.cast("int").alias("line"), token.alias("target"), F.lit(None).cast("string").alias("alias"), F.lit(False).alias("whole"))
    return plain.unionByName(script.withColumn("target", F.expr("substring(target, 2, length(target) - 2)")))


def resolved(wanted: DataFrame, t: DataFrame, spaces: DataFrame, names: DataFrame) -> DataFrame:
    """wanted (path, pos, wanted, ...) with qualified, target_path and resolution (JO16, JO18, JO22).

    A name is tried, in order, as a type within the same or an enclosing type or namespace, the nearest first, as an imported
    name or alias, and below each namespace imported as a whole. symbol: declared by some file; external: an import names it;
    unknown: neither.
    """
    key = ["path", "pos", "name_"]
    rows = wanted.withColumn("name_", F.replace(F.replace("wanted", F.lit("\\"), F.lit(".")), F.lit("::"), F.lit(".")))
    own = rows.select(*key).distinct().join(t.select("path", "pos", F.col("qualified").alias("own")), ["path", "pos"])
    parts = F.split("own", r"\.")
    # every prefix of the own qualified name, the longest first, and none at all
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda k: F.concat_ws(".", F.when(k > 0, F.array_join(F.slice(parts, F.lit(1), k), ".")), F.col("name_")))
    near = own.select(*key, F.posexplode(prefixes).alias("rank", "qualified")).withColumn("explicit", F.lit(False))
    head, tail = F.regexp_extract("name_", r"^([^.]+)", 1), F.regexp_extract("name_", r"^[^.]+(.*)$", 1)
    names = names.withColumn("last", F.coalesce("alias", F.regexp_extract("target", r"([^.]+)$", 1)))
    asked = rows.select(*key).distinct().withColumns({"head": head, "tail": tail})
    by_name = asked.join(names.filter("NOT whole").select("path", F.col("last").alias("head"), "target"), ["path", "head"]).select(*key, F.lit(1000).alias("rank"), F.concat("target", "tail").alias("qualified"), F.lit(True).alias("explicit"))
    below = asked.join(names.filter("whole").select("path", "target"), "path").select(*key, F.lit(2000).alias("rank"), F.concat_ws(".", "target", "name_").alias("qualified"), F.lit(False).alias("explicit"))
    index = t.groupBy("qualified").agg(F.min("path").alias("target_path"))
    tried = near.unionByName(by_name).unionByName(below).join(index, "qualified", "left")
    best = tried.filter("target_path IS NOT NULL OR explicit").groupBy(*key).agg(F.min_by(F.struct("qualified", "target_path"), F.struct(F.col("target_path").isNull(), "rank", "qualified")).alias("x"))
    out = rows.join(best, key, "left").drop("name_")
    return out.select(*wanted.columns, "x.qualified", "x.target_path", F.when(F.col("x").isNull(), "unknown").when(F.col("x.target_path").isNotNull(), "symbol").otherwise("external").alias("resolution"))


def _read(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Masked files, statements, namespaces and types, each written once."""
    rows_ = kept(masked(files), "masked")
    rows = kept(statements(rows_), "statements")
    spaces, t = declared(rows)
    return rows_, rows, kept(spaces, "namespaces"), kept(t, "types")


def relations(files: DataFrame) -> DataFrame:
    """path, type (qualified), relation, wanted, member, qualified, target_path, resolution: what every type extends, implements,
    constructs, calls and tests (EX14, EX18 to EX20). A test file's type tests the type of its name without Test, Tests or Spec,
    where some file declares it."""
    rows_, rows, spaces, t = _read(files.filter(F.col("language").isin(*BRACES, "ruby")))
    none = F.lit(None).cast("string").alias("member")
    subject = F.regexp_extract("name", r"^(.+?)(?:Tests?|Spec)$", 1)
    tests = t.filter(F.col("path").rlike(TEST_FILE) & F.col("owner").isNull()).select("path", "pos", F.lit("tests").alias("relation"), subject.alias("wanted"), none).filter("wanted <> ''")
    wanted = supertypes(t).select("path", "pos", "relation", "wanted", none).unionByName(calls(rows, t)).unionByName(tests)
    found = resolved(wanted, t, spaces, imported(rows, rows_)).filter("relation <> 'tests' OR resolution = 'symbol'")
    return found.join(t.select("path", "pos", F.col("qualified").alias("type")), ["path", "pos"]).drop("pos")


def import_targets(files: DataFrame) -> DataFrame:
    """path, line, target, match, kind, file: each import with the longest declared name that it starts with (JO16, JO18, JO22).

    kind: type (file is the one that declares it), namespace, or none; every prefix of an import is a key of the index.
    """
    rows_, rows, spaces, t = _read(files.filter(F.col("language").isin("java", "kotlin", "csharp", "php")))
    index = t.groupBy("qualified").agg(F.min("path").alias("file")).select(F.col("qualified").alias("match"), F.lit("type").alias("kind"), "file")
    index = index.unionByName(spaces.select(F.col("space").alias("match")).distinct().select("match", F.lit("namespace").alias("kind"), F.lit(None).cast("string").alias("file")))
    found = imported(rows, rows_).select("path", "line", "target")
    parts = F.split("target", r"\.")
    keys = found.withColumn("match", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))))
    best = keys.join(index, "match").groupBy("path", "line", "target").agg(F.max_by(F.struct("match", "kind", "file"), F.struct(F.length("match"), F.col("kind") == "type")).alias("x"))
    return found.join(best, ["path", "line", "target"], "left").select("path", "line", "target", "x.match", F.coalesce("x.kind", F.lit("none")).alias("kind"), "x.file")
