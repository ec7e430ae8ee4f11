"""Classification, ranking and search of code-graph nodes and edges, as expressions over their columns.

Nodes have id, kind, label, path (may be null), slug, parent, source_file; edges id, src, dst, kind, provenance, source,
confidence, relation. Rules are data (patterns over a path's parts), so that a user can bring others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators import graph as g
from eventloom.session import kept, sided

# Lenses and task scopes as alternatives of patterns that must all hold; a leading "!" negates.
LENSES = {
    "frontend": [[("base", r"\.(tsx|jsx|vue|svelte|css|scss|xaml)$")], [("padded", "/(components|pages|views|app|renderer|webview|styles|ui)/")]],
    "backend-runtime": [[("padded", "/(backend|server|api|routes|controllers|services|scanner|cli|runtime|middleware|cmd|internal|pkg)/")]],
    "tests": [[("padded", "/(tests|test|e2e|playwright|__tests__)/")], [("base", r"\.(test|spec)\.")], [("base", r"_test\.(go|py|rs)$")], [("normal", "tests?/")]],
    "provider-ai": [[("padded", "/(providers|provider|sdk|ai|llm|mcp|embeddings)/")], [("normal", "(openai|ollama|anthropic|gemini)")]],
    "docs-handoff": [[("base", r"\.(md|rst|txt)$")], [("padded", "/(docs|documentation|wiki|handoff)/")], [("normal", "(graph_report|llms|readme|plan)")]],
    "infra": [[("base", r"\.(tf|tfvars|yaml|yml)$"), ("padded", "/(terraform|k8s|kubernetes|docker|ansible|pulumi|infra|charts|modules)/")], [("base", r"\.tf$")]],
    "database": [[("padded", "/(migrations|schema|repositories|repository|models|database|db|sql)/")], [("base", r"^models\.py$")]],
    "desktop-mobile": [[("base", r"\.(xaml|cs)$"), ("padded", "/(viewmodels|views|app)/")], [("padded", "/(electron|tauri|android|ios|flutter|desktop|mobile|pubspec)/")], [("base", r"\.xaml$")]],
    "game-assets": [[("padded", "/(assets|unity|unreal|godot|scenes|scripts)/")]],
    "security": [[("padded", "/(auth|security|crypto|owasp|permissions)/")]],
}
_BACKEND = "/(backend|runtime|runner|electron|auth|cli|config|controllers|db|middleware|observability|providers|provider|repositories|scanner|server|services)/"
SCOPES = {
    "frontend": [[("padded", "/(frontend|renderer|webview)/")], [("base", r"\.(tsx|jsx)$")], [("padded", "/(components|pages|styles)/"), ("!padded", _BACKEND)]],
    "backend-runtime": [[("padded", _BACKEND)], [("padded", "/routes/")]],
    "vscode-extension": [[("padded", "/(vscode-extension|extension-host)/")]],
    "tests": [[("padded", "/(tests|test|e2e|playwright)/")], [("base", r"\.(test|spec|component-test|component-tests)\.[cm]?[jt]sx?$")]],
    "provider-ai": [[("padded", "/(providers|provider|sdk|ai|llm|mcp)/")], [("normal", "(openai|ollama|anthropic|gemini|embedding|embeddings)")]],
    "handoff-docs": [[("padded", "/(docs|documentation)/")], [("normal", "(handoff|graph_report|llms|readme|plan|gate)")]],
}
TEST_PATH, GENERATED = r"(?:^|/)(tests?|__tests__|spec)(?:/|$)", r"(?:^|/)(?:bin|obj|node_modules|dist|build|\.git|\.next|\.turbo|coverage)(?:/|$)"
CONFIDENCE = {"extracted": 0.92, "inferred": 0.65, "ambiguous": 0.45, "manual": 0.85}
SOURCES = (
    "typescript", "roslyn", "dotnet-structural", "javakotlin-semantic-lite", "java-structural", "php-semantic-lite", "php-structural", "ruby-semantic-lite",
    "ruby-structural", "swift-structural", "cpp-structural", "dart-structural", "godot-structural", "unity-structural", "unreal-structural", "python-structural",
    "go-structural", "rust-structural", "terraform-structural", "xaml", "docs", "generic", "kernel",
)
#: Names that scanners give to relations, and what paths call them.
RELATIONS = {
    "semantic_calls": "calls", "semantic_constructor": "constructor", "semantic_inherits": "inherits", "semantic_implements": "implements", "source_file": "belongs_to",
    "view_viewmodel": "uses", "xaml_code_behind": "uses",
}
#: What extraction calls relations, and the edge kinds that they become.
ALIASES = {
    "import": "imports", "inheritance": "extends", "test_target": "tests", "rails_route": "route_to_handler", "laravel_route": "route_to_handler", "external_import": "imports",
    "external_using": "imports",
}
EDGE_KINDS = {
    "extends": "inherits", "implements": "implements", "tests": "tests", "imports": "depends_on", "calls": "depends_on", "uses": "depends_on", "route_to_handler": "depends_on",
    "asset_references": "depends_on",
}
#: Words that are looked up one by one.
FEW_WORDS = 256
CODE_KINDS, DOC_KINDS = ("symbol", "code_file", "test", "route", "command"), ("doc_file", "doc_section")
CODE_QUERY = r"(?i)\b(fix|change|implement|debug|call|construct|handle|service|controller|class|method|function|adapter|repository)\b"
DOCS_QUERY = r"(?i)\b(architecture|contract|guide|how does|how do|why|decision|runbook|readme|overview|handoff|wiki|docs?|documentation)\b"
DOCS_ASKED = r"(?i)\b(how does|how do|architecture|guide|docs?|documentation|readme|overview|handoff|wiki)\b"
CLASS_LABEL = r"\((class|record|struct|interface|actor|enum|trait)\)"
FILE_ENDINGS = (
    "ts tsx js jsx mts mjs cts cjs cs xaml csproj sln props targets py go rs java kt kts rb rake php phtml swift dart c cc cpp h hpp tf tfvars md rst gd tscn tres unity prefab "
    "ps1 sh bash json yaml yml toml xml sql vue svelte scala fs vb").split()
SOURCE_ENDINGS = r"(?i)\.(cs|ts|tsx|js|jsx|kt|java|rb|php|py|go|rs|swift|cpp|c|h|hpp|dart|gd|ps1|sh|bash)$"


def lookup(pairs: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def shown(path: str = "path", label: str = "label") -> Column:
    """A node's path, or its label where it has none."""
    return F.coalesce(F.col(path), F.col(label))


# --- paths -----------------------------------------------------------------------------------------------------------

def path_parts(path: Column) -> dict[str, Column]:
    normal = F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/+", ""))
    return {"normal": normal, "base": F.regexp_extract(normal, "([^/]*)/*$", 1), "padded": F.concat(F.lit("/"), normal, F.lit("/"))}


def matched(path: Column, rules: dict[str, list]) -> Column:
    """The names of all rules that a path meets, in the rules' order (FI1, FI4)."""
    part = path_parts(path)
    test = lambda f, p: ~part[f[1:]].rlike(p) if f[0] == "!" else part[f].rlike(p)
    every = lambda tests: reduce(lambda a, b: a & b, [test(f, p) for f, p in tests])
    some = lambda ways: reduce(lambda a, b: a | b, [every(w) for w in ways])
    found = F.array_compact(F.array(*[F.when(some(ways), F.lit(name)) for name, ways in rules.items()]))
    return F.when(F.coalesce(part["normal"], F.lit("")) == "", F.array().cast("array<string>")).otherwise(found)


def node_lenses(rules: dict[str, list] = LENSES) -> Column:
    """Lenses of a node: those of its path, and those that its kind and label bring (FI2)."""
    kind, label = F.col("kind"), F.lower("label")
    more = F.array_compact(F.array(
        F.when(kind == "community", "backend-runtime"), F.when(kind.isin(*DOC_KINDS), "docs-handoff"),
        F.when((kind == "config_file") & F.lower(shown()).rlike(r"\.(tf|tfvars)$"), "infra"),
        F.when((kind == "symbol") & label.rlike("viewmodel|view|page|component"), "frontend"), F.when((kind == "symbol") & label.contains("test"), "tests")))
    return F.array_union(matched(shown(), rules), more)


def lens_graph(nodes: DataFrame, edges: DataFrame, lens: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of a lens and the edges among them (FI3)."""
    kept = nodes.filter(F.array_contains(node_lenses(), lens))
    return kept, g.induced(kept, edges)


def scope_nodes(nodes: DataFrame, edges: DataFrame, scope: str, rules: dict[str, list] = SCOPES) -> DataFrame:
    """Files of a scope, their symbols, and communities that hold one of the files or lie in the scope themselves (FI5)."""
    by_path = nodes.filter(F.col("kind").isin("code_file", "community") & F.array_contains(matched(F.col("path"), rules), scope)).select("id", "kind")
    files = by_path.filter("kind = 'code_file'").select(F.col("id").alias("file"))
    member, kinds = edges.filter("kind = 'belongs_to'"), nodes.select("id", "kind")
    member = member.select("src", "dst")
    of = lambda kind: kinds.filter(F.col("kind") == kind)
    symbols = member.join(files, F.col("dst") == F.col("file")).select(F.col("src").alias("id")).join(of("symbol"), "id", "left_semi")
    homes = member.join(files, F.col("src") == F.col("file")).select(F.col("dst").alias("id")).join(of("community"), "id", "left_semi")
    return by_path.select("id").unionByName(symbols).unionByName(homes).distinct()


# --- kinds of nodes and edges ----------------------------------------------------------------------------------------

def is_test() -> Column:
    """By kind or by path (FI10)."""
    path = F.lower(F.regexp_replace(shown(), r"\\", "/"))
    return (F.col("kind") == "test") | path.rlike(TEST_PATH) | path.rlike(r"\.tests\.") | path.contains("tests/")


def is_low_value_bridge() -> Column:
    """Nodes that connect without meaning: containers, namespaces and outside symbols (FI11)."""
    kind, label = F.col("kind"), F.lower("label")
    root = (kind == "project") & ((F.col("label") == "workspace-root") | F.col("path").eqNullSafe("."))
    return kind.isin("workspace", "package", "directory", "community", "god_node") | root | ((kind == "symbol") & label.rlike(r"\((namespace|external)\)"))


def is_eligible(*, tests: bool = False, docs: bool = False) -> Column:
    """Nodes that a reader may be sent to first (FI8)."""
    kinds = ["symbol", "code_file", "community", "config_file", *(["test"] if tests else []), *(DOC_KINDS if docs else [])]
    path = F.regexp_replace(shown(), r"\\", "/")
    return F.col("kind").isin(*kinds) & ~path.rlike(f"(?i){GENERATED}") & ~F.lower(shown()).contains("(external)")


def guidance_bucket() -> Column:
    """The part that a node plays for a reader, by the first rule that holds (FI9)."""
    kind, label, text = F.col("kind"), F.lower("label"), F.lower(F.concat_ws(" ", "label", "path"))
    path = F.lower(F.regexp_replace(shown(), r"\\", "/"))
    test = (kind == "test") | path.rlike(TEST_PATH) | path.rlike(r"\.tests\.")
    start = r"viewmodel|controller|\bmain\b|program|startup|appdelegate|service|adapter|repository"
    return (
        F.when(test, "related_tests").when(kind.isin(*DOC_KINDS), "supporting_docs").when(kind == "config_file", "operational_config")
        .when((kind == "symbol") & label.contains("(interface)"), "public_contracts")
        .when((kind == "symbol") & label.rlike(CLASS_LABEL) & label.rlike(start + "|entrypoint|manager|provider"), "start_with")
        .when((kind == "code_file") & text.rlike(start), "start_with").otherwise("core_implementation"))


def guidance_score(degree: Column, mode: str = "balanced", *, tests: bool = False) -> Column:
    """Lower is read earlier: by kind and name, by the mode of the question, and by degree (SEA15)."""
    kind, label, text = F.col("kind"), F.lower("label"), F.lower(F.concat_ws(" ", "label", "path"))
    path = F.lower(F.regexp_replace(shown(), r"\\", "/"))
    test = (kind == "test") | path.rlike(TEST_PATH) | path.rlike(r"\.tests\.")
    like = label.rlike(CLASS_LABEL)
    symbol = (
        F.when(like & label.rlike("mainviewmodel|main-view-model"), 0).when(like & label.rlike("viewmodel|view-model"), 1)
        .when(like & label.rlike(r"controller|entrypoint|\bmain\b|program|startup|appdelegate"), 2).when(like & label.rlike("service|adapter|manager|provider|repository"), 3)
        .when(like, 4).when(label.rlike(r"viewmodel|controller|entrypoint|\bmain\b|service|adapter"), 5).otherwise(8))
    file = (
        F.when(text.rlike("mainviewmodel|main-view-model"), 6).when(text.rlike(r"viewmodel|view-model|controller|\bmain\b|program|startup|appdelegate"), 7)
        .when(text.rlike("service|adapter|manager|provider|repository"), 8).when(shown().rlike(SOURCE_ENDINGS), 9).otherwise(10))
    base = F.when(kind == "symbol", symbol).when(kind == "code_file", file).when(kind == "community", 10).when(kind == "config_file", 11).otherwise(12)
    by_mode = {"code": F.when(kind.isin(*DOC_KINDS), 8).when(test, 6).otherwise(0), "docs": F.when(kind.isin(*DOC_KINDS), -2).when(test, 4).otherwise(2)}.get(mode, F.lit(0))
    central = F.when((degree >= 3) & kind.isin("symbol", "code_file"), -F.least(F.lit(3), F.floor(degree / 4))).otherwise(0)
    score = base + by_mode + central
    return (score if tests or mode == "docs" else F.when(test, 80).otherwise(score)).cast("long")


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(g.degree(edges).select("id", "degree"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def read_first(nodes: DataFrame, edges: DataFrame, k: int = 8, mode: str = "balanced") -> DataFrame:
    """The k nodes to read first: by score, then path, then label (TK4, TK5)."""
    scored = with_degree(nodes.filter(is_eligible()), edges).withColumn("score", guidance_score(F.col("degree"), mode))
    return scored.orderBy("score", shown(), "label", "id").limit(k)


def relation() -> Column:
    """What a path calls an edge's relation: the scanner's name, put right, or the edge's kind (SC8)."""
    raw = F.coalesce("relation", "kind")
    return F.coalesce(lookup(RELATIONS, raw), raw)


def extracted_kind(name: Column) -> Column:
    """The edge kind of a relation's name in extraction; null for names that are none (SC9)."""
    name = F.lower(F.trim(name))
    return lookup(EDGE_KINDS, F.coalesce(lookup(ALIASES, name), name))


def is_semantic_edge() -> Column:
    """Edges that a semantic path may use (FI13)."""
    kinds = F.col("kind").isin("references", "depends_on", "implements", "inherits", "tests", "declares")
    return F.col("provenance").isin("extracted", "manual") & (kinds | relation().isin("belongs_to", "declares"))


def edge_class() -> Column:
    """semantic or structural, by relation, then by kind (GR21)."""
    r, kind = relation(), F.col("kind")
    return (
        F.when(r.isin("belongs_to", "declares", "inherits", "implements", "contains", "constructor", "source_file", "project_reference", "using_directive"), "structural")
        .when(r.isin("calls", "references", "depends_on", "uses", "route_to_handler", "tests", "asset_references"), "semantic")
        .when(kind.isin("belongs_to", "declares", "inherits", "implements", "contains"), "structural")
        .when(kind.isin("calls", "references", "depends_on", "uses", "tests", "documents"), "semantic").otherwise("structural"))


def resolved_confidence(provenance: str = "provenance", given: str = "confidence") -> Column:
    """The given confidence within 0 and 1, or the provenance's own (SC22)."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(given))), lookup(CONFIDENCE, F.col(provenance)))


def finalized(edges: DataFrame, scanner_source: Column) -> DataFrame:
    """Edges with their source (the scanner's where they have none) and confidence (CO11)."""
    return edges.withColumn("source", F.coalesce("source", scanner_source)).withColumn("confidence", resolved_confidence())


# --- summaries -------------------------------------------------------------------------------------------------------

def edge_sources(edges: DataFrame) -> DataFrame:
    """Edges by the source that they were derived from, known ones only (AG9)."""
    return edges.filter(F.col("source").isin(*SOURCES)).groupBy("source").agg(F.count("*").alias("edges"))


def between_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges without a community at either end."""
    homes = nodes.filter("kind = 'community'").select("id")
    return edges.join(homes.withColumnRenamed("id", "src"), "src", "left_anti").join(homes.withColumnRenamed("id", "dst"), "dst", "left_anti").select(edges.columns)


def needs_confidence() -> Column:
    return F.col("provenance").isin("inferred", "ambiguous")


def provenance_coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The share of such edges that say where they come from and, if they must, how sure they are (AG28)."""
    full = F.col("provenance").isNotNull() & F.col("source").isNotNull() & (~needs_confidence() | F.col("confidence").isNotNull())
    return between_members(nodes, edges).agg(F.coalesce(F.avg(full.cast("double")), F.lit(1.0)).alias("coverage"), F.count("*").alias("edges"))


def provenance_gate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The ids of edges that lack something, by what they lack (GA3)."""
    lack = F.array_compact(F.array(
        F.when(F.col("provenance").isNull(), "provenance"), F.when(F.coalesce(~F.col("source").isin(*SOURCES), F.lit(True)), "source"),
        F.when(needs_confidence() & F.col("confidence").isNull(), "confidence")))
    return between_members(nodes, edges).select("id", F.explode(lack).alias("missing"))


def lens_summaries(nodes: DataFrame, k: int = 5) -> DataFrame:
    """Of each lens (and of all): nodes, files, symbols, communities and its first k paths (AG10)."""
    each = nodes.select("kind", shown().alias("shown"), F.explode(F.concat(F.array(F.lit("all")), node_lenses())).alias("lens"))
    n = lambda *kinds: F.count(F.when(F.col("kind").isin(*kinds), 1))
    counts = each.groupBy("lens").agg(F.count("*").alias("nodes"), n("code_file", "config_file").alias("files"), n("symbol").alias("symbols"), n("community").alias("communities"))
    paths = each.filter(F.col("kind").isin("code_file", "config_file", "symbol")).select("lens", "shown").distinct()
    first = paths.withColumn("k", F.row_number().over(Window.partitionBy("lens").orderBy("shown"))).filter(F.col("k") <= k)
    top = first.groupBy("lens").agg(F.array_join(F.sort_array(F.collect_list("shown")), "|").alias("top_paths"))
    return counts.join(top, "lens", "left")


def recommended_lens(nodes: DataFrame) -> DataFrame:
    """The lens with most files and symbols, the smaller name of two (AG11)."""
    found = lens_summaries(nodes, 0).filter("lens <> 'all' AND files + symbols > 0")
    return found.orderBy(F.desc(F.col("files") + F.col("symbols")), "lens").limit(1).select("lens")


def graph_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: extracted share in percent, symbols, files, communities, files without any edge (AG12)."""
    n = lambda *kinds: F.count(F.when(F.col("kind").isin(*kinds), 1))
    alone = g.orphans(nodes.filter("kind IN ('code_file', 'config_file')"), edges).agg(F.count("*").alias("orphan_files"))
    share = F.floor(100 * F.coalesce(F.avg((F.col("provenance") == "extracted").cast("double")), F.lit(0.0)) + 0.5).cast("long").alias("extracted_percent")
    counts = nodes.agg(n("symbol").alias("symbols"), n("code_file", "config_file").alias("files"), n("community").alias("communities"))
    return counts.crossJoin(edges.agg(share)).crossJoin(alone)  # single rows


def _doc_file() -> Column:
    return F.when(F.col("node_kind") == "doc_file", shown()).otherwise(F.coalesce("source_file", "path", F.lit("")))


def docs_hubs(nodes: DataFrame, edges: DataFrame, k: int = 8) -> DataFrame:
    """Documentation files by sections, links and links to code (AG13)."""
    sections = nodes.filter("kind = 'doc_section'").groupBy(F.coalesce("path", "source_file").alias("path")).agg(F.count("*").alias("sections"))
    docs = nodes.filter(F.col("kind").isin(*DOC_KINDS)).select(F.col("id").alias("src"), F.col("kind").alias("node_kind"), "path", "label", "source_file")
    out = edges.join(docs, "src").withColumn("path", _doc_file()).groupBy("path").agg(
        F.count(F.when((F.col("kind") == "references") | F.coalesce(F.col("relation").isin("doc_link", "doc_wikilink"), F.lit(False)), 1)).alias("links"),
        F.count(F.when((F.col("kind") == "documents") | F.col("relation").eqNullSafe("doc_code_ref"), 1)).alias("code_links"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    files = nodes.filter("kind = 'doc_file'").select(shown().alias("path"), "label").join(sections, "path", "left").join(out, "path", "left")
    return files.select("path", "label", zero("sections"), zero("links"), zero("code_links")).orderBy(F.desc(F.col("sections") + F.col("links") + F.col("code_links")), "path").limit(k)


def docs_to_code(nodes: DataFrame, edges: DataFrame, k: int = 12) -> DataFrame:
    """The first k links from documentation to code (RE5)."""
    end = lambda c: nodes.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    said = edges.filter("kind = 'documents' OR relation = 'doc_code_ref'").join(end("src"), "src").join(end("dst"), "dst")
    return said.select("id", "src_label", "dst_label", F.concat_ws("/", "provenance", F.coalesce("source", F.lit("docs"))).alias("provenance")).orderBy("src_label", "dst_label", "id").limit(k)


def unlinked_docs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Documentation files without an outgoing link (RE5)."""
    docs = nodes.filter(F.col("kind").isin(*DOC_KINDS)).select(F.col("id").alias("src"), F.col("kind").alias("node_kind"), "path", "label", "source_file")
    linked = edges.filter("kind IN ('references', 'documents')").join(docs, "src").select(_doc_file().alias("path")).distinct()
    return nodes.filter("kind = 'doc_file'").select(shown().alias("path")).distinct().join(linked, "path", "left_anti")


# --- search ----------------------------------------------------------------------------------------------------------

def words(text: str) -> str:
    """Lower case, runs of other characters than letters and digits as one space."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower())


def tokens(text: str) -> list[str]:
    """The words of two or more letters (SEA1)."""
    return [w for w in words(text).split() if len(w) > 1]


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def _total(parts) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def token_array(query: Column) -> Column:
    """The words of two or more letters or digits of a query column (SEA1)."""
    return F.filter(F.split(_normal(query), " "), lambda w: F.length(w) > 1)


def haystack() -> Column:
    """A node's fields as words, in which a query's words are looked up."""
    return _normal(F.concat_ws(" ", "id", "kind", "label", F.coalesce("path", F.lit("")), F.coalesce("slug", F.lit("")), F.coalesce("parent", F.lit("")), F.coalesce("source_file", F.lit(""))))


def _held(asked: Column, hay: Column, times: int = 1) -> Column:
    """The lengths of the words that hay holds, so many times; hay is made once, not for every word."""
    start = F.struct(F.lit(0).alias("n"), hay.alias("hay"))
    add = lambda at, w: F.struct((at["n"] + F.when(at["hay"].contains(w), F.length(w) * times).otherwise(0)).alias("n"), at["hay"].alias("hay"))
    return F.aggregate(asked, start, add, lambda at: at["n"])


def overlap(asked: Column) -> Column:
    """The lengths of all words that a node's fields hold as substrings, repeated words counted each time (SEA2)."""
    return _held(asked, haystack())


def section_score(asked: Column) -> Column:
    """Three times the lengths of the words that a documentation section holds (SEA12)."""
    hay = F.lower(F.concat_ws(" ", "label", F.coalesce("path", F.lit("")), F.coalesce("slug", F.lit("")), F.coalesce("parent", F.lit(""))))
    return F.when(F.col("kind") == "doc_section", _held(asked, hay, 3)).otherwise(0)


def query_shape(query: Column) -> Column:
    """code_oriented, docs_oriented or ambiguous (SEA7)."""
    code, docs = query.rlike(CODE_QUERY), query.rlike(DOCS_QUERY) | query.rlike(DOCS_ASKED)
    return F.when(code & docs, "ambiguous").when(docs, "docs_oriented").when(code, "code_oriented").otherwise("ambiguous")


def effective_mode(query: Column, requested: Column) -> Column:
    """The requested mode; balanced follows the query's shape (SEA8)."""
    shape = query_shape(query)
    return F.when(requested != "balanced", requested).when(shape == "docs_oriented", "docs").when(shape == "code_oriented", "code").otherwise("balanced")


def intent_ranked(nodes: DataFrame, query: str, requested: str = "balanced") -> DataFrame:
    """Nodes that hold words of the query, with score, penalties and surface, the order's first key (SEA9, SEA10)."""
    return ranked_for(nodes.withColumns({"query": F.lit(query), "requested": F.lit(requested)})).drop("query", "requested")


def ranked_for(rows: DataFrame) -> DataFrame:
    """The same for rows of nodes that each have a query and a requested mode of their own."""
    columns = rows.columns
    q, kind, label = F.col("query"), F.col("kind"), F.lower(F.concat_ws(" ", "label", F.coalesce("path", F.lit(""))))
    code, doc, asked = kind.isin(*CODE_KINDS), kind.isin(*DOC_KINDS), F.col("asked_")
    rows = rows.withColumns({"asked_": token_array(q), "mode": effective_mode(q, F.col("requested")), "shape": query_shape(q)})
    raw = F.when(kind == "doc_section", F.greatest(overlap(asked), section_score(asked))).otherwise(overlap(asked))
    rows = rows.withColumn("raw", raw).filter("raw > 0")
    boosted = doc & ((F.col("mode") == "docs") | ((F.col("mode") == "balanced") & q.rlike(DOCS_ASKED)))
    base = F.col("raw") + F.when(boosted, 40).otherwise(0)
    docs_home = (kind == "community") & F.col("label").rlike(r"(?i)\bdocs?\b")
    only_words = (F.size(asked) > 0) & F.forall(asked, lambda w: label.contains(w)) & ~F.col("label").rlike("(?i)(class|interface|service|controller|section|guide|architecture)")
    in_code = F.when(code, 20).otherwise(0) - F.when(doc, 30).otherwise(0) - F.when(docs_home, 15).otherwise(0)
    in_docs = F.when(doc, 25).otherwise(0) + F.when(code, 5).otherwise(0)
    docs_shape, code_shape = F.col("shape") == "docs_oriented", F.col("shape") == "code_oriented"
    mixed = (
        F.when(code, F.when(docs_shape, 6).otherwise(12)).otherwise(0) + F.when(doc, F.when(code_shape, 2).otherwise(10)).otherwise(0)
        - F.when(~docs_shape & doc, 10).otherwise(0) - F.when(only_words, 6).otherwise(0))
    mode = F.col("mode")
    penalties = F.array_compact(F.array(
        F.when((mode == "code") & doc, "doc_surface_penalty"), F.when((mode == "code") & docs_home, "documentation_community_penalty"),
        F.when((mode == "balanced") & ~docs_shape & doc, "doc_surface_balanced_penalty"), F.when((mode == "balanced") & only_words, "keyword_only_penalty")))
    surface = (
        F.when(mode == "code", F.when(code, 0).when(doc, 1).otherwise(2)).when(mode == "docs", F.when(doc, 0).when(code, 1).otherwise(2)).otherwise(0))
    score = F.greatest(F.lit(1), base + F.when(mode == "code", in_code).when(mode == "docs", in_docs).otherwise(mixed))
    return rows.select(*columns, "mode", "shape", surface.alias("surface"), score.cast("long").alias("score"), penalties.alias("penalties"))


def holding(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Nodes with each query (query_id, query, ...) of which they hold a word: one pass over the nodes for all queries.

    Few words are looked up in every node. Of many a word's first three letters (two, if it has no more) are its key in an index
    of the nodes' letters; only letters that some query asks for leave the scan, and a key alone is no match.
    """
    words_ = queries.select("query_id", F.explode(F.array_distinct(token_array(F.col("query")))).alias("word")).withColumn("gram", F.substring("word", 1, 3))
    words_ = kept(words_, "query_words")
    hay = nodes.select("id", haystack().alias("hay"))
    n = words_.count()
    if n <= FEW_WORDS:
        pairs = hay.join(F.broadcast(words_), F.col("hay").contains(F.col("word"))).select("id", "query_id").distinct()
        return nodes.hint("merge").join(pairs, "id").join(queries, "query_id")
    at = F.sequence(F.lit(1), F.greatest(F.length("hay") - 1, F.lit(1)))
    grams = F.array_distinct(F.concat(F.transform(at, lambda i: F.substring("hay", i, F.lit(3))), F.transform(at, lambda i: F.substring("hay", i, F.lit(2)))))
    pairs = hay.select("id", "hay", F.explode(grams).alias("gram")).join(sided(words_, n), "gram").filter(F.col("hay").contains(F.col("word"))).select("id", "query_id").distinct()
    # merged: the nodes' files are far smaller than their rows, which the driver can't hold
    return nodes.hint("merge").join(pairs, "id").join(queries, "query_id")


def seeds(nodes: DataFrame, query: str, k: int = 5, requested: str = "balanced") -> DataFrame:
    """The k best nodes with their place; documentation is mixed in where it is asked for or symbols are few (SEA6)."""
    one = nodes.withColumns({"query_id": F.lit(0), "query": F.lit(query), "requested": F.lit(requested)})
    return _seeds(one, nodes, k).drop("query_id", "query", "requested")


def seeds_of(nodes: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The seeds of every query (query_id, query, requested) at once (SEA6, SEA21)."""
    return _seeds(holding(nodes, queries), nodes, k)


def _seeds(rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    ranked = ranked_for(rows)
    few = nodes.filter("kind = 'symbol'").limit(4).count()  # four rows at most
    order = ("surface", F.desc("score"), "label", "id")
    best = Window.partitionBy("query_id").orderBy(*order)
    doc = F.col("kind").isin(*DOC_KINDS)
    # a query's best k, and of documentation its best few; both are cut before the shuffle
    first = ranked.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).withColumn("turn", F.lit(0))
    docs = ranked.filter(doc).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= max(2, k // 2)).withColumn("turn", F.lit(1))
    mine = Window.partitionBy("query_id")
    rows = first.unionByName(docs).withColumns({
        "symbols_": F.max(F.when(F.col("turn") == 0, (F.col("kind") == "symbol").cast("int"))).over(mine), "mode_": F.max("mode").over(mine)})
    sparse = F.lit(few <= 3) | (F.col("symbols_") == 0)
    plain = F.col("mode_").isin("code", "balanced") & ~sparse & ~F.col("query").rlike(DOCS_ASKED)
    rows = rows.filter((F.col("turn") == 0) | ~plain)
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("turn"))).filter("again = 1")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "place"))).filter(F.col("place") <= k).select(*ranked.columns, "place")


def intent_summary(found: DataFrame, query: str, requested: str = "balanced") -> DataFrame:
    """One row about the seeds: modes, penalties, kinds, counts and whether the other surface had to do (SEA11)."""
    code, doc = F.col("kind").isin(*CODE_KINDS), F.col("kind").isin(*DOC_KINDS)
    out = found.agg(
        F.count(F.when(code, 1)).alias("code_results"), F.count(F.when(doc, 1)).alias("doc_results"), F.min_by("kind", "place").alias("top_kind"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "kind"))), lambda x: x["kind"]), ",").alias("kinds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("penalties")))).alias("p"))
    asked, mode, shape = F.lit(requested), effective_mode(F.lit(query), F.lit(requested)), query_shape(F.lit(query))
    fallback = F.when(asked == "code", (F.col("code_results") == 0) & (F.col("doc_results") > 0)).when(asked == "docs", (F.col("doc_results") == 0) & (F.col("code_results") > 0)).otherwise(False)
    reason = (
        F.when((mode == "code") & F.col("top_kind").isin(*CODE_KINDS), "Code mode prioritized code symbols and source files.")
        .when((mode == "docs") & F.col("top_kind").isin(*DOC_KINDS), "Docs mode prioritized documentation sections and files.")
        .when((mode == "balanced") & F.col("top_kind").isNotNull() & (shape == "ambiguous"), "Balanced mode mixed code and documentation evidence.")
        .when((mode == "balanced") & F.col("top_kind").isNotNull(), F.concat(F.lit("Balanced mode inferred "), F.regexp_replace(shape, "_", " "), F.lit(" query shape.")))
        .otherwise("Matched query tokens with intent-aware ranking."))
    penalties = F.array_join(F.when(fallback, F.array_sort(F.array_append("p", F.lit("fallback_surface")))).otherwise(F.col("p")), ",")
    return out.select(mode.alias("mode"), shape.alias("shape"), penalties.alias("penalties"), fallback.alias("fallback"), reason.alias("reason"), "kinds", "code_results", "doc_results")


def looks_like_file(query: str) -> bool:
    """Whether a query ends as a source file does (SEA4)."""
    name = [p for p in query.strip().replace("\\", "/").lower().split("/") if p][-1:]
    ending = name[0].rsplit(".", 1)[-1] if name else ""
    return len(ending) >= 2 and ending in FILE_ENDINGS


def is_file_query(said: Column) -> Column:
    """The same for a column of trimmed lower-case queries with forward slashes."""
    ending = F.substring_index(F.regexp_extract(said, "([^/]+)/*$", 1), ".", -1)
    return (F.length(ending) >= 2) & ending.isin(*FILE_ENDINGS)


def resolution(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes with the score and the reason by which a query names them; those above zero are candidates (SEA3)."""
    return resolved_for(nodes.withColumn("query", F.lit(query))).drop("query")


def resolved_for(rows: DataFrame) -> DataFrame:
    """The same for rows of nodes that each have a query of their own."""
    columns = rows.columns
    trimmed = F.regexp_replace("query", r"^\s+|\s+$", "")
    rows = rows.withColumn("said_q", F.lower(F.regexp_replace(trimmed, r"\\", "/")))
    file_of = is_file_query(F.col("said_q"))
    rows = rows.withColumns({
        "asked_": token_array(F.col("query")), "text_": _normal(F.col("query")), "file_": file_of, "simple_": trimmed.rlike("^[A-Za-z_][A-Za-z0-9_]*$"),
        "stem_": F.when(file_of, token_array(F.regexp_replace(F.regexp_extract("said_q", "([^/]*)$", 1), r"\.[^.]*$", ""))).otherwise(F.array().cast("array<string>"))})
    asked, said, text, file_query, simple, stem = (F.col(x) for x in ("asked_", "said_q", "text_", "file_", "simple_", "stem_"))
    kind, label, low = F.col("kind"), F.col("label"), F.lower("label")
    path = F.lower(F.regexp_replace(F.coalesce("path", F.lit("")), r"\\", "/"))
    base = F.lower(F.regexp_extract(F.regexp_replace(shown(), r"\\", "/"), "([^/]*)/*$", 1))
    no = F.lit(False)
    score = overlap(F.when(file_query, stem).otherwise(asked))
    reason = F.when(score > 0, "token overlap").otherwise("no match")
    named = (base == said) & (base != "")
    suffix, equal, prefix = ~named & path.endswith(F.concat(F.lit("/"), said)), low == said, (low != said) & low.startswith(F.concat(said, F.lit(" ")))
    hit = named | suffix | equal | prefix
    by_stem = (F.size(stem) > 0) & F.forall(stem, lambda w: base.contains(w) | path.contains(w))
    aligned = hit | (path == said) | by_stem
    head = F.trim(F.regexp_extract(label, r"^([^(]*)", 1))
    name, owner = _normal(F.regexp_extract(head, r"([^.]*)$", 1)), _normal(F.trim(F.regexp_extract(label, r"^([^.]*)", 1)))
    file_stem = _normal(F.regexp_replace(base, r"\.[^.]+$", ""))
    section = _normal(F.regexp_replace(label, r"(?i)\s*\(doc_section\)\s*$", ""))
    symbol, file = kind == "symbol", kind == "code_file"
    space, cls, face, call = symbol & low.contains("(namespace)"), symbol & label.contains("(class)"), symbol & label.contains("(interface)"), symbol & low.rlike(r"\((function|method)\)")
    root = (kind == "workspace") | ((kind == "project") & ((label == "workspace-root") | F.col("path").eqNullSafe(".")))
    steps: list[Column] = []

    def step(on: Column, add: int | Column = 0, why: str | None = None, *, most: int | None = None, only: str | None = None) -> None:
        """Where ``on`` holds: adds, cuts the score at ``most``, and gives the reason (only to scores that are positive, or not)."""
        steps.append(F.struct(
            F.coalesce(on, no).alias("on"), (add if isinstance(add, Column) else F.lit(add)).cast("int").alias("add"), F.lit(why).cast("string").alias("why"), F.lit(most).cast("int").alias("most"), F.lit(only).cast("string").alias("only")))

    step(named, 2000, "path basename")
    step(suffix, 1500, "path suffix")
    step(equal, 1200, "exact label")
    step(prefix, 1000, "label prefix")
    step(file_query & ~aligned, -1_000_000, "no match", most=0)
    step(file_query & file & aligned & ~hit, 0, "filename token", only="positive")
    step(space, -2500)
    step(simple & space & (_normal(head) != text), 0, "namespace penalty", most=0)
    step(cls & (name == text), 3200, "class name exact")
    step(cls & (name != text) & _normal(label).startswith(F.concat(text, F.lit(" "))), 900, "class symbol")
    step(face & (name == text), 1200, "interface name")
    step(simple & face, -1500)
    step(simple & face, 0, "interface penalty", only="rest")
    step(simple & symbol & low.rlike(r"\((field|property)\)") & (owner == text), -2800, "field penalty")
    step(file_query & call, -1800)
    step(file_query & call, 0, "inner callable", only="positive")
    step(~F.col("query").rlike("[._]") & symbol & low.rlike(r"\((field|method|property)\)|\.|_"), -250)
    step(file_query & file & aligned, 4500, "code file path")
    step(simple & file & (file_stem != text), -400)
    in_section = _held(asked, section, 4)
    step((kind == "doc_section") & (in_section > 0), in_section, "doc section")
    step((kind == "doc_section") & path.contains(said), 300)
    step(~file_query & (kind == "doc_file") & F.exists(asked, lambda w: file_stem.contains(w)), 250, "doc file")
    step(root, -500)

    def take(at: Column, x: Column) -> Column:
        # "no match" sets the score to zero: a cut at zero from below and above
        score = at["score"] + x["add"]
        score = F.when(x["most"].isNull(), score).when(x["add"] < -100_000, F.lit(0)).otherwise(F.least(score, x["most"]))
        says = x["why"].isNotNull() & (x["only"].isNull() | ((x["only"] == "positive") & (score > 0)) | ((x["only"] == "rest") & (score <= 0)))
        return F.when(x["on"], F.struct(score.cast("int").alias("score"), F.when(says, x["why"]).otherwise(at["reason"]).alias("reason"))).otherwise(at)

    # one fold over the steps, so that the expression grows with their number only
    start = F.struct(score.cast("int").alias("score"), reason.alias("reason"))
    rows = rows.withColumn("said_", F.aggregate(F.array(*steps), start, take))
    # an exact id or path counts for itself
    own_id, own_path = F.lower("id") == F.lower(trimmed), path == said
    exact = F.when(own_id, 10_000).when(own_path, 9_000)
    why = F.when(own_id, "exact node id").when(own_path, "exact path")
    return rows.select(*columns, F.coalesce(exact, F.col("said_.score")).cast("long").alias("score"), F.coalesce(why, F.col("said_.reason")).alias("reason"))


def candidates(nodes: DataFrame, query: str, k: int = 5) -> DataFrame:
    """The k nodes that a query names best (WI7, SEA5)."""
    return resolution(nodes, query).filter("score > 0").orderBy(F.desc("score"), "label", "id").limit(k)


def candidates_of(nodes: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k nodes that each query (query_id, query) names best, with their place (WI7, SEA5, SEA21).

    A node can only be named by a query of which it holds a word; a query without words meets every node.
    """
    wordless = queries.filter(F.size(token_array(F.col("query"))) == 0)
    rows = holding(nodes, queries).unionByName(nodes.crossJoin(F.broadcast(wordless)).select("query_id", *nodes.columns, *[x for x in queries.columns if x != "query_id"]))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "label", "id")
    return resolved_for(rows).filter("score > 0").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def path_intent(from_kind: Column, to_kind: Column) -> Column:
    """What a path between two kinds is for (SEA13)."""
    code, doc = lambda k: k.isin(*CODE_KINDS), lambda k: k.isin(*DOC_KINDS)
    return (
        F.when(doc(from_kind) & doc(to_kind), "doc_to_doc").when((doc(from_kind) & code(to_kind)) | (code(from_kind) & doc(to_kind)), "doc_to_code")
        .when(code(from_kind) & code(to_kind), "code_to_code").otherwise("mixed_or_unknown"))
