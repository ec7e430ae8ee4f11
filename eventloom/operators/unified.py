"""A workspace's profile from its files (types, source roots, scanners, warnings), and the unified graph of its product items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators import versions
from eventloom.operators.code import lookup
from eventloom.session import kept

# Types by the name of a marker file, by a pattern of it, and by a file's ending; points; scanners by type.
MARKER_FILES = {
    "package.json": "node", "tsconfig.json": "typescript", "tsconfig.base.json": "typescript", "pnpm-workspace.yaml": "node", "cargo.toml": "rust", "go.mod": "go", "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java",
    "requirements.txt": "python", "pyproject.toml": "python", "manage.py": "django-app", ".terraform.lock.hcl": "terraform-iac", "gemfile": "rails-app", "rakefile": "ruby-app", "package.swift": "swift-package", "pubspec.yaml": "dart-package",
    "cmakelists.txt": "cpp-cmake", "makefile": "c-embedded", "meson.build": "cpp-meson", "compile_commands.json": "cpp", "composer.json": "php-app", "artisan": "laravel-app", "symfony.lock": "symfony-app", "settings.gradle": "java-gradle",
    "settings.gradle.kts": "kotlin-gradle", "project.godot": "godot-project"}
MARKER_PATTERNS = {
    r"^tsconfig(?:[.-].*)?\.json$": "typescript", r"^next\.config\.(?:js|mjs|cjs|ts)$": "next-app", r"\.csproj$": "dotnet", r"\.sln$": "dotnet", r"\.tf$": "terraform-iac", r"\.gemspec$": "ruby-gem", r"project\.pbxproj$": "ios-xcode",
    r"\.vcxproj$": "cpp-msvc", r"wp-config\.php$": "wordpress-plugin", r"\.asmdef$": "unity-app", r"\.uproject$": "unreal-project", r"\.uplugin$": "unreal-plugin"}
ENDING_TYPES = {
    ".cs": "dotnet", ".csproj": "dotnet", ".sln": "dotnet", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".rs": "rust", ".go": "go", ".java": "java", ".kt": "java",
    ".rb": "ruby", ".rake": "ruby", ".php": "php", ".phtml": "php", ".swift": "swift", ".dart": "dart", ".c": "cpp", ".cc": "cpp", ".cpp": "cpp", ".h": "cpp", ".hpp": "cpp", ".gd": "godot-project", ".tscn": "godot-project", ".tres": "godot-project",
    ".unity": "unity-app", ".prefab": "unity-app", ".py": "python", ".tf": "terraform-iac", ".tfvars": "terraform-iac", ".ps1": "shell-automation", ".sh": "shell-automation", ".bash": "shell-automation"}
MARKER_POINTS, NEAR_POINTS, ENDING_POINTS = 12, 6, 4
SCANNERS = {
    "typescript": ("typescript", "javascript", "node", "next-app"), "dotnet": ("dotnet",), "python": ("python", "django-app"), "go": ("go",), "rust": ("rust",), "terraform": ("terraform-iac",), "java": ("java", "java-gradle", "kotlin-gradle"),
    "ruby": ("ruby", "ruby-app", "rails-app", "ruby-gem"), "php": ("php", "php-app", "laravel-app", "symfony-app", "wordpress-plugin"), "swift": ("swift", "swift-package", "ios-xcode"), "cpp": ("cpp", "cpp-cmake", "c-embedded", "cpp-msvc", "cpp-meson"),
    "flutter": ("dart", "dart-package"), "unity": ("unity-app",), "unreal": ("unreal-project", "unreal-plugin"), "godot": ("godot-project",)}
DOC_ENDINGS, CONFIG_ENDINGS = ("md", "rst", "txt"), ("json", "yaml", "yml", "toml", "csproj", "sln", "props", "targets")


def marker_hits(files: DataFrame) -> DataFrame:
    """path, marker, type, depth of the files that mark a project (EX1)."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    low, type_ = F.lower(name), F.when(F.col("path").endswith("ProjectSettings/ProjectVersion.txt"), "unity-app")
    type_ = F.coalesce(type_, lookup(MARKER_FILES, low))
    for pattern, what in MARKER_PATTERNS.items():
        type_ = F.coalesce(type_, F.when(low.rlike(pattern), what))
    return files.select("path", name.alias("marker"), type_.alias("type"), (F.size(F.split("path", "/")) - 1).alias("depth")).filter("type IS NOT NULL")


def type_signals(files: DataFrame) -> DataFrame:
    """type, confidence, markers (how many different ones): points of markers, more near the top, and of files by their ending (EX1, AG26)."""
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    hits = marker_hits(files).select("type", "marker", (MARKER_POINTS + F.greatest(F.lit(0), NEAR_POINTS - F.col("depth"))).alias("points"))
    ends = files.select(lookup(ENDING_TYPES, ending).alias("type"), ending.alias("marker"), F.lit(ENDING_POINTS).alias("points")).filter("type IS NOT NULL")
    return hits.unionByName(ends).groupBy("type", "marker").agg(F.sum("points").alias("points")).groupBy("type").agg(F.sum("points").alias("confidence"), F.count("*").alias("markers"))


def detected_types(files: DataFrame) -> DataFrame:
    """type, confidence (null where nothing but the whole says so), is_primary: what a workspace is (EX1).

    Documentation alone, nothing at all, and more than one kind of code are types as well.
    """
    signals = kept(type_signals(files), "type_signals")
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    n = lambda x: F.count(F.when(x, 1))
    row = files.agg(n(ending.isin(*DOC_ENDINGS)).alias("docs"), n(lookup(ENDING_TYPES, F.concat(F.lit("."), ending)).isNotNull()).alias("code"), n(ending != "").alias("all")).first()
    named = signals.count()  # a type is one of the fixed values
    more = ["documentation-corpus"] if not row["code"] and row["docs"] >= 3 else []
    if not named and not more:
        more = ["empty-greenfield"] if not row["code"] and row["all"] < 3 else ["generic"]
    if named + len(more) > 1 and row["all"]:
        more.append("mixed-polyglot")
    first = signals.orderBy(F.desc("confidence"), "type").limit(1).collect()
    primary = first[0]["type"] if first else more[0]
    out = signals.select("type", "confidence").unionByName(files.sparkSession.createDataFrame([(t, None) for t in more], "type string, confidence long"))
    return out.withColumn("is_primary", F.col("type") == primary)


def active_scanners(types: DataFrame) -> DataFrame:
    """scanner_id of the scanners that some type calls for, generic where none does (EX1, EX2)."""
    by_type = types.sparkSession.createDataFrame([(s, t) for s, ts in SCANNERS.items() for t in ts], "scanner_id string, type string")
    found = kept(by_type.join(types, "type", "left_semi").select("scanner_id").distinct(), "scanners")
    return found if not found.isEmpty() else types.sparkSession.createDataFrame([("generic",)], "scanner_id string")


def source_roots(files: DataFrame) -> DataFrame:
    """root, place: the top, each folder of a marker and the first folder above it; where no marker lies at the top, the first folder of
    the shallowest marker comes first (EX1)."""
    hits = kept(marker_hits(files), "marker_hits")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    roots = hits.filter("depth > 0").select(F.explode(F.array(folder, F.regexp_extract("path", "^([^/]+)/", 1))).alias("root")).distinct()
    roots = roots.unionByName(files.sparkSession.createDataFrame([(".",)], "root string"))
    wrapper = wrapper_root(hits)
    turn = F.when(F.col("root") == wrapper, 0).otherwise(1) if wrapper and hits.limit(2).count() > 1 else F.lit(1)
    return versions.numbered(roots.withColumn("turn", turn), ["turn", "root"]).select("root", (F.col("seq") - 1).alias("place"))


def wrapper_root(hits: DataFrame) -> str | None:
    """The folder of the first of the shallowest markers, if none lies at the top."""
    first = hits.orderBy("depth", "path").limit(1).collect()
    return first[0]["path"].rpartition("/")[0] if first and first[0]["depth"] > 0 else None


def profile_warnings(files: DataFrame) -> list[str]:
    """What a reader of the profile should know (EX1)."""
    wrapper = wrapper_root(marker_hits(files))
    return [f"Wrapper layout detected; nested project markers concentrated under '{wrapper}/'."] if wrapper else []


def stable_id(prefix: str, raw: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.regexp_replace(raw, "[^A-Za-z0-9._:-]+", "-"))


def unified_graph(nodes: DataFrame, edges: DataFrame, roots: DataFrame, workspace: str, scanner: str, type_: str) -> tuple[DataFrame, DataFrame]:
    """The unified graph of product items (CO10): nodes and edges under ids of their own, a workspace, a project for each root, and every
    node in the first root, by place, that holds its path.

    nodes: id, kind, title, path, scanner_id, symbol_kind, community_label, community_path; edges: id, src, dst, kind, trust,
    label, relation, scanner_id; roots: root, place. Items of other kinds than code, and edges that have no counterpart, stay out.
    """
    text = lambda x: F.lit(x).cast("string")
    code = nodes.filter("kind IN ('code_file', 'code_symbol', 'code_community')")
    ending = F.lower(F.substring_index("title", ".", -1))
    kind = (
        F.when(F.col("kind") == "code_file", F.when(ending.isin(*DOC_ENDINGS), "doc_file").when(ending.isin(*CONFIG_ENDINGS), "config_file").otherwise("code_file"))
        .when(F.col("kind") == "code_symbol", F.when(F.col("symbol_kind") == "doc_section", "doc_section").otherwise("symbol")).otherwise("community"))
    path = F.coalesce(F.when(F.col("kind") == "code_community", F.col("community_path")), "path", "title")
    items = code.select(stable_id("node", F.col("id")).alias("id"), kind.alias("kind"), F.coalesce("community_label", "title").alias("label"), path.alias("path"), F.coalesce("scanner_id", text(scanner)).alias("scanner_id"), F.col("id").alias("product_id"))
    top = stable_id("workspace", text(workspace))
    whole = nodes.sparkSession.range(1).select(top.alias("id"), text("workspace").alias("kind"), text("workspace").alias("label"), text(".").alias("path"), text(None).alias("scanner_id"), text(None).alias("product_id"))
    is_top = F.col("root") == "."
    projects = roots.select(stable_id("project", F.col("root")).alias("id"), F.when(is_top, "project").otherwise("package").alias("kind"), F.when(is_top, "workspace-root").otherwise(F.col("root")).alias("label"), F.col("root").alias("path"), text(scanner).alias("scanner_id"), text(None).alias("product_id"))
    edge = lambda raw, src, dst, k, provenance, by, label=text(None), relation=text(None): (stable_id("edge", raw).alias("id"), src.alias("src"), dst.alias("dst"), k.alias("kind"), provenance.alias("provenance"), by.alias("scanner_id"), label.alias("label"), relation.alias("relation"))
    declares = roots.select(*edge(F.concat(stable_id("project", F.col("root")), F.lit("->workspace|declares")), top, stable_id("project", F.col("root")), text("declares"), text("extracted"), text("kernel")))
    # every folder above a path is a key; the top holds all, so it is no key but a place
    parts = F.split("path", "/")
    above = items.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("root")).join(roots, "root").groupBy("id").agg(F.min(F.struct("place", "root")).alias("near"))
    dot = roots.filter("root = '.'").select("place").first()
    near = F.col("near.root") if dot is None else F.when(F.col("near.place") < dot["place"], F.col("near.root"))
    home = items.select("id", "scanner_id").join(above, "id", "left").withColumn("root", F.coalesce(near, F.lit(".")))
    belongs = home.select(*edge(F.concat("id", F.lit("->"), "root", F.lit("|belongs_to")), F.col("id"), stable_id("project", F.col("root")), text("belongs_to"), text("extracted"), F.col("scanner_id")))
    to = F.when((F.col("kind") == "uses") & (F.col("relation") == "doc_code_ref"), "documents").otherwise(lookup({"belongs_to": "belongs_to", "depends_on": "depends_on", "implements": "implements", "extends": "inherits", "uses": "references"}, F.col("kind")))
    links = edges.withColumn("to_", to).filter("to_ IS NOT NULL").select(*edge(F.col("id"), stable_id("node", F.col("src")), stable_id("node", F.col("dst")), F.col("to_"), F.when(F.col("trust").isin("manual", "inferred", "ambiguous"), F.col("trust")).otherwise("extracted"), F.col("scanner_id"), F.col("label"), F.col("relation")))
    return whole.unionByName(projects).unionByName(items), declares.unionByName(belongs).unionByName(links)
