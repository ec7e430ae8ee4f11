"""Registered queries of symbol and import extraction and resolution, with SQL oracles: a source file for every part."""

from __future__ import annotations

from eventloom.operators import extract as x
from eventloom.plans.catalog import query
from eventloom.session import kept
from eventloom.sources import workspace as w

_K = "CAST(p_partkey AS VARCHAR(19))"
_P = "CAST(p_partkey - p_partkey % 16 + {0} AS VARCHAR(19))"
_N = " || chr(10) || "
#: By the number modulo 16: language, path, body.
_FILES = [
    ("python", f"'app/pk' || {_K} || '/mod' || {_K} || '.py'", f"'# note'{_N}'import os'{_N}'from app.pk' || {_K} || '.mod' || {_K} || ' import x'{_N}'class A' || {_K} || ':'{_N}'    def run(self):'{_N}'        pass'{_N}'async def top():'"),
    ("go", f"'cmd/t' || {_K} || '_test.go'", f"'package main'{_N}'import (' {_N}'\"fmt\"'{_N}')'{_N}'type S' || {_K} || ' struct {{'{_N}'func (s *S) Do() {{'{_N}'// func No()'"),
    ("rust", f"'src/r' || {_K} || '.rs'", f"'use std::io;'{_N}'pub mod m' || {_K} || ';'{_N}'pub struct R;'{_N}'impl R {{'{_N}'    pub async fn go(&self) {{'"),
    ("java", f"'src/main/java/shop/J' || {_K} || '.java'", f"'package shop;'{_N}'import shop.J' || {_K} || ';'{_N}'import java.util.*;'{_N}'public final class J' || {_K} || ' extends B {{'{_N}'  public static int sum(int a) {{'"),
    ("kotlin", f"'src/main/kotlin/shop/K' || {_K} || 'Test.kt'", f"'import shop.J' || {_P.format(3)}{_N}'data class K' || {_K} || '(val a: Int)'{_N}'  override fun show() {{'"),
    ("ruby", f"'lib/r' || {_K} || '.rb'", f"'require \"r' || {_K} || '\"'{_N}'require_relative \"./r' || {_K} || '\"'{_N}'module M' || {_K}{_N}'  class C'{_N}'    def self.build!'"),
    ("php", f"'src/App/P' || {_K} || '.php'", f"'namespace App;'{_N}'use App\\P' || {_K} || ';'{_N}'use Other\\Thing;'{_N}'final class P' || {_K} || ' {{'{_N}'  public static function make()'"),
    ("swift", f"'Sources/S' || {_K} || '.swift'", f"'import Foundation'{_N}'public struct S' || {_K} || ' {{'{_N}'  static func go() {{'"),
    ("csharp", f"'Src/C' || {_K} || '.cs'", f"'using System.Text;'{_N}'namespace Shop.Core'{_N}'  public sealed class C' || {_K}{_N}'  internal interface IThing'"),
    ("cpp", f"'src/c' || {_K} || '.cpp'", f"'#include \"c' || {_K} || '.cpp\"'{_N}'#include <vector>'{_N}'namespace n' || {_K} || ' {{'{_N}'class W : public B {{'{_N}'enum class E {{'"),
    ("dart", f"'lib/d' || {_K} || '.dart'", f"'import \"package:app/d' || {_K} || '.dart\";'{_N}'abstract class D' || {_K} || ' {{'{_N}'mixin Mix on D {{'"),
    ("gdscript", f"'game/g' || {_K} || '.gd'", f"'class_name G' || {_K}{_N}'var s = preload(\"res://game/g' || {_K} || '.gd\")'{_N}'signal hit'{_N}'func _ready():'"),
    ("terraform", f"'infra/t' || {_K} || '.tf'", f"'resource \"aws_x\" \"r' || {_K} || '\" {{'{_N}'module \"net\" {{'{_N}'  source = \"./net\"'"),
    ("shell", f"'bin/s' || {_K} || '.sh'", f"'#!/bin/sh'{_N}'. ./s' || {_K} || '.sh'{_N}'deploy_' || {_K} || '() {{'{_N}'  source ../x.sh'"),
    ("powershell", f"'bin/p' || {_K} || '.ps1'", f"'function Get-Thing' || {_K} || ' {{'{_N}'class Pc {{'"),
    ("typescript", f"'web/t' || {_K} || CASE WHEN p_partkey % 32 = 15 THEN '.ts' ELSE '.test.ts' END", f"'import a from \"./t' || CAST(p_partkey - p_partkey % 32 + 15 AS VARCHAR(19)) || '\";'{_N}'import \"react\";'{_N}'import b from \"./gone\";'{_N}'export default class T' || {_K} || ' {{'{_N}'export const f = async (x) => x;'{_N}'  function inner() {{}}'"),
]
SOURCES = " UNION ALL ".join(f"SELECT {path} AS path, '{lang}' AS language, {body} AS body FROM {{part}} WHERE p_partkey % 16 = {i}" for i, (lang, path, body) in enumerate(_FILES)).replace("{{", "\x01").replace("}}", "\x02").replace("\x01", "{").replace("\x02", "}")
PSR4 = {"App\\": "src/App"}


def files(spark, d):
    """Braces of the bodies stand for themselves: the table is bound by name."""
    part = spark.read.parquet(f"{d}/part.parquet")
    part.createOrReplaceTempView("eventloom_part")
    return spark.sql(SOURCES.replace("{part}", "eventloom_part").replace("\\", "\\\\"))


S = f"WITH sr AS ({SOURCES.replace('{part}', 'part')})"
COMMENT = " OR ".join(f"(language = '{n}' AND starts_with(text, '{m}'))" for n, (_, _, m) in x.LANGUAGES.items())
LINES = f"ln AS (SELECT * FROM (SELECT path, language, i AS line, length(raw) - length(ltrim(raw)) AS indent, trim(raw) AS text FROM (SELECT path, language, i, string_split(body, chr(10))[i] AS raw FROM sr, unnest(range(1, 12)) t(i) WHERE i <= len(string_split(body, chr(10))))) WHERE text <> '' AND NOT ({COMMENT}))"
q = lambda p: p.replace("'", "''")
NAME = "CASE " + " ".join(f"WHEN language = '{n}' AND regexp_matches(text, '{q(p)}') THEN regexp_extract(text, '{q(p)}', 1)" for n, (rules, _, _) in x.LANGUAGES.items() for p, _ in rules) + " END"
KIND = "CASE " + " ".join(f"WHEN language = '{n}' AND regexp_matches(text, '{q(p)}') THEN '{k}'" for n, (rules, _, _) in x.LANGUAGES.items() for p, k in rules) + " END"
TARGET = "CASE " + " ".join(f"WHEN language = '{n}' AND regexp_matches(text, '{q(p)}') THEN regexp_extract(text, '{q(p)}', 1)" for n, (_, ps, _) in x.LANGUAGES.items() for p in ps) + " END"
SYMBOLS = f"sy AS (SELECT * FROM (SELECT *, {NAME} AS name, {KIND} AS kind FROM ln) WHERE kind IS NOT NULL), im AS (SELECT * FROM (SELECT path, language, line, {TARGET} AS target FROM ln) WHERE target IS NOT NULL)"
TYPES = "('class', 'interface', 'struct', 'enum', 'trait', 'record', 'protocol', 'object', 'module', 'impl', 'mixin')"


@query(f"{S}, {LINES}, {SYMBOLS}, o AS (SELECT *, (SELECT arg_max(struct_pack(n := p.name, i := p.indent), p.line) FROM sy p WHERE p.path = sy.path AND p.line < sy.line AND p.kind IN {TYPES}) AS up FROM sy) SELECT path, language, line::INT AS line, name, kind, CASE WHEN kind IN ('function', 'method') AND up.i < indent THEN up.n END AS parent FROM o")
def source_symbols(spark, d):
    return x.symbols(files(spark, d))


@query(f"{S}, {LINES}, {SYMBOLS} SELECT path, language, line::INT AS line, target FROM im")
def source_imports(spark, d):
    return x.imports(files(spark, d))


@query(f"{S}, {LINES}, {SYMBOLS} SELECT path, language, (SELECT count(*) FROM sy WHERE sy.path = sr.path)::BIGINT AS symbols, (SELECT count(*) FROM im WHERE im.path = sr.path)::BIGINT AS imports, regexp_matches(path, '{x.TEST_FILE}') AS is_test FROM sr")
def source_files(spark, d):
    return x.file_facts(files(spark, d))


#: Every file that an import of these sources can mean is the importing file itself, save for Kotlin and tests of TypeScript.
RESOLVED = f"""rs AS (SELECT path, language, line::INT AS line, target, CASE WHEN language = 'python' AND target LIKE 'app.%' THEN path WHEN language = 'java' AND target LIKE 'shop.%' THEN path WHEN language = 'kotlin' AND 'src/main/java/' || replace(target, '.', '/') || '.java' IN (SELECT path FROM sr) THEN 'src/main/java/' || replace(target, '.', '/') || '.java'
 WHEN language IN ('ruby', 'dart', 'gdscript') THEN path WHEN language = 'php' AND target LIKE 'App%' THEN path WHEN language = 'cpp' AND target <> 'vector' THEN path WHEN language = 'shell' AND target LIKE './s%' THEN path
 WHEN language = 'typescript' AND 'web/' || target[3:] || '.ts' IN (SELECT path FROM sr) THEN 'web/' || target[3:] || '.ts' END AS file FROM im)"""


@query(f"{S}, {LINES}, {SYMBOLS}, {RESOLVED} SELECT *, CASE WHEN file IS NOT NULL THEN 'file' WHEN starts_with(target, '.') THEN 'unresolved' ELSE 'external' END AS resolution FROM rs")
def resolved_imports(spark, d):
    f = kept(files(spark, d), "sources")
    return x.resolved(x.imports(f), f, PSR4)


@query(f"{S}, {LINES}, {SYMBOLS}, {RESOLVED} SELECT path, file, count(*)::BIGINT AS n, min(line)::INT AS line, string_agg(DISTINCT target, ',' ORDER BY target) AS targets FROM rs WHERE file IS NOT NULL AND file <> path GROUP BY path, file")
def import_dependencies(spark, d):
    return x.dependencies(resolved_imports(spark, d))


@query(f"{S}, {LINES}, {SYMBOLS}, {RESOLVED} SELECT 'external:' || language || ':' || target AS id, count(*)::BIGINT AS imports FROM rs WHERE file IS NULL AND NOT starts_with(target, '.') GROUP BY ALL")
def external_imports(spark, d):
    return x.external_nodes(resolved_imports(spark, d))


PAIRED = "SELECT 'web/u' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.test.ts' ELSE '.ts' END AS path FROM {part} UNION ALL SELECT 'web/u' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.js' ELSE '.tsx' END FROM {part} WHERE p_partkey % 4 = 0"


@query(f"WITH f AS ({PAIRED.replace('{part}', 'part')}) SELECT path AS test, replace(path, '.test.ts', CASE WHEN replace(path, '.test.ts', '.ts') IN (SELECT path FROM f) THEN '.ts' WHEN replace(path, '.test.ts', '.tsx') IN (SELECT path FROM f) THEN '.tsx' ELSE '.js' END) AS file FROM f WHERE path LIKE '%.test.ts' AND (replace(path, '.test.ts', '.tsx') IN (SELECT path FROM f) OR replace(path, '.test.ts', '.js') IN (SELECT path FROM f))")
def tested_files(spark, d):
    return x.tested_files(w.of(spark, d, PAIRED))


@query(f"{S}, r AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN '/home/me/work/' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN 'BIN/s' ELSE 's' END || p_partkey || '.sh' AS path FROM part) SELECT DISTINCT r.path AS run_path, sr.path AS file FROM r JOIN sr ON lower(r.path) = lower(sr.path) OR ends_with(lower(r.path), '/' || lower(sr.path)) OR ends_with(lower(sr.path), '/' || lower(r.path))")
def linked_run_paths(spark, d):
    runs = w.of(spark, d, "SELECT CASE WHEN p_partkey % 2 = 0 THEN '/home/me/work/' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN 'BIN/s' ELSE 's' END || p_partkey || '.sh' AS path FROM {part}")
    return x.linked_paths(runs, files(spark, d))
