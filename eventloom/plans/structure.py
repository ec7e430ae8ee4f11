"""Registered queries of types and their relations. The sources are made of parts' numbers by a formula, and so are the oracles:
they know the facts without reading the text."""

from __future__ import annotations

from eventloom.operators import structure as o
from eventloom.plans.catalog import query

_N = " || chr(10) || "
_V = lambda x: f"CAST({x} AS VARCHAR(19))"
K, UP, OLD = _V("k"), _V("k - 5"), _V("k - 35")
P, Q = _V("k % 7"), _V("(k + 2) % 7")  # the package of a part, and of the one five before
_B = "chr(92)"
#: By the number modulo 5: language, path, body. Ghosts stand in comments and strings.
_FILES = [
    ("java", f"'src/J' || {K} || '.java'", f"'package shop.p' || {P} || ';'{_N}'/* class Ghost extends Lies {{'{_N}'*/'{_N}'import shop.p' || {Q} || '.J' || {UP} || ';'{_N}'public class J' || {K}{_N}'    extends J' || {UP}{_N}'    implements Face, java.util.List {{'"
     f"{_N}'  String s = \"class Fake extends Lies {{\"; // new Gone()'{_N}'  static class In {{ void y() {{ if (true) {{ new J' || {UP} || '(); }} }} }}'{_N}'  void run() {{ Util.go(); In.y(); }}'{_N}'}}'"),
    ("csharp", f"'src/C' || {K} || '.cs'", f"'using Shop.P' || {Q} || '.Deep;'{_N}'namespace Shop.P' || {P} || '.Deep'{_N}'{{'{_N}'  public sealed class C' || {K} || ' : C' || {UP} || ', IThing'{_N}'  {{'{_N}'    void M() {{ C' || {UP} || '.Make(1); }}'{_N}'  }}'{_N}'}}'"),
    ("php", f"'src/H' || {K} || '.php'", f"'<?php'{_N}'# class Ghost {{'{_N}'namespace App' || {_B} || 'P' || {P} || ';'{_N}'use App' || {_B} || 'P' || {Q} || {_B} || 'H' || {UP} || ' as Up;'{_N}'final class H' || {K} || ' extends Up implements ' || {_B} || 'App' || {_B} || 'Face {{'{_N}'  function f() {{ return new H' || {K} || '(); }}'{_N}'}}'"),
    ("kotlin", f"'src/K' || {K} || '.kt'", f"'package shop.k' || {P}{_N}'import shop.k' || {Q} || '.K' || {UP} || ' as Up'{_N}'class K' || {K} || '(val a: Int)'{_N}'  : Up(a),'{_N}'    Face {{'{_N}'  fun go() {{ K' || {K} || '.of(1) }}'{_N}'}}'"),
    ("ruby", f"'lib/r' || {K} || '.rb'", f"'module M' || {P}{_N}'  class R' || {K} || ' < R' || {OLD}{_N}'    def a; end'{_N}'    def b'{_N}'      if x'{_N}'        R' || {K} || '.make(1)'{_N}'      end'{_N}'    end'{_N}'  end # class Ghost'{_N}'end'"),
]
SOURCES = " UNION ALL ".join(f"SELECT {path} AS path, '{lang}' AS language, {body} AS body FROM ks WHERE k % 5 = {i}" for i, (lang, path, body) in enumerate(_FILES)).replace("{{", "{").replace("}}", "}")
SOURCES += f" UNION ALL SELECT 'src/J' || {K} || 'Test.java', 'java', 'package shop.p' || {P} || ';'{_N}'class J' || {K} || 'Test {{ }}' FROM ks WHERE k % 15 = 0".replace("{{", "{").replace("}}", "}")


def files(spark, d):
    """Braces of the bodies stand for themselves: the table is bound by name."""
    spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey + 100 AS k").createOrReplaceTempView("eventloom_parts")
    return spark.sql(SOURCES.replace("FROM ks", "FROM eventloom_parts"))


def fact(i: int, type_: str, relation: str, wanted: str, member: str = "NULL", qualified: str = "NULL", file: str = "NULL", least: int | None = None, otherwise: str = "unknown") -> str:
    """A relation of the files of a kind; with least only from that number on is the type it names declared."""
    there = f"k >= {least}" if least is not None else "TRUE" if file != "NULL" else "FALSE"
    known = f"CASE WHEN {there} OR '{otherwise}' = 'external' THEN {qualified} END"
    return f"SELECT {_FILES[i][1]} AS path, {type_} AS type, '{relation}' AS relation, {wanted} AS wanted, {member} AS member, {known} AS qualified, CASE WHEN {there} THEN {file} END AS target_path, CASE WHEN {there} THEN 'symbol' ELSE '{otherwise}' END AS resolution FROM ks WHERE k % 5 = {i}"


JAVA, CS, PHP, KT, RB = f"'shop.p' || {P} || '.J' || {K}", f"'Shop.P' || {P} || '.Deep.C' || {K}", f"'App.P' || {P} || '.H' || {K}", f"'shop.k' || {P} || '.K' || {K}", f"'M' || {P} || '.R' || {K}"
J_UP, C_UP, H_UP, K_UP = (f"'shop.p' || {Q} || '.J' || {UP}", f"'src/J' || {UP} || '.java'"), (f"'Shop.P' || {Q} || '.Deep.C' || {UP}", f"'src/C' || {UP} || '.cs'"), (f"'App.P' || {Q} || '.H' || {UP}", f"'src/H' || {UP} || '.php'"), (f"'shop.k' || {Q} || '.K' || {UP}", f"'src/K' || {UP} || '.kt'")
FACTS = " UNION ALL ".join([
    fact(0, JAVA, "extends", f"'J' || {UP}", "NULL", *J_UP, 105, "external"), fact(0, JAVA, "implements", "'Face'"), fact(0, JAVA, "implements", "'java.util.List'"), fact(0, JAVA, "calls", "'Util'", "'go'"),
    fact(0, JAVA, "calls", "'In'", "'y'", f"{JAVA} || '.In'", _FILES[0][1]), fact(0, f"{JAVA} || '.In'", "constructs", f"'J' || {UP}", "NULL", *J_UP, 105, "external"),
    fact(1, CS, "extends", f"'C' || {UP}", "NULL", *C_UP, 105), fact(1, CS, "implements", "'IThing'"), fact(1, CS, "calls", f"'C' || {UP}", "'Make'", *C_UP, 105),
    fact(2, PHP, "extends", "'Up'", "NULL", *H_UP, 105, "external"), fact(2, PHP, "implements", f"'App' || {_B} || 'Face'"), fact(2, PHP, "constructs", f"'H' || {K}", "NULL", PHP, _FILES[2][1]),
    fact(3, KT, "extends", "'Up'", "NULL", *K_UP, 105, "external"), fact(3, KT, "implements", "'Face'"), fact(3, KT, "calls", f"'K' || {K}", "'of'", KT, _FILES[3][1]),
    fact(4, RB, "extends", f"'R' || {OLD}", "NULL", f"'M' || {P} || '.R' || {OLD}", f"'lib/r' || {OLD} || '.rb'", 135), fact(4, RB, "calls", f"'R' || {K}", "'make'", RB, _FILES[4][1]),
    f"SELECT 'src/J' || {K} || 'Test.java', {JAVA} || 'Test', 'tests', 'J' || {K}, NULL, {JAVA}, {_FILES[0][1]}, 'symbol' FROM ks WHERE k % 15 = 0",
])


@query(f"WITH ks AS (SELECT p_partkey + 100 AS k FROM part) {FACTS}")
def type_relations(spark, d):
    return o.relations(files(spark, d))


def imported(i: int, line: int, target: str, space: str, file: str) -> str:
    return f"SELECT {_FILES[i][1]} AS path, {line} AS line, {target} AS target, CASE WHEN k >= 105 THEN {target} ELSE {space} END AS match, CASE WHEN k >= 105 THEN 'type' ELSE 'namespace' END AS kind, CASE WHEN k >= 105 THEN {file} END AS file FROM ks WHERE k % 5 = {i}"


@query("WITH ks AS (SELECT p_partkey + 100 AS k FROM part) " + " UNION ALL ".join([
    imported(0, 4, J_UP[0], f"'shop.p' || {Q}", J_UP[1]), imported(2, 4, H_UP[0], f"'App.P' || {Q}", H_UP[1]), imported(3, 2, K_UP[0], f"'shop.k' || {Q}", K_UP[1]),
    f"SELECT {_FILES[1][1]}, 1, 'Shop.P' || {Q} || '.Deep', 'Shop.P' || {Q} || '.Deep', 'namespace', NULL FROM ks WHERE k % 5 = 1"]))
def import_targets(spark, d):
    return o.import_targets(files(spark, d))


NESTED = f"""SELECT path, type, kind, owner FROM (SELECT {_FILES[0][1]} AS path, {JAVA} AS type, 'class' AS kind, NULL AS owner FROM ks WHERE k % 5 = 0 UNION ALL SELECT {_FILES[0][1]}, {JAVA} || '.In', 'class', 'J' || {K} FROM ks WHERE k % 5 = 0
 UNION ALL SELECT {_FILES[1][1]}, {CS}, 'class', NULL FROM ks WHERE k % 5 = 1 UNION ALL SELECT {_FILES[2][1]}, {PHP}, 'class', NULL FROM ks WHERE k % 5 = 2 UNION ALL SELECT {_FILES[3][1]}, {KT}, 'class', NULL FROM ks WHERE k % 5 = 3
 UNION ALL SELECT {_FILES[4][1]}, 'M' || {P}, 'module', NULL FROM ks WHERE k % 5 = 4 UNION ALL SELECT {_FILES[4][1]}, {RB}, 'class', 'M' || {P} FROM ks WHERE k % 5 = 4 UNION ALL SELECT 'src/J' || {K} || 'Test.java', {JAVA} || 'Test', 'class', NULL FROM ks WHERE k % 15 = 0)"""


@query(f"WITH ks AS (SELECT p_partkey + 100 AS k FROM part) {NESTED}")
def declared_types(spark, d):
    """No type of a comment or a string is among them."""
    t = o.declared(o.statements(o.masked(files(spark, d))))[1]
    return t.selectExpr("path", "qualified AS type", "kind", "owner")
