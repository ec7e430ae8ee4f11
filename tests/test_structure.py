"""Types and their relations in small sources of each language, and merges of communities, against what is plain to see."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import structure
from eventloom.operators import workspace as w

FILES = [
("a/A.java","java",'''package shop.core;
/* class Ghost extends Nothing { */
import shop.util.Base;
import java.util.*;
// class Line {
@Anno(x = "y")
public final class A<T extends Number>
    extends Base<T>
    implements Face, shop.util.Other {
  String s = "class Fake extends Lies { \\" }";
  void run() { new B(); Util.go(1); if (a) { Inner.x(); } }
  static class Inner extends B { void y() { new C(); } }
}
interface Face extends Face2, Face3 {}
'''),
("a/B.java","java","package shop.core; class B {}\nclass C{}"),
("u/Base.java","java","package shop.util;\npublic abstract class Base<T> {}\n class Other{}"),
("t/ATest.java","java","package shop.core;\nclass ATest { void t() { A.make(); } }"),
("k/K.kt","kotlin",'''package shop.core
import shop.util.Base as Root
data class P(val a: Int, val b: String = "x{")
class K(x: Int)
  : Root<Int>(x), Face {
  fun go() { P.of(1) }
  companion object { val z = 1 }
}
enum class E { ONE, TWO }
'''),
("c/C.cs","csharp",'''using System.Text;
using Al = Shop.Util.Thing;
using Shop.Util;
namespace Shop.Core.Deep {
  public class CC : Al, IFace { Thing t = new Thing(); void M() { Helper.Do(); Helper.run(); } }
}'''),
("c/T.cs","csharp","namespace Shop.Util;\nclass Thing {}\ninterface IFace {}"),
("c/H.cs","csharp","namespace Shop { class Helper {} }"),
("p/P.php","php","<?php\nnamespace App\\Core;\nuse App\\Util\\Base as B2;\n# note class X\nfinal class P extends B2 implements \\App\\Util\\Face { function f() { return new Q(); } }\nclass Q {}"),
("p/B.php","php","<?php\nnamespace App\\Util;\nclass Base {}\ninterface Face {}"),
("r/r.rb","ruby","module M\n  class Base\n    def a\n      if x\n        1\n      end\n    end\n  end\n  # class Ghost < Base\n  class D < Base\n    def b; end\n    def c\n      Base.make(1)\n    end\n  end\nend\n"),
("t/t.ts","typescript",'''import {
  a,
  b,
} from "./m";
import "side";
const s = `import x from "no" ${a}`;
export default class T extends M.Q implements I1, I2 { f() { return new T(); } }
'''),
("s/S.swift","swift","import Foundation\nclass S: Base, Proto {\n  func go() { Other.run(1) }\n}\nstruct V: Proto {}\nextension S: Extra {}"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, language string, body string")


def test_no_type_of_a_comment_or_string_is_declared(files):
    t = structure.declared(structure.statements(structure.masked(files)))[1]
    assert {(r["path"], r["qualified"], r["kind"], r["owner"]) for r in t.collect()} == {
        ("a/A.java", "shop.core.A", "class", None), ("a/A.java", "shop.core.A.Inner", "class", "A"), ("a/A.java", "shop.core.Face", "interface", None), ("a/B.java", "shop.core.B", "class", None), ("a/B.java", "shop.core.C", "class", None),
        ("u/Base.java", "shop.util.Base", "class", None), ("u/Base.java", "shop.util.Other", "class", None), ("t/ATest.java", "shop.core.ATest", "class", None), ("k/K.kt", "shop.core.P", "class", None), ("k/K.kt", "shop.core.K", "class", None),
        ("k/K.kt", "shop.core.E", "class", None), ("c/C.cs", "Shop.Core.Deep.CC", "class", None), ("c/T.cs", "Shop.Util.Thing", "class", None), ("c/T.cs", "Shop.Util.IFace", "interface", None), ("c/H.cs", "Shop.Helper", "class", None),
        ("p/P.php", "App.Core.P", "class", None), ("p/P.php", "App.Core.Q", "class", None), ("p/B.php", "App.Util.Base", "class", None), ("p/B.php", "App.Util.Face", "interface", None), ("r/r.rb", "M", "module", None), ("r/r.rb", "M.Base", "class", "M"),
        ("r/r.rb", "M.D", "class", "M"), ("t/t.ts", "T", "class", None), ("s/S.swift", "S", "class", None), ("s/S.swift", "V", "struct", None), ("s/S.swift", "S", "extension", None)}
    assert {(r["path"], r["line"]) for r in t.filter("name IN ('Inner', 'K', 'D')").collect()} == {("a/A.java", 12), ("k/K.kt", 4), ("r/r.rb", 10)}


def test_imports_over_several_lines(files):
    m = structure.masked(files)
    got = structure.imported(structure.statements(m), m).filter("path IN ('t/t.ts', 'k/K.kt', 'a/A.java')").collect()
    assert {(r["line"], r["target"], r["alias"], r["whole"]) for r in got} == {(1, "./m", None, False), (5, "side", None, False), (2, "shop.util.Base", "Root", False), (3, "shop.util.Base", None, False), (4, "java.util", None, True)}


def test_relations_of_types(files):
    got = {(r["type"], r["relation"], r["wanted"], r["qualified"], r["resolution"]) for r in structure.relations(files).collect()}
    for x in [("shop.core.A", "extends", "Base", "shop.util.Base", "symbol"), ("shop.core.A", "implements", "Face", "shop.core.Face", "symbol"), ("shop.core.A", "implements", "shop.util.Other", "shop.util.Other", "symbol"), ("shop.core.A", "constructs", "B", "shop.core.B", "symbol"),
              ("shop.core.A", "calls", "Inner", "shop.core.A.Inner", "symbol"), ("shop.core.A.Inner", "constructs", "C", "shop.core.C", "symbol"), ("shop.core.K", "extends", "Root", "shop.util.Base", "symbol"), ("shop.core.K", "implements", "Face", "shop.core.Face", "symbol"),
              ("Shop.Core.Deep.CC", "extends", "Al", "Shop.Util.Thing", "symbol"), ("Shop.Core.Deep.CC", "calls", "Helper", "Shop.Helper", "symbol"), ("App.Core.P", "extends", "B2", "App.Util.Base", "symbol"), ("App.Core.P", "implements", "App\\Util\\Face", "App.Util.Face", "symbol"),
              ("M.D", "extends", "Base", "M.Base", "symbol"), ("M.D", "calls", "Base", "M.Base", "symbol"), ("S", "extends", "Base", None, "unknown"), ("V", "implements", "Proto", None, "unknown"), ("shop.core.ATest", "tests", "A", "shop.core.A", "symbol")]:
        assert x in got
    assert not {x for x in got if x[2] in ("Lies", "Gone", "Nothing", "Ghost", "Number", "Integer")}


def greedy(tiny, wishes):
    here, moves = None, {}
    for k in sorted(tiny):
        for _, target in sorted(wishes.get(k, [])):
            if target not in moves:
                moves[k] = target
                break
    return moves, here


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_moves_equal_a_sequential_pass(spark, seed):
    rng = random.Random(seed)
    tiny, others = [f"t{i:02}" for i in range(25)], [f"x{i}" for i in range(3)]
    wishes = {k: [(r, t) for r, t in enumerate(rng.sample([x for x in tiny + others[:1] * (rng.random() < 0.3) if x != k], rng.randrange(0, 4)))] for k in tiny}
    moves, _ = greedy(tiny, wishes)
    rows = spark.createDataFrame([(k, t, r) for k, xs in wishes.items() for r, t in xs], "key string, target string, rank int")
    got = w.greedy_moves(spark.createDataFrame([(k,) for k in tiny], "key string"), rows)
    assert {r["key"]: r["to"] for r in got.collect()} == moves
    def end(k):
        return end(moves[k]) if k in moves else k

    assert {r["key"]: r["end"] for r in w.ends_of_moves(got).collect()} == {k: end(k) for k in moves}


def test_thin_hubs_merge_in_order(spark):
    r = lambda *xs: [("depends_on", label, n) for label, n in xs]
    hubs = [("a", "A", "src/a", 50, False, ["1", "2"], r(("T1", 5), ("B", 2)), r(("C", 1))), ("b", "B", "src/b", 40, False, ["3"], [], r(("A", 2))), ("t1", "T1", "src/a/t", 3, True, ["2", "9"], [], r(("A", 5), ("C", 4))),
            ("t2", "T2", "x/t2", 2, True, ["4"], r(("B", 1), ("A", 1)), r(("B", 3))), ("t3", "T3", "lost", 1, True, ["5"], r(("Nobody", 9)), []), ("t4", "T4", "src/a/u", 1, True, [str(i) for i in range(6)], [], r(("D", 1), ("E", 1), ("F", 1)))]
    table = spark.createDataFrame(hubs, f"id string, label string, path string, files long, thin boolean, top_files array<string>, incoming {w.RELATIONS}, outgoing {w.RELATIONS}")
    assert {x["id"]: x["target"] for x in w.hub_targets(table).collect()} == {"t1": "a", "t2": "b", "t4": "a"}
    got = {x["id"]: x for x in w.merged_hubs(table).collect()}
    assert set(got) == {"a", "b", "t3"}
    a = got["a"]
    assert (a["files"], a["merged"], a["top_files"], a["degree"]) == (54, ["T1", "T4"], ["1", "2", "9", "0", "3", "4"], 2 + 10 + 3)
    assert [tuple(x) for x in a["incoming"]] == [("depends_on", "B", 2)] and [tuple(x) for x in a["outgoing"]] == [("depends_on", "A", 5), ("depends_on", "C", 5), ("depends_on", "D", 1)]
    assert [tuple(x) for x in got["b"]["outgoing"]] == [("depends_on", "B", 3), ("depends_on", "A", 2)] and got["t3"]["degree"] == 9
