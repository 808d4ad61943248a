"""Blocks, search, symbols, graph and paths on small fixtures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import chunk, graph, paths, search, symbols


def files(spark, **texts):
    return spark.createDataFrame([(i, rel.replace("__", "/").replace("_dot_", "."), t) for i, (rel, t) in enumerate(texts.items())], "file_id long, rel string, content string")


def tree(spark, items):
    return spark.createDataFrame([(i, rel, t) for i, (rel, t) in enumerate(items)], "file_id long, rel string, content string")


def blocks_of(spark, content):
    return [(r.line, r.n_lines, r.text) for r in chunk.blocks(tree(spark, [("a.txt", content)])).orderBy("line").collect()]


def test_blocks(spark):
    assert blocks_of(spark, "a\nb\n\nc\n\n\nd") == [(1, 2, "a\nb"), (4, 1, "c"), (7, 1, "d")]
    assert blocks_of(spark, "") == [] == blocks_of(spark, None) == blocks_of(spark, "\n \n")
    assert blocks_of(spark, "a\r\n \r\nb\r\n") == [(1, 1, "a"), (3, 1, "b")]
    for n, sizes in ((79, [79]), (80, [80]), (81, [80, 1]), (160, [80, 80])):
        assert [b[1] for b in blocks_of(spark, "\n".join(["x"] * n))] == sizes
    assert [b[:2] for b in blocks_of(spark, "\n".join(["x"] * 80) + "\n\ny")] == [(1, 80), (82, 1)]


def test_fnv_and_trigrams(spark):
    row = spark.createDataFrame([("abc",), ("",), ("é!",)], "t string").select(tx.fnv64(F.col("t")), tx.trigrams(F.col("t")), tx.fnv64_bulk("t")).collect()
    assert row[0][0] == "e71fa2190541574b" == row[0][2] and row[0][1] == ["616263"]
    assert row[1][0] == "cbf29ce484222325" == row[1][2] and row[1][1] == []
    assert row[2][1] == ["C3A921"] and row[2][0] == row[2][2]


def test_search_ranks_and_index_agrees(spark):
    found = chunk.blocks(tree(spark, [("one.txt", "Spam once"), ("three.txt", "spam spam SPAM"), ("over.txt", "aaaa"), ("none.txt", "eggs")]))
    hits = search.search(found, "sPaM", 10).collect()
    assert [(h.rel, h.occurrences) for h in hits] == [("three.txt", 3), ("one.txt", 1)]
    assert [h.occurrences for h in search.search(found, "aa", 5).collect()] == [2]
    assert search.search(found, "", 5).count() == 0
    for q in ("spam", "pam s", "aaa", "zzz", "ég"):
        assert search.search(found, q, 9, chunk.postings(found)).collect() == search.search(found, q, 9).collect()
    many = search.search_many(found, ["spam", "gg"], 1).collect()
    assert sorted((r["query"], r["rel"]) for r in many) == [("gg", "none.txt"), ("spam", "three.txt")]


def test_matching_lines_and_ranges(spark):
    found = chunk.blocks(tree(spark, [("a.txt", "x\nhit\nno\nHIT hit")]))
    rows = search.matching_lines(search.search(found, "hit", 5), "hit", 1).collect()
    assert [(r.line_no, r.matched, r.more) for r in rows] == [(2, "hit", True)]
    assert search.match_ranges("İstanbul ISTANBUL", "istanbul") == [(10, 18)]
    assert search.match_ranges("aaaa", "aa") == [(0, 4)]
    assert search.match_ranges("éÉ x é", "é") == [(0, 4), (7, 9)]


CASES = [
    ("a.rs", "pub fn serve(x: u8) {", ("serve", "func")),
    ("a.rs", "impl<T> Foo<T> for Bar {", ("Foo", "impl")),
    ("a.rs", "fn f() {", None),
    ("a.rs", "type Alias = u8;", ("Alias", "type")),
    ("a.rs", "impl<T, U<V>> Deep {", ("Deep", "impl")),
    ("a.ts", "export const run = async () => {", ("run", "func")),
    ("a.ts", "const limit = 3;", None),
    ("a.ts", "// a class of things", ("of", "class")),
    ("a.tsx", "interface Props {", ("Props", "interface")),
    ("a.py", "    def method(self):", ("method", "func")),
    ("a.py", "class Thing:", ("Thing", "class")),
    ("a.go", "func (r *T) Name() {", None),
    ("a.go", "func(r T) Name() {", ("Name", "method")),
    ("a.go", "func Serve() {", ("Serve", "func")),
    ("a.go", "type Server struct {", ("Server", "struct")),
    ("A.java", "public static void main(String[] a) {", ("main", "method")),
    ("A.java", "main(args);", None),
    ("A.java", "public Foo(int x) {", None),
    ("A.kt", "private final Map<K,V> lookup(K k)", ("lookup", "method")),
    ("a.txt", "fn serve() {", None),
]


def test_definitions(spark):
    frame = tree(spark, [(f"{i}/{rel}", line) for i, (rel, line, _) in enumerate(CASES)])
    got = {r.file_id: (r.name, r.kind) for r in symbols.definitions(symbols.source_lines(frame)).collect()}
    assert [got.get(i) for i in range(len(CASES))] == [c[2] for c in CASES]


LONG = "x" * 1_000_000
NESTED = [
    ("a.js", "function(" + "a" * 2000 + ") {", None),
    ("a.js", "function(" + "(" * 50 + ")" * 50 + ") deep() {", ("deep", "func")),
    ("a.rs", "impl<" + "A<" * 50 + ">" * 50 + "> Deep for X {", ("Deep", "impl")),
    ("a.rs", "impl<T Open {", None),
    ("a.go", "func(r T{(x)}) Method() {", ("Method", "method")),
    ("a.js", "function(a) (b) {", None),
    ("b.js", LONG + " function( " + LONG + ") tail() {" + LONG, ("tail", "func")),
    ("c.js", "function(" * 20_000, None),
    ("d.js", "(" * 300_000 + " class Late {", ("Late", "class")),
]


def test_definitions_of_any_depth_and_length(spark):
    frame = tree(spark, [(f"{i}/{rel}", line) for i, (rel, line, _) in enumerate(NESTED)])
    source = symbols.source_lines(frame)
    got = {r.file_id: (r.name, r.kind) for r in symbols.definitions(source).collect()}
    assert [got.get(i) for i in range(len(NESTED))] == [c[2] for c in NESTED]
    assert symbols.imports(source).count() == 0
    plan = symbols.definitions(source)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") >= 1


IMPORTS = [
    ("a.ts", "import { x } from './b';", "./b"),
    ("a.js", 'const y = require("../c")', "../c"),
    ("a.ts", "export default 3", None),
    ("a.rs", "use crate::net::http::{get, post};", "net/http"),
    ("a.rs", "use std::io;", None),
    ("a.rs", "pub mod server;", "server"),
    ("a.py", "from .mod import x", ".mod"),
    ("a.py", "import os, sys", "os"),
    ("a.go", '"github.com/o/r/pkg"', "github.com/o/r/pkg"),
    ("A.java", "import com.x.Foo;", "com.x.Foo"),
]


def test_imports(spark):
    frame = tree(spark, [(f"{i}/{rel}", line) for i, (rel, line, _) in enumerate(IMPORTS)])
    got = {r.file_id: r.spec for r in symbols.imports(symbols.source_lines(frame)).collect()}
    assert [got.get(i) for i in range(len(IMPORTS))] == [c[2] for c in IMPORTS]


def built(spark, items):
    frame = tree(spark, items)
    lines = symbols.source_lines(frame)
    syms = graph.symbols(symbols.definitions(lines), chunk.blocks(frame))
    names = {r.sym_id: (r.name, r.file_id) for r in syms.collect()}
    edges = {(names[r.src], names[r.dst]) for r in graph.call_edges(symbols.call_tokens(lines), syms).collect()}
    resolved = graph.resolve(symbols.imports(lines), frame.select("file_id", "rel"))
    return syms, names, edges, {(r.from_id, r.to_id) for r in graph.import_edges(resolved).collect()}


def test_calls_prefer_the_same_file(spark):
    body = "function helper() {\n}\n\nfunction caller() {\n  helper();\n}\n"
    _, _, edges, _ = built(spark, [("a.ts", body), ("b.ts", body)])
    assert edges == {(("caller", 0), ("helper", 0)), (("caller", 1), ("helper", 1))}


@pytest.mark.parametrize("n", [25, 26])
def test_many_targets(spark, n):
    items = [(f"d{i}.ts", "function dup() {\n}\n") for i in range(n)] + [("z.ts", "function caller() {\n  dup();\n}\n")]
    _, _, edges, _ = built(spark, items)
    assert len(edges) == (n if n <= 25 else 0)


def test_import_tiers(spark):
    items = [
        ("src/a.ts", "import x from './b'\nimport y from '@/lib/u'\nimport z from 'only'\nimport q from './gone'"),
        ("src/b/index.ts", ""),
        ("lib/u.py", "from . import x"),
        ("deep/only.rs", ""),
        ("lib/__init__.py", ""),
        ("m.go", 'import "github.com/o/lib"'),
    ]
    *_, edges = built(spark, items)
    assert edges == {(0, 1), (0, 2), (0, 3), (2, 4), (5, 2), (5, 4)}


def test_directory_tier_takes_ten_smallest(spark):
    items = [("main.go", 'import "x.org/pkg"')] + [(f"pkg/f{i:02}.go", "") for i in range(12)]
    *_, edges = built(spark, items)
    assert edges == {(0, k) for k in range(1, 11)}


def brute(edges, sources, targets, most):
    out = []

    def go(path):
        if len(path) > 1 and path[-1] in targets:
            out.append(tuple(path))
            return
        if len(path) < most:
            for b in sorted({b for a, b in edges if a == path[-1]}):
                if b not in path:
                    go([*path, b])

    for s in sorted(sources):
        go([s])
    return out


def test_paths_against_brute_force(spark):
    rng = random.Random(3)
    for _ in range(4):
        nodes = range(7)
        edges = [e for e in itertools.product(nodes, nodes) if rng.random() < 0.3]
        sources, targets, most = {0, 1}, {5, 1}, rng.choice([2, 4, 5])
        frame = spark.createDataFrame(edges, "src long, dst long")
        one = lambda x: spark.createDataFrame([(k,) for k in sorted(x)], "node long")
        got = {tuple(r.path) for r in paths.paths(frame, one(sources), one(targets), most).collect()}
        assert got == set(brute(edges, sources, targets, most))
        first = [tuple(r.path) for r in paths.find_paths(frame, one(sources), one(targets), most, 3).collect()]
        assert first == sorted(brute(edges, sources, targets, most)[:3], key=lambda p: (len(p), p))


def test_paths_stop_at_the_budget(spark):
    # Ten layers of ten nodes: 10 ** 9 simple paths from the first to the last.
    edges = [(10 * k + i, 10 * k + 10 + j) for k in range(9) for i in range(10) for j in range(10)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    one = lambda x: spark.createDataFrame([(x,)], "node long")
    assert {len(r.path) for r in paths.paths(frame, one(0), one(95), 10, visits=50).collect()} == {10}
