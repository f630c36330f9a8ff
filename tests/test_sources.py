"""Lexical states, trees and edits of source texts, against plain restatements."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import constructs, edits, lexing, rewrite, trees


def plain_code(lines):
    """A character at a time: states on entering lines, and lines without comments and literals."""
    state, entered, out = lexing.CODE, [], []
    for x in lines:
        entered.append(state)
        i, code = 0, ""
        while i < len(x):
            if state == lexing.CODE:
                if x.startswith("//", i):
                    code += " " * (len(x) - i)
                    i = len(x)
                elif x.startswith("/*", i):
                    state, i, code = lexing.BLOCK, i + 2, code + "  "
                elif x.startswith('"""', i):
                    state, i, code = lexing.TEXT, i + 3, code + "   "
                elif x[i] in "\"'":
                    quote, i, code = x[i], i + 1, code + " "
                    while i < len(x) and x[i] != quote:
                        step = 2 if x[i] == "\\" and i + 1 < len(x) else 1
                        i, code = i + step, code + " " * step
                    if i < len(x):
                        i, code = i + 1, code + " "
                else:
                    i, code = i + 1, code + x[i]
            elif state == lexing.BLOCK:
                if x.startswith("*/", i):
                    state, i, code = lexing.CODE, i + 2, code + "  "
                else:
                    i, code = i + 1, code + " "
            elif x[i] == "\\" and i + 1 < len(x):
                i, code = i + 2, code + "  "
            elif x.startswith('"""', i):
                state, i, code = lexing.CODE, i + 3, code + "   "
            else:
                i, code = i + 1, code + " "
        out.append(code)
    return entered, out


PIECES = ["/*", "*/", "//", '"""', '"', "'", "\\", "a", " ", "*", "/", "b()"]


@pytest.mark.parametrize("size", (1, 4, 1000))
def test_states_against_a_plain_lexer(spark, size):
    """Random lines whose comments and text blocks go on over lines and segments."""
    r = random.Random(size)
    files = {f"f{k}": ["".join(r.choices(PIECES, (2, 2, 1, 1, 1, 1, 1, 9, 6, 1, 1, 3), k=r.randrange(0, 9))) for _ in range(r.randrange(1, 40))] for k in range(60)}
    # A backslash at a line's end escapes nothing on it and is told as any other character.
    files = {k: [x[:-1] if x.endswith("\\") else x for x in v] for k, v in files.items()}
    rows = spark.createDataFrame([(k, n, x) for k, v in files.items() for n, x in enumerate(v)], "file string, n int, line string")
    got = {(x.file, x.n): x for x in lexing.states(rows, size=size).withColumn("code", lexing.code_of(F.col("line"), F.col("state"))).collect()}
    for k, v in files.items():
        entered, code = plain_code(v)
        assert [got[k, n].state for n in range(len(v))] == entered, v
        assert [got[k, n].code for n in range(len(v))] == code, v


def test_nothing_is_found_outside_code(spark):
    source = """// new A(1); b.c();
String s = "new B(2)"; char q = '"'; /* new C() */ new D(); // new E()
/** @Big
 * d.e();
 */ @Small int m(List<String> x) { return f(g.h().i(), (T) j(k)); }
String t = \"\"\"
  new F() \\\"\"\" l.m()
  \"\"\"; n();
public List<String> o(int p) throws Odd { this.r(); super.s(); }"""
    got = {(x.constructType, x.signature, x.lineNumber) for x in constructs.scan(spark.createDataFrame([("A", source)], "file string, content string")).collect()}
    calls = {(s, n) for k, s, n in got if k == "METHOD_INVOCATION"}
    assert calls == {("f", 5), ("g.h", 5), ("i", 5), ("j", 5), ("n", 8), ("this.r", 9), ("super.s", 9)}
    assert {(k, s, n) for k, s, n in got if k != "METHOD_INVOCATION"} == {("CONSTRUCTOR_CALL", "D", 2), ("ANNOTATION_USAGE", "Small", 5), ("TYPE_CAST", "T", 5)}


def plain_tree(text):
    """pre, post, depth and parent of each bracket of a text without literals."""
    out, open_, at = {}, [], 0
    for c in text:
        if c in "{([":
            out[at] = [None, len(open_) + 1, open_[-1] if open_ else None]
            open_.append(at)
        elif c in "})]":
            out[open_.pop()][0] = at
        at += c in "{}()[]"
    return out


def nested(r, n):
    text, depth = "", 0
    for _ in range(n):
        if depth and r.random() < 0.5:
            text, depth = text + "}", depth - 1
        else:
            text, depth = text + r.choice(("a{", "\n{", "{ b;\n")), depth + 1
    return text + "}" * depth


def test_trees_against_a_stack(spark, monkeypatch):
    monkeypatch.setattr(trees, "SIZE", 5)
    r = random.Random(1)
    files = [(f"f{k}", nested(r, 60)) for k in range(20)]
    tree = trees.with_parents(trees.nodes(spark.createDataFrame(files, "file string, content string")))
    got = {}
    for x in tree.collect():
        got.setdefault(x.file, {})[x.pre] = [x.post, x.depth, x.parent]
    want = {k: plain_tree(t) for k, t in files}
    assert got == want

    def up(k, pre):
        while (pre := want[k][pre][2]) is not None:
            yield pre

    chosen = F.col("pre") % 7 == 3
    pick = lambda f: {(x.file, x.pre) for x in f(tree, chosen).collect()}
    every = {(k, p) for k in want for p in want[k]}
    assert pick(trees.below) == {(k, p) for k, p in every if any(q % 7 == 3 for q in up(k, p))}
    assert pick(trees.above) == {(k, q) for k, p in every if p % 7 == 3 for q in up(k, p)}
    assert pick(trees.delete) == {(k, p) for k, p in every if p % 7 != 3 and not any(q % 7 == 3 for q in up(k, p))}


def test_brackets_that_match_nothing(spark):
    got = trees.nodes(spark.createDataFrame([("a", ") { ( } x [ '{' "), ("b", ""), ("c", None)], "file string, content string")).orderBy("pre").collect()
    assert [(x.pre, x.post, x.depth, x.kind) for x in got] == [(1, None, 0, "{"), (2, 3, 1, "("), (4, None, 1, "[")]


def test_trees_of_ten_thousand_levels(spark):
    deep = "".join(f"b{i} {{\n" for i in range(10_000)) + "}\n" * 10_000
    tree = trees.nodes(spark.createDataFrame([("deep", deep), ("flat", "{}" * 100)], "file string, content string"))
    left = trees.delete(tree, F.col("head") == "b7000").groupBy("file").count().collect()
    assert {x.file: x["count"] for x in left} == {"deep": 7000, "flat": 100}
    assert trees.above(tree, F.col("head") == "b9000").count() == 9000


def test_deletes_by_parents_have_no_limit(spark):
    """A chain, a circle, a parent that isn't there, and a bush."""
    rows = [(i, i - 1 if i else None) for i in range(3000)] + [(10_000, 10_001), (10_001, 10_000), (10_002, 10_001), (20_000, 99_999), (20_001, 20_000)] + [(30_000 + i, 30_000 if i else None) for i in range(50)]
    nodes = spark.createDataFrame(rows, "node_id long, parent_id long")
    left = {x.node_id for x in rewrite.delete(nodes, F.col("node_id").isin(1000, 10_000, 20_000, 30_000)).collect()}
    assert left == set(range(1000))
    left = {x.node_id for x in rewrite.delete(nodes.where("node_id >= 10000 AND node_id < 20001"), F.col("node_id") == 20_000).collect()}
    assert left == {10_000, 10_001, 10_002}


def plain_edits(found):
    kept = []
    for start, end, new, rank in sorted(set(found), key=lambda e: (e[3], e[0], -e[1], e[2])):
        if all(start >= b or a >= end for a, b, _, _ in kept):
            kept.append((start, end, new, rank))
    return sorted(kept, key=lambda e: (e[0], e[1], e[3], e[2]))


def test_edits_against_a_plain_splice(spark):
    r = random.Random(9)
    texts = {f"f{k}": "".join(r.choices("abc üö\n\t𝔘", k=60)) for k in range(30)} | {"none": "kept as it is\r\n"}
    found = [(k, a, a + r.choice((0, 0, 1, 3, 9)), r.choice(("", "X", "long new text")), r.randrange(4)) for k in list(texts)[:-1] for a in r.choices(range(52), k=9)]
    files = spark.createDataFrame([*texts.items(), ("empty", None)], "file string, content string")
    got = {x.file: x.content for x in edits.applied(files, spark.createDataFrame(found, "file string, start int, end int, new string, rank int")).collect()}
    for k, t in texts.items():
        out, at = "", 0
        for start, end, new, _ in plain_edits([e[1:] for e in found if e[0] == k]):
            out, at = out + t[at:start] + new, end
        assert got[k] == out + t[at:]
    assert got["empty"] is None


def test_deletes_of_nodes_keep_the_rest(spark):
    source = "class A {\r\n\tint x = f(1 ,2);   // f(\r\n  void m ( ) { g( ); }\r\n  String s = \"{\";\r\n}\r\n"
    files = spark.createDataFrame([("A", source)], "file string, content string")
    tree = trees.nodes(files)
    gone = edits.of_places(files, edits.deletions(tree, (F.col("kind") == "{") & F.col("head").startswith("void")))
    renamed = edits.of_pattern(files, r"\bf\(", "call(", rank=1)
    inner = edits.of_pattern(files, r"g\(", "never(", rank=2)
    got = edits.applied(files, gone.unionByName(renamed).unionByName(inner)).first().content
    assert got == source.replace("void m ( ) { g( ); }", "").replace("f(1", "call(1").replace("// f(", "// call(")
