"""Inherited members, types of a classpath, and types that flow, against plain restatements."""

import random

from pyspark.sql import functions as F

from faultline.operators import flow, inheritance, resolve


def plain_ancestors(supers):
    out = {}
    for t in {x for e in supers for x in e}:
        near, d = {t}, 0
        while near:
            d += 1
            near = {s for x in near for a, s in supers if a == x and s != t and (t, s) not in out}
            out |= {(t, s): d for s in near}
    return out


def test_ancestors_of_chains_diamonds_and_circles(spark):
    chain = [(f"t{i:03}", f"t{i + 1:03}") for i in range(150)]
    for supers in ([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"), ("x", "x")], [("a", "b"), ("b", "c"), ("c", "a"), ("z", "b")], chain):
        got = {(r.type, r.ancestor): r.distance for r in inheritance.ancestors(spark.createDataFrame(supers, "type string, super string")).collect()}
        assert got == plain_ancestors([e for e in supers if e[0] != e[1]])
    assert inheritance.ancestors(spark.createDataFrame([], "type string, super string")).count() == 0


def test_a_method_that_moves_up_is_not_removed(spark):
    supers = spark.createDataFrame([("Sub", "Base"), ("Base", "Root"), ("Sub", "Face")], "type string, super string")
    rows = lambda *x: spark.createDataFrame(x, "type string, name string, returns string, private boolean")
    old = rows(("Sub", "moved", "int", False), ("Sub", "gone", "int", False), ("Base", "own", "int", True), ("Root", "hidden", "a", False), ("Sub", "hidden", "b", False), ("Face", "twice", "c", False), ("Base", "twice", "c", False))
    new = rows(("Base", "moved", "int", False), ("Root", "hidden", "a", False), ("Base", "own", "int", True), ("Face", "twice", "c", False), ("Base", "twice", "d", False))
    got = {(r.type, r.name): (r.changeStatus, r.moved.oldValue, r.moved.newValue) for r in inheritance.compare_effective((old, supers), (new, supers), ["name"], ["returns"], ~F.col("private")).collect()}
    assert got == {
        ("Sub", "moved"): ("UNCHANGED", "Sub", "Base"),
        ("Base", "moved"): ("NEW", None, "Base"),
        ("Sub", "gone"): ("REMOVED", "Sub", None),
        ("Sub", "hidden"): ("MODIFIED", "Sub", "Root"),
        ("Sub", "twice"): ("MODIFIED", "Base", "Base"),
        ("Base", "twice"): ("MODIFIED", "Base", "Base"),
    }


def test_longest_packages(spark):
    index = spark.createDataFrame([("a.b", 1, "x"), ("a.b.c", 2, "y"), ("a.b.c", 0, "z"), ("a", 9, "w"), ("a.bc", 3, "v")], "prefix string, position int, artifact string")
    names = spark.createDataFrame([("a.b.c.D",), ("a.b.D",), ("a.bcd.E",), ("a.bc.E",), ("b.F",), (None,), ("a.b.c",), ("a.b.c.D",)], "name string")
    got = {r.name: r.artifact for r in resolve.longest_prefix(names, index, "position").collect()}
    assert got == {"a.b.c.D": "z", "a.b.D": "x", "a.bcd.E": "w", "a.bc.E": "v", "a.b.c": "z"}


def test_flow_by_reaching(spark):
    """Random graphs with circles, conflicts and ends that nothing declares, and a chain of 3,000."""
    r = random.Random(3)
    nodes = [(i, r.choice(("int", "str")) if r.random() < 0.15 else None) for i in range(150)]
    edges = [(r.randrange(150), r.randrange(160)) for _ in range(170)]
    nodes += [(1000 + i, "end" if i == 2999 else None) for i in range(3000)]
    edges += [(1000 + i, 1001 + i) for i in range(2999)]
    types, out = dict(nodes), {}
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    for n, t in nodes[:150]:
        found, todo, seen = set(), [n], {n}
        while todo:
            x = todo.pop()
            if types.get(x):
                found.add(types[x])
            else:
                new = to.get(x, set()) - seen
                seen |= new
                todo += new
        out[n] = t or (found.pop() if len(found) == 1 else flow.UNKNOWN)
    got = {x.node_id: x.type for x in flow.typed(spark.createDataFrame(nodes, "node_id long, type string"), spark.createDataFrame(edges, "node_id long, source long")).collect()}
    assert {n: got[n] for n in out} == out
    assert all(got[1000 + i] == "end" for i in range(3000)) and len(got) == len(nodes)
