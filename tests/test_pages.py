"""Lists in pages against sorted lists."""

import random

from pyspark.sql import functions as F

from faultline.operators import combos, pages
from faultline.sources import writers


def test_pages_against_sorted_lists(spark, tmp_path):
    """A list that holds most items, groups of nulls, ties, and groups as long as a page or one more."""
    r = random.Random(6)
    rows = [("hot", 1, r.randrange(10**6)) for _ in range(3000)] + [(f"g{k}", None, i) for k in range(20) for i in range(k)] + [(None, 2, 5)] * 12
    df = spark.createDataFrame(rows, "a string, b int, v int")
    heads, found = pages.paged(df, ["a", "b"], ["v"], size=10)
    writers.write_paged(heads, found, str(tmp_path))
    heads, found = (spark.read.parquet(f"{tmp_path}/{x}").collect() for x in ("heads", "pages"))
    want = {}
    for a, b, v in rows:
        want.setdefault((a, b), []).append(v)
    assert {(h.a, h.b): (h["items"], h.pages) for h in heads} == {k: (len(v), -(-len(v) // 10)) for k, v in want.items()}
    got = {}
    for p in sorted(found, key=lambda p: p.page):
        assert len(p["items"]) <= 10
        got.setdefault((p.a, p.b), []).extend(x.v for x in p["items"])
    assert got == {k: sorted(v) for k, v in want.items()}
    assert sum(len(p["items"]) == 10 for p in found if p.a == "hot") == 300


def test_no_task_holds_a_long_list(spark):
    """Items of one group spread over ranges: none holds much more than its share."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        df = spark.range(20_000).select(F.lit("one").alias("g"), F.col("id").alias("v"))
        shares = [x["count"] for x in pages.ranked(df, ["g"], "v").groupBy(F.spark_partition_id()).count().collect()]
        assert max(shares) < 20_000 / 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_combinations_with_all_their_records(spark):
    dependency = "struct<dependencyGroupID:string,dependencyArtifactID:string,previousVersion:string,newVersion:string>"
    rows = [("p1", f"c{i:03}", None if i % 2 else "X", ("g", "a", "1", "2")) for i in range(25)] + [("p2", "d", "Y", ("g", None, "1", "2"))]
    df = spark.createDataFrame(rows, f"project string, breakingCommit string, failureCategory string, updatedDependency {dependency}")
    heads, found = combos.combination_pages(df, size=10)
    assert {(h["list"], h["count"], h["items"], h.pages) for h in heads.collect()} == {("projects", 25, 1, 1), ("breakingCommits", 25, 25, 3), ("failureCategories", 25, 1, 1), ("records", 25, 25, 3)}
    records = [x.record.breakingCommit for p in sorted(found.where("list = 'records'").collect(), key=lambda p: p.page) for x in p["items"]]
    assert records == [f"c{i:03}" for i in range(25)]
