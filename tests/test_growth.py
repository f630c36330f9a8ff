"""Queries over tables of many copies: what they make grows with the rows, not with their square."""

import pytest
from pyspark.sql import functions as F

from faultline.operators import edits, trees
from faultline.plans import runner, workflows

COPIES = 600


@pytest.fixture(scope="module")
def copied(spark, sf_dir, tmp_path_factory):
    """Parts COPIES times, with keys that are alike by all the numbers that the queries divide them by."""
    folder = tmp_path_factory.mktemp("copied")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey < 200")
    part.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).withColumn("p_partkey", F.col("p_partkey") + F.col("i") * 2100).drop("i").write.parquet(f"{folder}/part.parquet")
    part.write.parquet(f"{folder}-one/part.parquet")
    return str(folder), f"{folder}-one"


def within_a_minute(spark, query, folder):
    out = next(iter(runner.run(spark, [("query", lambda: query(spark, folder).collect())], limit=60)))
    assert out.successful, out.error
    return out.value


def test_simple_names_with_many_members(spark, copied):
    """Usages times members would be 40,000 times 20,000 a type."""
    want = {r.p_partkey: r.n for r in workflows.impacts_by_simple_name(spark, copied[1]).collect()}
    got = within_a_minute(spark, workflows.impacts_by_simple_name, copied[0])
    assert len(got) == COPIES * len(want) and all(r.n == want[r.p_partkey % 2100] for r in got) and max(want.values()) > 0


def test_reports_of_many_constructs(spark, copied):
    """Each of the constructs on a line meets as many changes as there are copies."""
    want = {(r.file, r.lineNumber): r for r in workflows.impact_reports(spark, copied[1]).collect()}
    classes = {(r.file, r.lineNumber): r.n for r in workflows._usages(spark, copied[1]).where("p_partkey % 3 = 0").groupBy("file", "lineNumber").agg(F.count("*").alias("n")).collect()}
    got = within_a_minute(spark, workflows.impact_reports, copied[0])
    assert len(got) == len(want) > 0
    for r in got:
        one, c = want[r.file, r.lineNumber], classes.get((r.file, r.lineNumber), 0)
        assert r.constructs == COPIES * one.constructs and r.changes == COPIES * (c + COPIES * (one.changes - c))


def test_names_with_many_members(spark, copied):
    want = {r.p_partkey: r.n for r in workflows.impacts(spark, copied[1]).collect()}
    got = within_a_minute(spark, workflows.impacts, copied[0])
    assert len(got) == COPIES * len(want) and all(r.n == want[r.p_partkey % 2100] * (COPIES if r.p_partkey % 3 == 1 else 1) for r in got)


def test_nothing_is_broadcast_that_grows_with_nodes(spark, tmp_path):
    """Few bytes of texts have many nodes, which a size guessed from the texts would broadcast."""
    files = spark.range(40).selectExpr("CAST(id AS STRING) AS file", "repeat('void gone() { a(b[1]); }\n', 50) AS content")
    files.write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    tree = trees.nodes(files)
    chosen = F.col("kind") == "{"
    gone = edits.deletions(tree, chosen)
    for made in (trees.with_parents(tree), trees.above(tree, chosen), trees.below(tree, chosen), trees.delete(tree, chosen), edits.applied(files, edits.of_places(files, gone))):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert tree.count() == 40 * 50 * 4 and trees.above(tree, F.col("kind") == "[").count() == 40 * 50 * 2
