"""Logs of any length: segments against windows over the whole log."""

import random

from pyspark.sql import functions as F

from faultline.operators import buildlog, segments
from faultline.plans.workflows import giant_lines
from faultline.sources import readers

KINDS = ("[ERROR] A.java:[1,2] bad", "[ERROR] more", "[INFO] x", "[WARNING] w", f"{buildlog.START} here", f"{buildlog.END} x", "[ERROR] -> y")


def rows(found):
    return sorted((r.log_id, r.seq, r.filePath, r.lineNumber, r.message, tuple(r.details)) for r in found.collect())


def test_segments_against_windows(spark):
    """Random logs whose markers, skipped lines, headers and details lie on either side of segment bounds."""
    r = random.Random(4)
    data = [(f"log {k}", n, r.choices(KINDS, (6, 6, 3, 6, 1 if k % 2 else 0.1, 0.4, 1))[0]) for k in range(40) for n in range(r.randrange(1, 60))]
    lines = spark.createDataFrame(data, "log_id string, n int, line string")
    want = rows(buildlog.errors(lines))
    assert want
    for size in (1, 3, 7):
        assert rows(segments.errors(segments.segmented(lines, size=size))) == want
    line = F.col("line")
    conditions = (line.rlike("bad"), line.startswith("[W"), line.startswith("[I"))
    key = lambda df: sorted((x.log_id, x.n) for x in df.collect())
    assert key(segments.within(segments.segmented(lines, size=4), *conditions)) == key(buildlog.within(lines, *conditions))
    kept = lines.groupBy("log_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))
    kept = kept.select("log_id", buildlog.kept_lines(F.col("lines"), lambda x: x.rlike("bad"), lambda x: x.startswith("[W"), lambda x: x.startswith("[I")).alias("k"))
    assert key(kept.select("log_id", "k.first", F.posexplode("k.lines").alias("i", "line")).select("log_id", (F.col("first") + F.col("i")).alias("n"))) == key(buildlog.within(lines, *conditions))


def test_one_giant_log_spreads_over_tasks(spark, sf_dir):
    """No task gets more than a bounded share of the log's lines, and none is dealt by the log alone."""
    lines = giant_lines(spark, sf_dir)
    total, most = lines.count(), lines.groupBy("segment").count().agg(F.max("count")).first()[0]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("16", "false", "-1")):
            spark.conf.set(k, v)
        kept = segments.within(lines, F.contains("line", F.lit("none such")), F.lit(False), F.lit(False))
        shares = [r["count"] for r in kept.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(shares) == total and max(shares) <= total / 16 + 4 * most
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert most <= 32 * 12
    assert rows(segments.errors(lines)) == rows(buildlog.errors(lines.drop("segment")))


def test_a_long_log_is_read_by_splits(spark, tmp_path):
    text = "".join(f"[INFO] line {i}\r\n" for i in range(500)) + f"{buildlog.START}\n[WARNING] skipped\n" + "".join(f"[ERROR] A{i}.java:[{i},1] bad\n[ERROR] why {i}\n" for i in range(700)) + f"{buildlog.END}\n[ERROR] B.java:[1,1] late\n"
    (tmp_path / "build.log").write_text(text, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = readers.long_logs(spark, str(tmp_path))
        assert lines.select("segment").distinct().count() > 5
        got = segments.errors(lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((x.seq, x.filePath, x.details[0]) for x in got) == [(i + 1, f"A{i}.java", f"why {i}") for i in range(700)]
    assert len(got) == len(buildlog.errors_of(readers.logs(spark, str(tmp_path))).collect())


def test_errors_of_logs_in_rows_shuffle_nothing(spark):
    logs = spark.createDataFrame([("a", "x")], "log_id string, content string")
    assert "Exchange" not in buildlog.errors_of(logs)._jdf.queryExecution().executedPlan().toString()
