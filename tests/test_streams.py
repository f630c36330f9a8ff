"""Streams with offsets and state that end: logs that grow, and runs of attempts, also after a restart."""

import io
from datetime import datetime, timedelta

import pyarrow as pa
import pytest

from faultline.operators import buildlog
from faultline.streaming import attempts, growing


@pytest.mark.parametrize("block", (1, 3, 1 << 16))
def test_lines_of_parts(monkeypatch, block):
    """However a log is cut, each line comes once, with the part in which it ends; what has no end yet doesn't come."""
    monkeypatch.setattr(growing, "_BLOCK", block)
    data = b"one\n\n\xc3\xbcber\nlast but one\nno end"
    want = [(0, b"one"), (4, b""), (5, b"\xc3\xbcber"), (11, b"last but one")]
    for size in range(1, len(data) + 1):
        f = pa.PythonFile(io.BytesIO(data), mode="r")
        assert [x for a in range(0, len(data), size) for x in growing.lines_ending(f, a, min(a + size, len(data)))] == want


def test_a_log_that_grows(spark, tmp_path):
    """Three batches, a line cut in two, a log that comes later, and a restart: each line and each error once."""
    folder, out, checkpoint = tmp_path / "logs" / "p", str(tmp_path / "lines"), str(tmp_path / "cp")
    folder.mkdir(parents=True)
    text = "".join(f"[ERROR] A{i}.java:[{i},1] bad\n[ERROR] why {i}\n" for i in range(60))
    cuts = (0, len(text) // 3 + 7, len(text) // 2 + 3, len(text))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        with open(folder / "build.log", "a") as f:
            f.write(text[a:b])
        if k == 1:
            (folder / "other.log").write_text("[ERROR] B.java:[1,2] worse\r\n")
            (folder / "other.txt").write_text("[ERROR] C.java:[1,2] no log\n")
        # A new query each time, as after a restart.
        growing.keep_lines(growing.stream(spark, f"file://{tmp_path}/logs", part_bytes=100), out, checkpoint, once=True).awaitTermination()
        seen = spark.read.schema(growing.SCHEMA).parquet(f"{out}/batch=*")
        assert seen.count() == seen.distinct().count() == text[:b].count("\n") + (k >= 1)
    growing.keep_lines(growing.stream(spark, f"file://{tmp_path}/logs"), out, checkpoint, once=True).awaitTermination()
    got = sorted((r.filePath, r.seq, tuple(r.details)) for r in growing.kept_errors(spark, out, segment_bytes=64).collect())
    assert got == sorted([(f"A{i}.java", i + 1, (f"why {i}",)) for i in range(60)] + [("B.java", 1, ())])
    assert len(got) == buildlog.errors_of(spark.createDataFrame([("a", text)], "log_id string, content string")).count() + 1


def test_runs_of_attempts(spark, tmp_path):
    """An idle commit is given out once and dropped, late and disordered attempts join theirs, and a restart goes on."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    attempts.with_rocksdb(spark)
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    batches = [
        [("a", at(0), 1, "TEST_FAILURE"), ("a", at(40), 3, "BUILD_SUCCESS"), ("b", at(5), 1, "TEST_FAILURE"), ("a", at(300), 1, "TEST_FAILURE")],
        [("a", at(297), 0, "ENFORCER_FAILURE"), ("c", at(301), 1, "TEST_FAILURE"), ("c", at(301), 2, "TEST_FAILURE")],
        [("a", at(340), 2, "BUILD_SUCCESS"), ("d", at(900), 1, "TEST_FAILURE")],
        [("d", at(2000), 2, "TEST_FAILURE")],
    ]
    schema, out = "breakingCommit string, at timestamp, n int, category string", str(tmp_path / "out")
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            found = attempts.closed_runs(stream, timedelta(minutes=60))
            found.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination()
        got = sorted((r.breakingCommit, r.began, r.ended, r.attempts, ",".join(r.categories), r.finalCategory, r.succeeded) for r in spark.read.parquet(out).collect())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert got == [
        ("a", at(0), at(40), 2, "TEST_FAILURE,BUILD_SUCCESS", "BUILD_SUCCESS", True),
        ("a", at(297), at(340), 3, "ENFORCER_FAILURE,TEST_FAILURE,BUILD_SUCCESS", "BUILD_SUCCESS", True),
        ("b", at(5), at(5), 1, "TEST_FAILURE", "TEST_FAILURE", False),
        ("c", at(301), at(301), 2, "TEST_FAILURE,TEST_FAILURE", "TEST_FAILURE", False),
        ("d", at(900), at(900), 1, "TEST_FAILURE", "TEST_FAILURE", False),
    ]
