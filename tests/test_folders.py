import pytest

from faultline.sources import readers


def test_folders_of_reports_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver holds no list of the files; what is read is what Spark's own reader has of each file, in the order of their paths."""
    monkeypatch.setattr(readers, "FILES", 4)
    texts = {
        "a b%é+.json": b'{"project": "x", "odd": 1}', "b.json": b'[{"project": "y1"}, {"project": 1.10}]', "c.json": b"", "d.json": b"[]", "e.json": '{"project": "é"}'.encode("utf-16"), "f.json": '{"project": "é"}'.encode("utf-8-sig"),
        "g.json": b'{"project": "one"}\n{"project": "two"}', "h.json": b' {"url": true, "updatedDependency": {"newVersion": 2.50, "x": [1.0], "previousVersion": {"z": 1.0,\n "q":[ ]}}, "zz": 3.0}', "A.json": b'{"project": null}',
    }
    hidden = {"_i.json": b"{", ".j.json": b"{", "k.JSON": b"{", "l.json/m.json": b"{"}
    (tmp_path / "l.json").mkdir()
    for name, content in (texts | hidden).items():
        (tmp_path / name).write_bytes(content)
    found = readers.report_files(spark, str(tmp_path))
    assert found.inputFiles() == [] and found.rdd.getNumPartitions() == 3
    alone = [r for name in sorted(texts) for r in readers.report_files(spark, str(tmp_path / name)).collect()]
    assert found.collect() == sorted(alone, key=lambda r: r.file_path) and len(alone) == 8
    assert readers.report_files(spark, f"file://{tmp_path}").collect() == found.collect()


@pytest.mark.parametrize("content", [b"{", b"null", b"3", b"[3]", b"[null]", b'{"project": "\xff"}', b'{"updatedDependency": "x"}', b'[{"project": 1}, {"project": ]'])
def test_a_malformed_report_ends_the_scan(spark, tmp_path, content):
    (tmp_path / "a.json").write_bytes(b"{}")
    (tmp_path / "b.json").write_bytes(content)
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        readers.report_files(spark, str(tmp_path)).collect()
