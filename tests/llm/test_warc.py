import base64
import hashlib
import io

import pytest
import zstandard

from faultline.llm import warc
from faultline.llm.shared import Workspace


def expected(pages, least=0):
    body = [((h or "").encode()) for _, _, h in pages]
    top = {}
    for (i, *_), b in zip(pages, body):
        if i is not None:
            top[b] = max(top.get(b, i), i)
    out = []
    for (i, u, _), b in zip(pages, body):
        ref = top.get(b) if len(b) >= least and body.count(b) > 1 else None
        ref = None if ref == i else ref
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


PAGES = [(1, "http://a/\r\nX: y", None), (2, None, ""), (3, "http://b", "é\r\n\r\nWARC/1.1\r\n"), (4, "http://b", "é\r\n\r\nWARC/1.1\r\n"), (4, "http://b", "é\r\n\r\nWARC/1.1\r\n"), (None, "http://c", "same"), (9, "http://d", "same"), (None, "u", "alone"), (10, "long", "<p>" * 1_000_000)]


def test_round_trip_and_random_access(spark):
    df = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, record_id string, at int")
    for least, frame in ((0, 100), (5, 1 << 18)):
        folder = Workspace(spark, "warc").path
        index = warc.write(df, folder, least_bytes=least, frame_bytes=frame, bundle_bytes=500)
        assert rows(warc.read(spark, folder)) == expected(PAGES, least)
        entries, seen = index.collect(), set()
        assert len(entries) == len(PAGES)
        for e in entries:
            head, block, end = warc.parse(warc.read_record(e.file, e.frame_at, e.frame_size, e.at, e.size))
            assert end == e.size and head["x-page-id"] == f"<urn:page:{'' if e.record_id is None else e.record_id}>"
            seen.add(head["warc-record-id"])
        assert len(seen) == len(PAGES)  # though pages' ids repeat or are null
        for name in {e.file for e in entries}:
            with warc._open(name) as f:
                place, size, _ = warc.seek_table(f)[0]
                f.seek(place)
                head, block, _ = warc.parse(zstandard.ZstdDecompressor().decompress(f.read(size)))
            assert head["warc-type"] == "warcinfo" and head["warc-filename"] == name.rsplit("/", 1)[1] and b"WARC" in block


def test_empty(spark):
    folder = Workspace(spark, "warc").path
    assert warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder).collect() == []
    assert warc.read(spark, folder).collect() == []


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = Workspace(spark, "warc").path
    warc.write(pages, folder)
    assert rows(warc.read(spark, folder)) == expected([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_frames_are_plain_zstandard():
    out = io.BytesIO()
    out.close = lambda: None
    b = warc.Bundle(out)
    b.frame(b"one" * 50)
    b.frame(b"two" * 50)
    b.close()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read() == b"one" * 50 + b"two" * 50
    assert [x[2] for x in warc.seek_table(out)] == [150, 150]


def test_frames_beyond_the_seek_table_are_refused():
    class Long(bytes):
        def __len__(self):
            return 1 << 32

    with pytest.raises(ValueError, match="too long"):
        warc.Bundle(io.BytesIO()).frame(Long())
