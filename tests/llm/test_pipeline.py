import zlib
from array import array

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from faultline.llm import pii, quality_classifier
from faultline.llm.queries import LANGUAGE_TARGETS
from faultline.llm.tokens import default_path
from tests.llm.test_links import brute_texts
from tests.llm.test_pii import brute


@pytest.fixture(scope="module")
def small(spark, sf_dir, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("small"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.unionByName(docs.where("doc_id % 50 = 7")).write.parquet(f"{where}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{where}/labels.parquet")
    return where


def test_run_against_brute_force(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    docs, labels = (spark.read.parquet(f"{small}/{x}.parquet") for x in ("documents", "labels"))
    good = {r.doc_id: r.text for r in quality_classifier.train_and_score(docs, labels).where("predicted = 1").collect()}
    stay = {i for i, (_, top) in brute_texts(sorted(good.items())).items() if top == i}
    assert {r.doc_id for r in rows} == stay
    share = {}
    for r in docs.dropDuplicates(["doc_id"]).collect():
        if r.doc_id in stay:
            share[r.lang] = share.get(r.lang, 0) + len(good[r.doc_id].split()) * max(1, sum(x.doc_id == r.doc_id and x.piece == 0 for x in rows))
    for lang, aim in LANGUAGE_TARGETS.items():  # whole copies only come near the targets
        assert abs(share[lang] / sum(share.values()) - aim) < 0.06
    model, want = Tokenizer.from_file(default_path()), {}
    for i in stay:
        base, more = pii.spans_of(pa.array([good[i]], pa.string()), pii.default_field())[0]
        assert base == brute(good[i])
        ids = [*model.encode(pii.masked(good[i] or "", base + more), add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[i, k] = (at, len(ids[at : at + 4096]), zlib.crc32(array("I", ids[at : at + 4096]).tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 4096


def test_different_texts_of_one_id_stay(spark, small, tmp_path):
    rows = spark.createDataFrame([(1, "one text of its own " * 9, "en", "s", 0), (1, "quite another text here " * 9, "en", "s", 0), (None, "a third text without an id " * 9, "en", "s", 0), (None, "and a fourth one " * 9, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert corpus_pipeline.near_duplicates(spark, docs, small).count() == 4


def test_stages_keep_columns_and_take_odd_rows(spark, small):
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (None, "a b c", "xx", "s", 5), (2, "w " * 50_000, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (odd, odd.limit(0)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            path = f"{small}/odd-{name}-{rows is odd}"
            out = stage(spark, docs, small)
            assert out.columns == odd.columns
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() >= docs.count()
