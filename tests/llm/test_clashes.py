"""Columns named like helpers or results neither crash an operator or a stage nor get lost in a stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import fim, fingerprint, lattice, licenses, mixing, ngram_join, packing, pii, quality_classifier, quality_rules, secrets, trie, warc

NAMES = ("_w", "_text", "_lines", "f_symbols", "domain", "rate", "kept", "id", "n", "label", "row", "file", "at", "score", "predicted", "n_words", "group", "own", "others", "times", "nth", "length", "task", "spans", "license", "candidate", "Text_", "_metadata")
ROWS = [(1, None), (1, "other words under the same id " * 12), (None, ""), (None, "w x y z " * 30), (2, "fine words of some length are here " * 10), (2, "fine words of some length are here " * 10), (3, "BAD!! ### " * 40), (4, "v " * 60_000)]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return base.withColumns({n: F.lit(f"their {n}") for n in NAMES})


LABELS = [(1, 1, 0), (2, 1, 0), (3, 0, 0), (4, 1, 0)]
OPERATORS = {
    "op1": quality_rules.judge,
    "op2": pii.find,
    "op2 redact": pii.redact,
    "op3": packing.pack,
    "op4": licenses.scan,
    "op5": secrets.scan,
    "op6": ngram_join.join,
    "op6 rows": ngram_join.deduplicated,
    "op8": lambda d: quality_classifier.train_and_score(d, d.sparkSession.createDataFrame(LABELS, "doc_id long, quality int, toxic int")),
    "op11": fingerprint.of_documents,
    "op13": fim.transform,
    "op10": lambda d: mixing.apply(d, mixing.fit(d, d.select("doc_id", F.lit("en").alias("domain")), {"en": 0.5, "de": 0.5}, total=0.0)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_take_clashing_columns(docs, name):
    got = OPERATORS[name](docs)
    assert got.count() >= {"op5": 0, "op6 rows": 6}.get(name, len(ROWS))
    assert len(set(got.columns)) == len(got.columns)
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_vectors_and_pages_take_clashing_columns(spark):
    more = {n: F.lit("theirs") for n in NAMES if n != "label"}
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, None, 1)], "vec_id long, embedding array<float>, label int").withColumns(more)
    assert lattice.near_duplicates(vectors).count() == 3
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string").withColumns(more)
    assert {r.refers_to for r in warc.deduplicated(pages).collect()} == {None, 2}


def test_conversations_take_clashing_columns(spark):
    more = {n: F.lit("theirs") for n in (*NAMES, "turns", "ids", "words", "key", "kind", "part", "base", "head", "h", "t")}
    rows = spark.createDataFrame([(c, k, "user" if k else None, f"a b {k * c % 3}") for c in range(8) for k in range(5)], "conv_id long, turn long, role string, text string")
    plain, clashing = (sorted(map(tuple, trie.of_conversations(x).collect()), key=repr) for x in (rows, rows.withColumns(more)))
    assert plain == clashing and len(plain) >= 3


def test_stages_keep_clashing_columns_and_different_texts(spark, docs, tmp_path):
    where = str(tmp_path)
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    held = ngram_join.join(docs), lattice.near_duplicates(spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<double>, label int"))
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, where)
        assert out.columns == docs.columns
        out.write.parquet(f"{where}/{name}")
        rows = spark.read.parquet(f"{where}/{name}")
        for n in NAMES:
            assert rows.where(F.col(f"`{n}`") != f"their {n}").count() == 0
    texts = {(r.doc_id, (r.text or "")[:9]) for r in rows.collect()}
    assert {(1, "other wor"), (2, "fine word"), (4, "v v v v v")} <= texts
    assert rows.where("doc_id = 2").count() <= 2
    assert corpus_pipeline.STAGES[-1][1](spark, rows, where).count() >= rows.count()
    # Results made before are still there.
    assert held[0].count() == len(ROWS) and held[1].count() == 1


def test_rows_of_a_filter_by_chance_are_written_first(spark, tmp_path):
    """Places of what may differ from one reading to the next are those of a written table."""
    from faultline.llm.shared import Workspace, located

    spark.range(1000).withColumn("text", F.lit("x")).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    with Workspace(spark, "by-chance") as space:
        rows = located(docs.where(F.rand() < 0.5), space)
        first, second = ({(r.file, r["at"], r.row.id) for r in rows.collect()} for _ in range(2))
        assert first == second and 300 < len(first) < 700
        assert located(docs.where("id > 5"), space).count() == 994
