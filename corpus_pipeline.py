"""A training corpus in five stages, each by one operator of faultline.llm.

1. quality: documents that the classifier predicts to be bad go.
2. near_duplicates: of each component of texts linked by 5-word shingles one row stays,
   that with the smallest doc_id.
3. private: personal data is masked.
4. mixture: documents repeat until expected tokens by language meet the targets; none
   is used less than once, so a repeated row has its document's doc_id.
5. packing: what is left is packed into sequences of 4096 tokens.

Stages read their predecessor's rows only; labels are joined by doc_id. All but the last
return the columns that they get, under their names, whatever others the tables have;
helpers never share a name space with them.

Defined results: rows are told apart by their places, never by doc_id, so different
texts that share a doc_id, or have none, are documents of their own. Null and empty
texts get a score as others do, have no duplicates, and are packed as a closing id each.
Of rows that repeat one stays. A very long text is held whole by one task at a time and
is cut by packing only. Ties: equal scores fare alike; of equal doc_ids in a component
the first by its place stays. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import mixing, ngram_join, packing, pii, quality_classifier
from faultline.llm.queries import LANGUAGE_TARGETS, labelled_languages
from faultline.llm.shared import Workspace, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learned from the labels among them, predicts to be good."""
    return quality_classifier.predicted_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, and all others."""
    return ngram_join.deduplicated(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each as often as its rate says and once at least."""
    mix = mixing.fit(docs, labelled_languages(docs, table(spark, sf_dir, "labels")), LANGUAGE_TARGETS, least=1.0)
    return mixing.repeated(docs, mix)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("private", private), ("mixture", mixture), ("packing", pack)]

#: Training, shingle joins and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's output is written before the next, and goes when that has been written."""
    docs, space = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        before, space = space, Workspace(spark, f"stage-{name}")
        docs = space.keep(out, "docs")
        if before:
            before.release()
    return docs
