import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from faultline.llm import quality_classifier, quality_rules

SCHEMA = "doc_id long, text string, n_words string, score string"


def base(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, t in enumerate(tri) if tri.count(t) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \t\n", "a", "a b", "a b c", "a a a a", "a b c a b c", "é ß\x0bü\x0c×|<\r\n" * 9, "x\n\nx\n x\nx", "one two three four " * 40, "a\xa0b c " * 30, "w " * 3000, "ends  with spaces   "]


def test_base_against_brute_force(spark):
    rows = [(i % 9 or None, t) for i, t in enumerate(TEXTS + TEXTS)]
    got = quality_rules.judge(spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")).collect()
    key = lambda x: repr(x)
    want = sorted(((i, *base(t)) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.rejected_by is None) and not (r.base_failed and r.kept)


def test_rules_on_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality_rules.judge(empty).collect() == []


def test_rules_keep_clean_texts(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    rows = quality_rules.judge(docs.select("doc_id", "text")).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.2 * len(bad)


def test_each_rule_rejects_what_it_is_for(spark):
    plain = "the river and the hill of that old town with a quiet road to walk in every day of spring or autumn when leaves fall over stones near water and people talk about work food rain songs trade gardens boats bread clocks letters winter lamps horses roofs doors kitchens fields barns ladders market squares bells"
    texts = {
        "many symbols": plain + " # * $ % & | < > # * $",
        "lines repeat": "\n".join(f"a{i} b{i} c{i} d{i} e{i} the of" if i < 4 else "x y z" for i in range(20)) + plain,
        "words too short or long": " ".join("a b c d e f g h i j k l m n o p q r s t u v w x y z".split() + [f"{c}" for c in "\u03b1\u03b2\u03b3\u03b4\u03b5\u03b6\u03b7\u03b8\u03b9\u03ba\u03bb\u03bc\u03bd\u03be\u03bf\u03c0\u03c1\u03c3\u03c4\u03c5"] + ["the", "of"] * 2),
        "few letters": " ".join(f"{i}{i * 7}" for i in range(100, 160)) + " the of",
        "mostly capitals": plain.upper().replace("THE", "the").replace("OF", "of"),
        "no stop words": " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)),
        "one pair of words prevails": " ".join(f"the of w{chr(97 + i % 26)}{chr(97 + i // 26)} v{chr(97 + i % 26)}{chr(98 + i // 26)}" for i in range(40)),
        "few different words": " ".join(random.Random(1).choices(["the", "of", "alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"], k=400)),
        "lines end in dots": "\n".join(f"the of w{chr(97 + i)} v{chr(97 + i)} u{chr(97 + i)}..." for i in range(20)),
        "lines are bullets": "\n".join(f"- the w{chr(97 + i)} of v{chr(97 + i)} u{chr(97 + i)}" for i in range(20)),
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([plain, *texts.values()])], "doc_id int, text string")
    metrics = quality_rules.metrics(rows)
    hits = {r.doc_id: [x.name for x, hit in zip(quality_rules.RULES, r.hits) if hit] for r in metrics.select("row.doc_id", F.array(*[F.expr(x.rejects) for x in quality_rules.RULES]).alias("hits")).collect()}
    assert hits[0] == [] and quality_rules.judge(rows.where("doc_id = 0")).first().kept
    for i, name in enumerate(texts, 1):
        assert name in hits[i], (name, hits[i])
    assert set(texts) == {r.name for r in quality_rules.RULES}


def test_the_order_saves_work(spark, sf_dir):
    """Over a whole table the chosen order asks for less time, by the measured costs, than the opposite one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    left = quality_rules.metrics(docs).where(f"NOT {quality_rules.BASE}")
    cost = {r.name: ns for r, (_, ns) in zip(quality_rules.RULES, quality_rules.measured(left))}
    assert all(ns > 0 for ns in cost.values())
    chosen = quality_rules.order(docs)
    assert sorted(chosen) == sorted(quality_rules.RULES)
    rows = left.select(*[F.expr(r.rejects).alias(r.name) for r in quality_rules.RULES]).collect()

    def spent(rules):
        total = asked = 0
        for row in rows:
            for rule in rules:
                total, asked = total + cost[rule.name], asked + 1
                if row[rule.name]:
                    break
        return total, asked

    assert spent(chosen)[0] < spent(chosen[::-1])[0]
    assert sum(any(row) for row in rows) > 0


def test_classifier_on_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    rows = quality_classifier.train_and_score(docs, labels).withColumn("out", quality_classifier.held_out()).join(labels.select("doc_id", "quality"), "doc_id").collect()
    for r in rows:
        assert r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    out = [r for r in rows if r.out]
    assert sum(r.predicted == r.quality for r in out) >= 0.95 * len(out)


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "", ""), (2, "", "", ""), (None, "fine words here", "", ""), (3, "### *** $$$ " * 20000, "", ""), (3, "BAD!! " * 9, "", "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.predicted for r in quality_classifier.train_and_score(docs.select("doc_id", "text"), none).collect()} == {1}
    some = spark.createDataFrame([(1, 1), (1, 0), (None, 0), (3, 0), (2, 1), (2, None)], "doc_id long, quality int")
    got = quality_classifier.train_and_score(docs.drop("score"), some).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.train_and_score(docs.drop("score").limit(0), some).collect() == []


def plain_counts(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    if not w:
        return [0.0] * 8
    n, t, lines = len(w), text, [x for x in text.split("\n") if x]
    letter = lambda c: c.isalpha() and (c.isascii() or True)
    return [
        min(1, len(re.findall("[#*$%&|<>]", t)) / n),
        min(1, t.count("!") / n),
        len(re.findall("[A-Z\u00c0-\u00de]", t)) / len(t),
        sum(map(letter, t)) / len(t),
        sum(a == b for a, b in zip(w, w[1:])) / n,
        1 - math.log2(1 + len(set(w))) / max(math.log2(1 + n), 1),
        1 - max(len(set(lines)), 1) / max(len(lines), 1),
        min(1, len(t.encode()) / n / 20),
    ]


def test_features_against_plain_python():
    texts = [None, "", " \n ", "A b  b\nA b b\n", "ÉTÉ été!! #tag é", "one two one two\r\nThree", "x" * 50, "the end. " * 40]
    got = quality_classifier.features(pa.array(texts, pa.string()))
    assert np.allclose(got[:, :8], [plain_counts(t) for t in texts], atol=1e-6)
    for t, row in zip(texts, got):
        size = len((t or "").encode())
        assert abs((row[8 : 8 + 256] ** 2).sum() - (size > 1)) < 1e-5 and abs((row[8 + 256 :] ** 2).sum() - (len((t or "").split()) > 0)) < 1e-5


def test_weights_minimise_the_loss_over_all_pairs():
    """30 rows: every pair is learned from, the gradient is that of the loss, and it is zero at the weights."""
    rng = np.random.default_rng(5)
    good, bad = rng.normal(size=(18, 4)) + 0.4, rng.normal(size=(12, 4))
    w = quality_classifier.bradley_terry(good, bad, ridge=0.01)

    def loss(w):
        return sum(math.log1p(math.exp(-(a - b) @ w)) for a in good for b in bad) / (18 * 12) + 0.005 * w @ w

    diff = np.array([a - b for a in good for b in bad])
    for at in (w, rng.normal(size=4)):
        numeric = [(loss(at + h) - loss(at - h)) / 2e-5 for h in np.eye(4) * 1e-5]
        assert np.allclose(numeric, quality_classifier.gradient(at, diff, 0.01), atol=1e-6)
    assert np.abs(quality_classifier.gradient(w, diff, 0.01)).max() < 1e-8


def test_scores_are_those_of_the_model(spark):
    rng = np.random.default_rng(7)
    x = rng.random((30, 8 + 512)).astype(np.float32)
    y = np.arange(30) % 3 > 0
    model = quality_classifier.learned(x.astype(float), y)
    strength = np.sort(x @ model.weights + model.offset)
    assert strength[9] < math.log(0.7 / 0.3) < strength[10]  # ten are labelled bad
    texts = ["good words here", None, "BAD!! " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = 1 / (1 + np.exp(-(quality_classifier.features(pa.array(texts)) @ model.weights + model.offset)))
    got = {r.row.doc_id: (r.score, r.predicted) for r in quality_classifier.scored(df, model).collect()}
    assert all(abs(got[i][0] - want[i]) < 1e-9 and got[i][1] == (want[i] >= 0.7) for i in range(3))
