"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its text: eight counts, and the
shares of hashed pairs of bytes and of hashed words. The weights make the text labelled
better win its preference pairs: logistic loss on differences of features. The decision
is a quantile of the strengths of the labelled texts, the one that parts off as many as
are labelled bad; it becomes the score 0.7.

Texts are looked at in numpy batches of about 1 MB, or one text. Learned from all labelled
rows that aren't held out and all of their pairs: their features are written once to the
shared folder, and each step of Newton's method sums them up in tasks, whose sums are all
that reaches the driver.

Defined results: null and empty texts have zero features and get a score; a very long
text is looked at whole; equal strengths get equal scores; several labels of a document
are averaged, and a draw drops it; with labels of one kind only all scores are 0.7;
null doc_ids are scored and not held out; rows that repeat get a row each; an empty
table gives an empty result, and without labelled texts all scores are 0.7. Columns of
the input stay, whatever their names, but for those named score or predicted, which
train_and_score() replaces and predicted_good() keeps.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import words
from faultline.llm.shared import Workspace, column, flattened, nested, sliced, with_text

COUNTS = ("symbols", "shouts", "capitals", "letters", "repeats", "distinct", "same_lines", "word_length")
WIDE = 256
#: Rows that are summed up together.
CHUNK = 1000
#: Between nodes of the grid of strengths.
STEP = 0.125
#: Ranges that strengths are counted in at once, and strengths that are looked at one by one.
BINS, MOST = 4096, 10_000
_SYMBOL, _LETTER, _CAPITAL = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[[*b"#*$%&|<>"]] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC2, 256)]] = True
_CAPITAL[65:91] = True


class Model(NamedTuple):
    weights: np.ndarray
    offset: float


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def distinct(group: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different values of h each of n groups has."""
    order = np.lexsort((h, group))
    g, v = group[order], h[order]
    new = np.ones(len(v), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[new], minlength=n)


def features(texts: pa.Array) -> np.ndarray:
    """A row for each text: COUNTS, all within 0 and 1, and words.shares."""
    data, bounds = words.flat(texts)
    starts, ends = words.words(data, bounds)
    n = len(texts)
    first = np.searchsorted(starts, bounds)
    count = np.diff(first)
    some, size = np.maximum(count, 1), np.diff(bounds)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds])
    points = np.maximum(per((data & 0xC0) != 0x80), 1)
    upper = _CAPITAL[data]
    upper[:-1] |= (data[:-1] == 0xC3) & (data[1:] < 0x9F) & (data[1:] >= 0x80)
    text, h = np.repeat(np.arange(n), count), words.hashes(data, starts, ends)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    line_starts, line_ends = words.runs((data != 10).view(np.uint8), bounds)
    line = np.searchsorted(bounds, line_starts, "right") - 1
    lines = np.maximum(np.bincount(line, minlength=n), 1)
    counts = np.stack(
        [
            np.minimum(1, per(_SYMBOL[data]) / some),
            np.minimum(1, per(data == 33) / some),
            per(upper) / points,
            per(_LETTER[data]) / points,
            np.bincount(text[again], minlength=n) / some,
            1 - np.log2(1 + distinct(text, h, n)) / np.maximum(np.log2(1 + count), 1),
            1 - np.maximum(distinct(line, words.hashes(data, line_starts, line_ends), n), 1) / lines,
            np.minimum(1, size / some / 20),
        ],
        1,
    )
    counts[count == 0] = 0
    return np.concatenate([counts.astype(np.float32), words.shares(data, bounds, starts, ends, WIDE)], 1)


def gradient(w: np.ndarray, diff: np.ndarray, ridge: float) -> np.ndarray:
    """Of the mean logistic loss of pairs, whose rows are better less worse, and ridge / 2 * w^2."""
    p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
    return diff.T @ (p - 1) / len(diff) + ridge * w


def nodes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each strength the eight nodes of the grid about it, and its weights by Lagrange's polynomials."""
    low = np.floor(s / STEP)
    t = (s / STEP - low)[:, None]
    at = np.arange(-3, 5)
    weights = np.stack([np.prod([(t[:, 0] - m) / (o - m) for m in at if m != o], 0) for o in at], 1)
    return low.astype(np.int64)[:, None] + at, weights


class Side(NamedTuple):
    """Of rows of one label: nodes in use, rows at each, and the sum of their features."""

    ids: np.ndarray
    count: np.ndarray
    total: np.ndarray


def side(x: np.ndarray, w: np.ndarray) -> Side:
    at, weights = nodes(x @ w)
    ids, place = np.unique(at, return_inverse=True)
    dealt = np.zeros((len(x), len(ids)))
    np.put_along_axis(dealt, place.reshape(at.shape), weights, 1)
    return Side(ids, dealt.sum(0), dealt.T @ x)


def both(a: tuple, b: tuple) -> tuple:
    """The sums of two parts: Sides node by node, arrays and numbers as they are."""

    def one(p, q):
        if not isinstance(p, Side):
            return p + q
        ids, place = np.unique(np.concatenate([p.ids, q.ids]), return_inverse=True)
        out = Side(ids, np.zeros(len(ids)), np.zeros((len(ids), p.total.shape[1])))
        for part, where in ((p, place[: len(p.ids)]), (q, place[len(p.ids) :])):
            out.count[where] += part.count
            out.total[where] += part.total
        return out

    return tuple(one(p, q) for p, q in zip(a, b))


#: Sums over all rows: of(features, whether good) gives a tuple for some rows, summed by both().
Sums = Callable[[Callable[[np.ndarray, np.ndarray], tuple]], tuple]


def in_memory(x: np.ndarray, y: np.ndarray) -> Sums:
    return lambda of: functools.reduce(both, (of(x[k : k + CHUNK], y[k : k + CHUNK]) for k in range(0, max(len(x), 1), CHUNK)))


def in_tasks(rows: DataFrame) -> Sums:
    """rows: good, x. A task sums its rows up, two a core at any size of the table; then some tasks what the others have, if those are many."""
    rows = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    parts = rows.rdd.getNumPartitions()

    def summed(of: Callable) -> tuple:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for k in range(0, batch.num_rows, CHUNK):
                    piece = batch.slice(k, CHUNK)
                    x = np.stack([np.frombuffer(v.as_buffer(), np.float32) for v in piece.column("x")])
                    found = of(x, piece.column("good").to_numpy(zero_copy_only=False).astype(bool))
                    total = found if total is None else both(total, found)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for v in batch.column("part"):
                    found = pickle.loads(v.as_buffer())
                    total = found if total is None else both(total, found)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

        found = rows.mapInArrow(part, "part binary")
        if parts > 32:
            found = found.repartition(math.isqrt(parts)).mapInArrow(merge, "part binary")
        return functools.reduce(both, (pickle.loads(v.as_buffer()) for v in found.toArrow().column("part")))

    return summed


def newton(summed: Sums, scale: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of features over scale that minimise the mean logistic loss over all pairs of a better and a worse row.

    What the loss asks of a pair is a smooth function of the difference of two strengths, so rows are summed up on a
    grid of strengths and the grid's nodes meet in pairs: all pairs count (to about 1e-9 of each) in time linear in the rows.
    """
    w = np.zeros(len(scale))
    for _ in range(30):
        at = w
        good, bad = summed(lambda x, y: tuple(side(x[m] / scale, at) for m in (y, ~y)))
        n = good.count.sum() * bad.count.sum()
        p = 1 / (1 + np.exp(-np.clip((good.ids[:, None] - bad.ids) * STEP, -700, 700)))
        q = p * (1 - p)
        slope = (good.total.T @ ((p - 1) @ bad.count) - bad.total.T @ (good.count @ (p - 1))) / n + ridge * w
        curves = (good.ids, q @ bad.count / n), (bad.ids, good.count @ q / n)

        def second(x: np.ndarray, y: np.ndarray) -> tuple:
            out = np.zeros((len(at), len(at)))
            for rows, (ids, curve) in zip((x[y] / scale, x[~y] / scale), curves):
                where, weights = nodes(rows @ at)
                # A node that rounding puts beside those in use has the curve's value at the nearest.
                out += (rows * (curve[np.minimum(np.searchsorted(ids, where), len(ids) - 1)] * weights).sum(1)[:, None]).T @ rows
            return (out,)

        cross = good.total.T @ q @ bad.total / n
        step = np.linalg.solve(summed(second)[0] - cross - cross.T + ridge * np.eye(len(w)), slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def bradley_terry(good: np.ndarray, bad: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights from all pairs of a better and a worse row."""
    return newton(in_memory(np.concatenate([good, bad]), np.arange(len(good) + len(bad)) < len(good)), np.ones(good.shape[1]), ridge)


def cut(summed: Sums, w: np.ndarray, k: int) -> float:
    """The middle between the strengths of ranks k - 1 and k (from 0) of all rows, by counts in ever narrower ranges."""
    reach = float(np.abs(w).sum()) + 1
    low, high = -reach, reach  # features are within -1 and 1
    for _ in range(4):
        def counted(x: np.ndarray, y: np.ndarray, low: float = low, high: float = high) -> tuple:
            s = x @ w
            return int((s < low).sum()), np.histogram(s, BINS, (low, high))[0]

        below, counts = summed(counted)
        first, last = np.searchsorted(below + np.cumsum(counts), [k - 1, k], "right").clip(0, BINS - 1)
        edges = np.linspace(low, high, BINS + 1)
        # A value at an edge may be counted on either side.
        low, high = edges[max(first - 1, 0)], edges[min(last + 2, BINS)]
        if counts[max(first - 1, 0) : last + 2].sum() <= MOST:
            break

    def values(x: np.ndarray, y: np.ndarray) -> tuple:
        s = x @ w
        return int((s < low).sum()), Counter(s[(s >= low) & (s <= high)].tolist())

    below, found = summed(values)
    held = sorted(found)
    upto = below + np.cumsum([found[v] for v in held])
    a, b = (held[min(int(np.searchsorted(upto, r, "right")), len(held) - 1)] for r in (k - 1, k))
    return (a + b) / 2


def model_of(summed: Sums, width: int, threshold: float, ridge: float = 1e-3) -> Model:
    base = float(np.log(threshold / (1 - threshold)))
    head = lambda x: x[:, : len(COUNTS)].astype(np.float64)
    n, good, total, squares = summed(lambda x, y: (len(x), int(y.sum()), head(x).sum(0), (head(x) ** 2).sum(0)))
    if good in (0, n):
        return Model(np.zeros(width), base + 1e-9)
    # Counts are standardised; shares stay as small as they are, so the ridge trusts them with many labels only.
    deviation = np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0))
    scale = np.concatenate([np.maximum(deviation, 1e-3), np.ones(width - len(COUNTS))])
    w = newton(summed, scale, ridge) / scale
    return Model(w, base - cut(summed, w, n - good))


def learned(x: np.ndarray, y: np.ndarray, threshold: float = 0.7) -> Model:
    """Of features x and whether each row is labelled good."""
    return model_of(in_memory(x, y), x.shape[1], threshold)


def fit(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> Model:
    """labels: doc_id, label (1 is better); all of its rows are learned from."""
    marked = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.avg("label").alias("good")).where("good != 0.5")
    texts = docs.select("doc_id", F.col("text").cast("string")).join(marked.hint("merge"), "doc_id").select(F.expr("good > 0.5").alias("good"), "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array([r.tobytes() for r in features(batch.column("text"))], pa.binary())], ["good", "x"])

    with Workspace(docs.sparkSession, "quality") as space:
        rows = space.keep(texts.mapInArrow(of, "good boolean, x binary"), "features")
        if rows.isEmpty():
            return learned(np.zeros((0, len(COUNTS) + 2 * WIDE), np.float32), np.zeros(0, bool), threshold)
        return model_of(in_tasks(rows), len(COUNTS) + 2 * WIDE, threshold)


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """row, a struct of the columns of docs, score and predicted."""
    rows = with_text(docs)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, offset = shared.value
        for batch in sliced(batches, "row.text"):
            strength = features(column(batch, "row.text")) @ weights + offset
            score = 1 / (1 + np.exp(-np.clip(strength, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["row", "score", "predicted"])

    return rows.mapInArrow(of, schema)


def model_for(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> Model:
    """Learned from the labels (doc_id, quality) of documents that aren't held out."""
    return fit(docs, labels.where(~held_out()).select("doc_id", F.col("quality").alias("label")), threshold=threshold)


def train_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of docs, score and predicted."""
    return flattened(scored(docs, model_for(docs, labels)), "score", "predicted")


def predicted_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted to be good."""
    return scored(docs, model_for(docs, labels)).where("predicted = 1").select("row.*")
