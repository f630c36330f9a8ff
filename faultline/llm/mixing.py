"""Mixing to target weights with soft membership.

A classifier, multinomial logistic regression on hashed pairs of bytes and hashed words,
is fitted to a labelled table of domains and gives every document posteriors p over the
domains. Then nonnegative rates r, how often a document is to be used, are fitted so that
expected tokens, sum of r * tokens * p, meet the target of every domain: least squares by
projected gradient, with the Gram matrix of the posteriors as preconditioner. A rate
depends on its document's posteriors only, so a round keeps no state for each document:
it sums a few numbers, on the executors, for several steps that the driver proposes, and
the driver takes the best of them. Rounds end when targets are met, or when no step
brings them closer: then the shares by which they are missed are in the Mix, and a
warning names them.

Two scans of the texts (posteriors, then rates) and one of numbers a round; nothing is
shuffled but partial sums. Learned from ``sample_rows`` labelled rows at most, the
first by a hash of doc_id; their ids are all that is broadcast beside the weights.
A token here is a white-space word.

Defined results: null and empty texts have no tokens, the posteriors of the intercept
alone, and a rate like others; a very long text is looked at whole; several labels of a
document count once, the smallest; labels without a target are ignored, so documents of
such a domain get posteriors over the others; without any label posteriors are the
targets; a domain without any mass stays empty, which the Mix reports; of equally likely
domains the first by name is named; rows that repeat are rows; an empty table gives an
empty result. Columns of the input stay, whatever their names, but for those named like
a result, which apply() replaces and repeated() keeps.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import words
from faultline.llm.shared import Workspace, column, flattened, sliced, with_text

WIDE = 512


class Mix(NamedTuple):
    """Domains, their targets, the classifier's weights (features and intercept), the steps of the rates, the least rate,
    and by how much of all tokens each domain's expected ones exceed its target."""

    domains: list[str]
    targets: np.ndarray
    weights: np.ndarray
    steps: list[np.ndarray]
    least: float
    off: np.ndarray


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text words.shares, and its number of words."""
    data, bounds = words.flat(texts)
    starts, ends = words.words(data, bounds)
    return words.shares(data, bounds, starts, ends, WIDE), np.diff(np.searchsorted(starts, bounds))


def posteriors(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x @ weights[:-1] + weights[-1]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def logistic(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 80, ridge: float = 1e-5, memory: int = 8) -> np.ndarray:
    """Weights of the least mean loss by limited-memory BFGS; the last row is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    one, w = np.eye(k)[y], np.zeros((x.shape[1], k))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        total = p.sum(1, keepdims=True)
        value = float((np.log(total[:, 0]) - z[np.arange(len(y)), y]).mean()) + ridge / 2 * float((w * w).sum())
        return value, x.T @ (p / total - one) / len(x) + ridge * w

    value, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, kept = g.copy(), []
        for s, t in reversed(past):
            a = (s * d).sum() / (s * t).sum()
            d -= a * t
            kept.append(a)
        if past:
            s, t = past[-1]
            d *= (s * t).sum() / (t * t).sum()
        for (s, t), a in zip(past, reversed(kept)):
            d += s * (a - (t * d).sum() / (s * t).sum())
        pace, slope = 1.0, float((g * d).sum())
        while (new := loss(w - pace * d))[0] > value - 1e-4 * pace * slope and pace > 1e-8:
            pace /= 2
        s, t = -pace * d, new[1] - g
        if (s * t).sum() > 1e-12:
            past = [*past[1 - memory :], (s, t)]
        done = value - new[0] < 1e-7
        w, (value, g) = w + s, new
        if done:
            break
    return w


def classify(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], sample_rows: int = 4000) -> tuple[list[str], np.ndarray]:
    """labelled: doc_id, domain."""
    domains = sorted(targets)
    marked = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("_domain"))
    marked = marked.orderBy(F.xxhash64("doc_id")).limit(sample_rows)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            x, _ = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("_domain"), pa.array([r.tobytes() for r in x], pa.binary())], ["domain", "x"])

    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(marked), "doc_id").select("_domain", "text").mapInArrow(of, "domain string, x binary").toArrow()
    if not rows.num_rows:
        w = np.zeros((2 * WIDE + 1, len(domains)))
        w[-1] = np.log(np.maximum([targets[d] for d in domains], 1e-9))
        return domains, w
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, 2 * WIDE)
    return domains, logistic(x, np.array([domains.index(d) for d in rows.column("domain").to_pylist()]), len(domains))


def rates(p: np.ndarray, steps: list[np.ndarray], least: float) -> np.ndarray:
    r = np.maximum(np.ones(len(p)), least)
    for v in steps:
        r = np.maximum(r - p @ v, least)
    return r


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float = 0.0, total: float | None = None, sample_rows: int = 4000, close: float = 1e-4, rounds: int = 100) -> Mix:
    """total: expected tokens after mixing; by default those of docs, or as many more as rates of at least ``least`` need.

    Rounds end at ``close``, of all tokens, or where none helps; ``rounds`` only guards against a fit that never ends, and raises.
    """
    domains, w = classify(docs, labelled, targets, sample_rows)
    k, share = len(domains), np.array([targets[d] for d in domains], float)
    share = share / share.sum()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            x, n = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.float64)), *(pa.array(c) for c in posteriors(x, w).T)], ["n", *(f"p{i}" for i in range(k))])

    with Workspace(docs.sparkSession, "mix") as space:
        held = space.keep(docs.select(F.col("text").cast("string")).mapInArrow(of, "n double, " + ", ".join(f"p{i} double" for i in range(k))), "posteriors")

        def sums(proposed: list[list[np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
            """For each list of steps the expected tokens of each domain, and the Gram matrix of what isn't at the least rate."""

            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = np.zeros((len(proposed), k + k * k))
                for batch in batches:
                    n, *p = (c.to_numpy() for c in batch.columns)
                    p = np.stack(p, 1) if batch.num_rows else np.zeros((0, k))
                    for i, steps in enumerate(proposed):
                        r = rates(p, steps, least)
                        out[i, :k] += (r * n) @ p
                        out[i, k:] += (p.T @ (p * (n * (r > least))[:, None])).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out.ravel())], ["i", "x"])

            got = np.zeros(len(proposed) * (k + k * k))
            for r in held.mapInArrow(add, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # as many rows as numbers
                got[r["i"]] = r["x"]
            return [(x[:k], x[k:].reshape(k, k)) for x in got.reshape(len(proposed), -1)]

        steps: list[np.ndarray] = []
        (have, free), = sums([steps])
        plain = held.agg(*[F.coalesce(F.sum(F.col("n") * F.col(f"p{i}")), F.lit(0.0)) for i in range(k)]).first()
        gram, now = free, np.array(plain, float)
        whole = total or max(now.sum(), *(least * now / np.maximum(share, 1e-12)))
        if not np.any(gram):  # all rates begin at the least one
            gram = np.diag(np.maximum(now, 1e-9))
        for _ in range(rounds):
            gap = have - share * whole
            size = float(np.abs(gap).sum()) / max(whole, 1.0)
            if size < close:
                break
            ways = [np.linalg.pinv(gram) @ gap, np.linalg.pinv(free) @ gap]
            proposed = [[*steps, pace * way] for way in ways for pace in (1.0, 0.5, 0.1)]
            found = sums(proposed)
            off = [float(np.abs(x - share * whole).sum()) / max(whole, 1.0) for x, _ in found]
            best = int(np.argmin(off))
            if off[best] > 0.999 * size:
                over = float((gap / np.maximum(share * whole, 1e-12)).max())
                if total is not None or least <= 0 or not 0 < over < 1:
                    break
                whole *= 1 + over  # the least rates alone exceed a target
                continue
            steps, (have, free) = proposed[best], found[best]
        else:
            raise RuntimeError(f"rates still improve after {rounds} rounds")
    off = (have - share * whole) / max(whole, 1.0)
    if np.abs(off).sum() >= close and whole > 0:
        warnings.warn("targets can't be met; expected tokens exceed them by these shares of all: " + ", ".join(f"{d} {x:+.4f}" for d, x in zip(domains, off)), stacklevel=2)
    return Mix(domains, share, w, steps, least, off)


def mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """row, a struct of the columns of docs, n_tokens, domain (the likeliest), posteriors (in the order of the domains' names) and rate."""
    rows = with_text(docs)
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("domain", T.StringType()), T.StructField("posteriors", T.ArrayType(T.DoubleType())), T.StructField("rate", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast(mix)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in sliced(batches, "row.text"):
            x, n = features(column(batch, "row.text"))
            p = posteriors(x, m.weights)
            best = pa.array([m.domains[i] for i in p.argmax(1)])
            shares, rate = pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(rates(p, m.steps, m.least))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n.astype(np.int64)), best, shares, rate], ["row", *(f.name for f in made)])

    return rows.mapInArrow(of, T.StructType([*rows.schema.fields, *made]))


def apply(docs: DataFrame, mix: Mix) -> DataFrame:
    """docs with n_tokens, domain, posteriors and rate."""
    return flattened(mixed(docs, mix), "n_tokens", "domain", "posteriors", "rate")


def repeated(docs: DataFrame, mix: Mix, at_once: int = 1024) -> DataFrame:
    """The rows of docs, each as often as its rate says: its whole part, and once more for a share of rows by their hash.

    A row with a high rate is repeated in two steps, so no array has more than at_once entries or the number of such arrays.
    """
    u = F.pmod(F.xxhash64(F.col("row.doc_id"), F.col("row.text"), F.lit(41)), F.lit(1 << 20)) / (1 << 20)
    out = mixed(docs, mix).select("row", F.floor(F.col("rate") + u).cast("long").alias("times")).where("times > 0")
    out = out.select("row", "times", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {at_once}"))).alias("nth"))
    return out.select("row", F.explode(F.expr(f"sequence(1L, least({at_once}L, times - nth * {at_once}))"))).select("row.*")
