"""N-gram Jaccard self-join by chosen paths.

Each text is the set of its shingles of ``size`` words. A chosen-path run splits the
sets on sampled shared tokens, the coordinates of a MinHash sketch: at each node the
path chooses one coordinate, and a second one with probability 1/4, so two sets of
similarity 0.8 stay together on one branch at least once in expectation. Small
buckets are compared by brute force; larger ones are compared with their smallest
member and split again on further tokens, unless all of them are near that member;
what is still large at the last level is compared by brute force in blocks. Runs are
repeated until the chance of missing a pair at the threshold is under 1 - recall.

Sketches only find candidates. Candidates' groups are then compared exactly, on whole
shingle sets: every two blocks of a group meet in one place, where links are counted,
but for those whose sizes differ too much for any link. So neither candidates nor links
ever have a row for each pair, and copies with equal sets are one class with a count.

Skew: classes and bucket counts are aggregated before the shuffle; a large bucket is
dealt in chunks, each with the bucket's smallest member, and a large group in blocks of
a bounded number of rows and bytes. Nothing is broadcast by this module or collected,
and no bucket or group is capped.

Classes have keys of their own and rows are told apart by their places, so null ids,
and ids that repeat with other texts, link as all others do.

Defined results: null and empty texts have no shingles and link with nothing; a text
of 1 to 4 words is one shingle; a very long text is one set, held whole by one task;
null doc_ids are never a class's or a component's id, and one without any other has
none; repeated rows count as copies; equal similarities are no ties, as nothing is
ranked; further columns are ignored whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import words
from faultline.llm.links import components, counted, dealt, forest, sorted_groups, summed
from faultline.llm.shared import Workspace, located, sliced

COORDINATES = 64
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)


#: How often a bucket is split at most, and the chance of a second coordinate at a node.
LEVELS, SECOND = 4, 0.25


def runs_needed(threshold: float, recall: float, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold, split at every level, is missed by 1 - recall at most.

    Of a branching process: at each level the pair stays together on a coordinate with
    the threshold's chance, and a node has a second coordinate with SECOND's.
    """
    missed = 0.0
    for _ in range(levels):
        apart = 1 - threshold + threshold * missed
        missed = (1 - SECOND) * apart + SECOND * apart**2
    return math.ceil(math.log(1 - recall) / math.log(missed))


def sets_of(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    h, to = words.shingles(*words.flat(column), size)
    for a, b in zip(to[:-1].tolist(), to[1:].tolist()):
        s = np.sort(h[a:b])
        yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(words.mixed(s.copy()).sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(words.mixed(s * np.uint64(0xD6E8FEB86659FD93))).astype(np.int64)) if len(s) else 0


def sketches(rows: DataFrame, size: int) -> DataFrame:
    """file, at, doc_id, n distinct shingles, two halves of a fingerprint of their set, and the sketch; rows: see located."""
    names = ["file", "at", "doc_id", "n", "f1", "f2", "sketch"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = list(sets_of(batch.column("text"), size))
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            sketch = np.zeros((len(full), COORDINATES), np.uint32)
            if len(full):
                flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(n[full])[:-1]])
                for k, x in enumerate(_FACTORS):
                    sketch[:, k] = np.minimum.reduceat(flat * x, starts) >> np.uint64(32)
            held: list[bytes | None] = [None] * len(sets)
            for i, row in zip(full.tolist(), sketch):
                held[i] = row.tobytes()
            prints = [fingerprint(s) for s in sets]
            halves = [pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1)]
            own = [batch.column(x) for x in names[:3]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), *halves, pa.array(held, pa.binary())], names)

    plain = rows.select("file", "at", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    return plain.mapInArrow(of, "file long, at long, doc_id long, n long, f1 long, f2 long, sketch binary")


def _matrix(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal coordinates of each row of a and each of b."""
    out = np.empty((len(a), len(b)), np.int16)
    for i in range(0, len(a), 64):
        out[i : i + 64] = (a[i : i + 64, None, :] == b[None, :, :]).sum(2, dtype=np.int16)
    return out


def candidates(classes: DataFrame, space: Workspace, runs: int, least: int, small: int = 48, levels: int = LEVELS, chunk: int = 512) -> DataFrame:
    """Edges (a, b) whose components hold every two classes that a run found with least equal coordinates or more."""
    rng = np.random.default_rng(17)
    root = [(r, int(c)) for r in range(runs) for c in rng.choice(COORDINATES, 2 if rng.random() < SECOND else 1, replace=False)]
    cell = lambda c: f"substring(sketch, {c} * 4 + 1, 4)"
    rows = classes.select("id", F.explode(F.array(*[F.expr(f"xxhash64({r}, {c}, {cell(c)})") for r, c in root])).alias("bucket"))
    edges = None

    def near(t: pa.Table) -> pa.Table:
        ids, sketch = t.column("id").to_numpy(), _matrix(t)
        n = t.column("n")[0].as_py()
        bucket = t.column("bucket")[0].as_py()
        if n <= small:
            label = forest(_alike(sketch, sketch) >= least)
            a, b, count = ids, ids[label], None
        else:
            lead = t.column("lead")[0].as_py()
            at = int(np.flatnonzero(ids == lead)[0])
            close = _alike(sketch[at : at + 1], sketch)[0] >= least
            own = ~t.column("extra").to_numpy(zero_copy_only=False)
            a, b, count = ids[close], np.full(int(close.sum()), lead), int((close & own).sum())
        keep = a != b
        a, b = a[keep].tolist(), b[keep].tolist()
        buckets, counts = [None] * len(a), [None] * len(a)
        if count is not None:
            a, b, buckets, counts = [*a, None], [*b, None], [*buckets, bucket], [*counts, count]
        return pa.table([pa.array(x, pa.int64()) for x in (a, b, buckets, counts)], names=["a", "b", "bucket", "near"])

    for level in range(levels):
        rows = rows if level == 0 else space.keep(rows, f"rows-{level}")
        sizes = space.keep(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("lead")).where("n > 1"), f"sizes-{level}")
        live = rows.join(sizes, "bucket").withColumn("chunk", F.when(F.col("n") > chunk, F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / chunk))).otherwise(0)).withColumn("extra", F.lit(False))
        chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / chunk) - 1)).alias("chunk")
        leads = sizes.where(F.col("n") > chunk).select("bucket", F.col("lead").alias("id"), "n", "lead", chunks, F.lit(True).alias("extra"))
        cols = ["bucket", "chunk", "id", "n", "lead", "extra"]
        held = live.select(*cols).unionByName(leads.select(*cols)).join(classes.select("id", "sketch"), "id")
        found = space.keep(sorted_groups(held, ["bucket", "chunk"], near, "a long, b long, bucket long, near long"), f"near-{level}")
        own = found.where("a IS NOT NULL").select("a", "b")
        edges = own if edges is None else edges.unionByName(own)
        mixed = found.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("near").alias("near")).join(sizes, "bucket").where("near < n")
        if not mixed.limit(1).count():
            return edges
        large = rows.join(mixed.select("bucket"), "bucket").join(classes.select("id", "sketch"), "id")
        c, d = "pmod(xxhash64(bucket, 1), 64)", "pmod(xxhash64(bucket, 2), 64)"
        key = lambda x: f"xxhash64(bucket, {x}, {cell(f'cast({x} AS int)')})"
        second = f"CASE WHEN pmod(xxhash64(bucket, 3), 4) = 0 AND {c} != {d} THEN array({key(c)}, {key(d)}) ELSE array({key(c)}) END"
        if level + 1 < levels:
            rows = large.select("id", F.explode(F.expr(second)).alias("bucket"))
    members = dealt(large.select("bucket", "id", "sketch", F.lit(1).alias("copies")), space, "rest", "bucket", 1024)
    everything = counted(members, "bucket", lambda a, b: _alike(_matrix(a), _matrix(b)) >= least)
    return edges.unionByName(space.keep(everything.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a != b"), "rest"))


def overlaps(a: list[bytes], b: list[bytes] | None, rare: int = 6) -> np.ndarray:
    """Common shingles of each set of a with each of b, or of a if b is None.

    A shingle that few sets have is counted by its pairs of sets, others by products of
    matrices with a column for each.
    """
    sets = [np.frombuffer(x, np.uint64) for x in (a if b is None else a + b)]
    n, m = len(a), len(a) if b is None else len(b)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    count = np.bincount(column)
    out = np.zeros((n, m), np.float32)
    for d in range(1, rare):
        k = np.flatnonzero((column[d:] == column[:-d]) & (count[column[d:]] <= rare))
        x, y = owner[k], owner[k + d]  # x < y, as owners are sorted within a column
        if b is None:
            np.add.at(out, (x, y), 1)
            np.add.at(out, (y, x), 1)
        else:
            across = (x < n) & (y >= n)
            np.add.at(out, (x[across], y[across] - n), 1)
    if b is None:
        np.fill_diagonal(out, 0)
    keep = count[column] > rare
    owner, column = owner[keep], (np.cumsum(count > rare) - 1)[column[keep]]
    wide = int((count > rare).sum())
    for at in range(0, wide, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        hot = np.zeros((len(sets), min(4096, wide - at)), np.float32)
        hot[owner[lo:hi], column[lo:hi] - at] = 1
        out += hot[:n] @ (hot if b is None else hot[n:]).T
    return out


class Joined(NamedTuple):
    """rows: file, at, doc_id, n, f1, f2 of each row; known: f1, f2, n, links, copies, doc_id (the smallest) and
    component (a number) of the classes of several rows or with links."""

    rows: DataFrame
    known: DataFrame


def linked_classes(rows: DataFrame, space: Workspace, threshold: float, size: int, recall: float, block: int) -> Joined:
    ratio = Fraction(threshold).limit_denominator(10_000)
    every = space.keep(sketches(rows, size), "sketches")
    classes = every.where("n > 0").groupBy("f1", "f2", "n").agg(
        F.min("doc_id").alias("doc_id"),
        F.min(F.struct("file", "at")).alias("place"),
        F.count("*").alias("copies"),
        F.first("sketch").alias("sketch"),
    )
    # Numbered as they are written, so every later reading finds the same numbers.
    classes = space.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    deviation = math.sqrt(COORDINATES * threshold * (1 - threshold))
    edges = candidates(classes, space, runs_needed(threshold, recall), math.floor(COORDINATES * threshold - 3.5 * deviation))
    groups = components(edges, space, "groups").withColumnRenamed("component", "group")
    near = groups.join(classes.select("id", "place.file", "place.at", "copies", "n"), "id")
    band = f"floor(ln(n) / {math.log(1 / threshold) * 1.0001!r})" if threshold < 1 else "n"
    wanted = space.keep(dealt(near, space, "groups", "group", block, "8 * n", 1 << 22, band).drop("n"), "wanted")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = pa.array([s.tobytes() for s in sets_of(batch.column("text"), size)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sets], [*batch.schema.names[:-1], "shingles"])

    texts = rows.select("file", "at", F.col("row.text").cast("string").alias("text")).join(wanted.hint("merge"), ["file", "at"])
    kinds = "group long, id long, copies long, own long, others array<long>"
    members = texts.select("group", "id", "copies", "own", "others", "text").mapInArrow(whole, f"{kinds}, shingles binary")
    p, q = ratio.numerator, ratio.denominator

    def linked(a: pa.Table, b: pa.Table) -> np.ndarray:
        x = a.column("shingles").to_pylist()
        y = None if a is b else b.column("shingles").to_pylist()
        n, m = (np.array([len(s) // 8 for s in z]) for z in (x, x if y is None else y))
        return overlaps(x, y).astype(np.int64) * (p + q) >= p * (n[:, None] + m[None, :])

    pairs = space.keep(counted(members, "group", linked), "pairs")
    links = space.keep(summed(pairs, space, "links"), "summed")
    known = classes.drop("sketch", "place").join(links, "id", "left").where("copies > 1 OR links > 0")
    known = known.select("f1", "f2", "n", "doc_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    return Joined(every.drop("sketch"), space.keep(known, "known"))


def join(docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = 0.995, block: int = 2048, space: Workspace | None = None) -> DataFrame:
    """doc_id, class_id (smallest with equal shingles), n_links (rows with similarity >= threshold), component_id and kept, of each row.

    The result is a written table; it lies in space, or else until the driver ends.
    """
    with Workspace(docs.sparkSession, "ngram") as work:
        rows, known = linked_classes(located(docs, work), work, threshold, size, recall, block)
        first = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        named = known.join(first, "component").select("f1", "f2", "n", F.col("doc_id").alias("class_id"), "copies", "links", "component_id", F.lit(True).alias("found"))
        out = rows.join(named, ["f1", "f2", "n"], "left")
        alone = F.col("found").isNull()
        out = out.select(
            "doc_id",
            F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
            F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
        return (space or Workspace(docs.sparkSession, "ngram-links")).keep(out, "links")


def deduplicated(docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = 0.995, block: int = 2048, space: Workspace | None = None) -> DataFrame:
    """The rows of docs without those of a component but one: that with the smallest doc_id (null last), of these the first by its place.

    Rows are told apart by their places, so no row goes for another's doc_id. What goes
    is a written table of places; it lies in space, or else until the driver ends.
    """
    space = space or Workspace(docs.sparkSession, "ngram-gone")
    rows = located(docs, space)
    with Workspace(docs.sparkSession, "ngram") as work:
        found, known = linked_classes(rows, work, threshold, size, recall, block)
        alike = work.keep(found.join(known.select("f1", "f2", "n", "component"), ["f1", "f2", "n"]).select("file", "at", "doc_id", "component"), "alike")
        first = alike.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "at")).alias("kept"))
        gone = alike.join(first, "component").where("file != kept.file OR at != kept.at").select("file", "at")
        gone = space.keep(gone, "gone")
    return rows.join(gone.hint("merge"), ["file", "at"], "left_anti").select("row.*")


#: All pairs that share a shingle, exactly.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS f FROM s GROUP BY doc_id),
k AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY f) AS class_id FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN k x ON x.doc_id = p.a JOIN k y ON y.doc_id = p.b WHERE 9 * i >= 4 * (x.n + y.n)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, count(*) AS n FROM e GROUP BY a), c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT w.doc_id, coalesce(k.class_id, w.doc_id) AS class_id, coalesce(m.n, 0)::BIGINT AS n_links, least(w.doc_id, coalesce(c.b, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(c.b, w.doc_id)) AS kept
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN m ON m.a = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""
