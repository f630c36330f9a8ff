"""Near-duplicate vectors by E8 lattice hashing.

Each table projects the unit vectors at random on ``parts`` times 8 dimensions and
decodes each 8 to a point of the E8 lattice; the points together name the vector's home
cell. It also probes neighbouring cells: those in which one of its points is another of
the 240 nearest, taken by how close their centres are. Two vectors meet where one's home
is a cell of the other's. What meets is looked at through short sketches, and what these
leave is verified by the cosine in double precision, within groups of candidates, so a
link that no table found counts too where its ends are connected.

The tables follow the number of vectors (see plan): a cell has a bounded number of
unrelated vectors in expectation at any size, at the price of a few more tables. Their
number comes from the chance, measured on pairs at the threshold, that one table misses
a pair.

Vectors link only with vectors of the same label and length, which are part of a cell's
key. Equal vectors are one class with a count; classes have keys of their own, so null
ids and ids that repeat link as all others do. Hot cells and groups are dealt in blocks;
neither has a row for each pair. Nothing is broadcast by this module or collected.

Defined results: vectors that are null, zero, empty, or hold null or non-finite
components, and those with a null label, link with nothing; null ids are never a
component's id, and a component without any other has none; rows that repeat count as
copies; equal cosines are no ties, as nothing is ranked; vectors may be of any length,
also very long ones; further columns are ignored whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import words
from faultline.llm.links import components, counted, dealt, reached, summed
from faultline.llm.shared import Workspace

@functools.cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or all of 1/2 or -1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def _even(y: np.ndarray) -> np.ndarray:
    """The nearest points of D8, integers with an even sum."""
    near = np.rint(y)
    off = y - near
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 moved by a half in each dimension."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


@functools.cache
def projection(seed: int, dimension: int, wide: int = 8) -> np.ndarray:
    """At random on so many dimensions; lengths stay the same on average."""
    if dimension <= wide and wide > 8:
        return np.eye(dimension, wide)
    q = np.random.default_rng([seed, dimension, wide]).normal(size=(dimension, wide))
    return np.linalg.qr(q)[0] * np.sqrt(dimension / wide) if dimension >= wide else q / np.sqrt(wide)


def cells(unit: np.ndarray, table: int, parts: int, scale: float, probes: int) -> np.ndarray:
    """Of each vector, hashes of its home cell and of the cells it probes."""
    n = len(unit)
    near, gain = [], []
    home = np.zeros((n, parts), np.uint64)
    for k in range(parts):
        y = unit @ projection(table * 16 + k, unit.shape[1]) * scale
        point = decode(y)
        close = (y - point) @ neighbours().T
        best = np.argsort(-close, axis=1, kind="stable")[:, :probes]
        gain.append(np.take_along_axis(close, best, 1))
        points = np.concatenate([point[:, None, :], point[:, None, :] + neighbours()[best]], axis=1)
        h = np.full(points.shape[:2], 16 * table + k + 1, np.uint64)
        for i in range(8):
            h = words.mixed(h * np.uint64(0x100000001B3) + (points[:, :, i] * 2).astype(np.int64).astype(np.uint64))
        home[:, k] = h[:, 0]
        near.append(h[:, 1:] - h[:, :1])
    whole = home.sum(1, dtype=np.uint64)
    best = np.argsort(-np.concatenate(gain, 1), axis=1, kind="stable")[:, :probes]
    moved = whole[:, None] + np.take_along_axis(np.concatenate(near, 1), best, 1)
    return words.mixed(np.concatenate([whole[:, None], moved], 1)).astype(np.int64)


class Plan(NamedTuple):
    tables: int
    parts: int
    scale: float
    probes: int


#: Scale and probes for a cell of one part and for one of several; the chance that two unrelated vectors share such a part.
ONE, MORE, PROBES = (2.5, 7e-5), (1.7, 1.6e-3), 2


@functools.cache
def met_chance(dimension: int, least: float, parts: int, scale: float, probes: int, pairs: int = 4096) -> float:
    """The share of pairs with a cosine of exactly least that meet in a table, measured on random ones over several tables."""
    rng = np.random.default_rng([dimension, parts])
    x, z = rng.normal(size=(2, pairs, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y, hits = least * x + math.sqrt(1 - least**2) * z, 0
    for table in range(100, 104):
        a, b = (cells(u[(table - 100) * pairs // 4 : (table - 99) * pairs // 4], table, parts, scale, probes) for u in (x, y))
        hits += int(((a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)).sum())
    return hits / pairs


@functools.cache
def plan(dimension: int, n: int, least: float, recall: float, unrelated: float = 8.0) -> Plan:
    """The fewest parts with which a vector meets so many unrelated ones of n at most, and the tables for the recall."""
    for parts in range(1, 9):
        scale, shared = ONE if parts == 1 else MORE
        p = min(max(met_chance(dimension, least, parts, scale, PROBES), 0.05), 0.999)
        tables = max(2, math.ceil(math.log(1 - recall) / math.log(1 - p)))
        if n * tables * (1 + 2 * PROBES) * shared**parts <= unrelated:
            break
    return Plan(tables, parts, scale, PROBES)


SHORT = 32
_STEP = 0.01


def sketch(unit: np.ndarray) -> np.ndarray:
    """A random projection on SHORT dimensions in steps of _STEP, one byte each."""
    return np.clip(np.rint(unit @ projection(1 << 20, unit.shape[1], SHORT) / _STEP), -127, 127).astype(np.int8)


def reach(dimension: int, least: float) -> float:
    """The squared distance of two sketches, in steps, that a pair of cosine least passes in 1 of 10^6 cases at most."""
    spread = math.sqrt(2 * max(dimension - SHORT, 0) / (SHORT * (dimension + 2)))
    return ((math.sqrt(2 * (1 - least) * (1 + 5 * spread)) + 0.03) / _STEP) ** 2


def classes_of(vectors: DataFrame) -> DataFrame:
    """vec_id, label, and the vector's bytes, null where it links with nothing; components keep their width."""
    kind = vectors.schema["embedding"].dataType
    width = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, column = batch.column("label"), batch.column("embedding")
            values = column.values.cast(pa.float64())
            plain = values.to_numpy(zero_copy_only=False) + 0.0  # nulls are nan; there is no negative zero
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(plain))])
            some = np.concatenate([[0], np.cumsum(np.nan_to_num(plain) != 0)])
            at = column.offsets.to_numpy()
            ok = (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
            data, w = plain.astype(width).tobytes(), int(width[2])
            held = [data[w * a : w * b] if k else None for a, b, k in zip(at[:-1].tolist(), at[1:].tolist(), ok.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), labels, pa.array(held, pa.binary())], ["vec_id", "label", "vector"])

    plain = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast(f"array<{'float' if width == '<f4' else 'double'}>"))
    return plain.mapInArrow(of, "vec_id long, label string, vector binary")


def _unit(vectors: list[bytes], width: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), width).reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _short(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.int8).reshape(t.num_rows, -1).astype(np.float32)


def _close(x: np.ndarray, y: np.ndarray, within: float) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T) <= within + 0.5


KEY = ["label", "dimension", "cell"]


def in_small_cells(batches: Iterator[pa.RecordBatch], least: float, most: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b), a forest of each cell's pairs of near sketches, of batches sorted by cell; many cells at a time."""

    def of(t: pa.Table) -> pa.Table:
        ids, dims, short = t.column("id").to_numpy(), t.column("dimension").to_numpy(), _short(t)
        place = t.column("place").to_numpy()
        within = np.zeros(len(ids))
        for d in np.unique(dims):
            within[dims == d] = reach(int(d), least)
        a, b = [], []
        for gap in range(1, int(place.max()) + 1):
            later = np.flatnonzero(place >= gap)  # the one gap before is in the same cell
            diff = short[later] - short[later - gap]
            hit = later[np.einsum("ij,ij->i", diff, diff) <= within[later] + 0.5]
            a.append(hit - gap)
            b.append(hit)
        if not a:
            return pa.table([pa.array([], pa.int64())] * 2, names=["a", "b"])
        root = reached(len(ids), np.concatenate(a), np.concatenate(b))
        own = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table([pa.array(ids[own]), pa.array(ids[root[own]])], names=["a", "b"])

    def numbered() -> Iterator[pa.RecordBatch]:
        """Batches cut between cells, with each row's place in its cell."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) > 16 * most:
                t = pa.Table.from_batches(held).combine_chunks()
                new = starts(t)
                cut = int(np.flatnonzero(new)[-1])
                if cut:
                    yield with_place(t.slice(0, cut), new[:cut])
                held = t.slice(cut).to_batches()
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield with_place(t, starts(t))

    def starts(t: pa.Table) -> np.ndarray:
        new = np.ones(t.num_rows, bool)
        new[1:] = False
        for k in KEY:
            c = t.column(k)
            new[1:] |= pa.compute.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)).to_numpy()
        return new

    def with_place(t: pa.Table, new: np.ndarray) -> pa.Table:
        first = np.flatnonzero(new)
        return t.append_column("place", pa.array(np.arange(t.num_rows) - np.repeat(first, np.diff(np.append(first, t.num_rows)))))

    for t in numbered():
        yield from of(t).to_batches()


def near_duplicates(vectors: DataFrame, least: float = 0.98, recall: float = 0.999, small: int = 64, block: int = 512, space: Workspace | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row.

    The result is a written table; it lies in space, or else until the driver ends.
    """
    width = "<f4" if "float" in vectors.schema["embedding"].dataType.simpleString() else "<f8"
    with Workspace(vectors.sparkSession, "lattice") as work:
        every = classes_of(vectors).withColumns({"f1": F.xxhash64("vector"), "f2": F.xxhash64(F.lit(7), "vector")})
        every = work.keep(every, "vectors")
        classes = every.where("vector IS NOT NULL").groupBy("label", "f1", "f2").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
        # Numbered as they are written, so every later reading finds the same numbers.
        classes = work.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
        n = 1 << max(classes.count() - 1, 1).bit_length()

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = pa.compute.binary_length(batch.column("vector")).to_numpy(zero_copy_only=False)
                for size in np.unique(lengths):
                    for part in pa.Table.from_batches([batch.filter(pa.array(lengths == size))]).to_batches(max(64, (1 << 24) // int(size))):
                        unit = _unit(part.column("vector").to_pylist(), width)
                        how, dimension = plan(unit.shape[1], n, least, recall), np.full(part.num_rows, unit.shape[1], np.int32)
                        short = pa.array([r.tobytes() for r in sketch(unit)], pa.binary())
                        met = np.concatenate([cells(unit, t, how.parts, how.scale, how.probes) for t in range(how.tables)], 1)
                        each = pa.array(np.full(len(met), 1 + how.probes, np.int32))
                        out = [part.column("id"), part.column("label"), pa.array(dimension), pa.array(list(met), pa.list_(pa.int64())), short, each]
                        yield pa.RecordBatch.from_arrays(out, ["id", "label", "dimension", "cells", "sketch", "each"])

        shorts = work.keep(classes.select("id", "label", "vector").mapInArrow(hashed, "id long, label string, dimension int, cells array<long>, sketch binary, each int"), "cells")
        met = shorts.select("id", "label", "dimension", "each", F.posexplode("cells").alias("nth", "cell"))
        shared = met.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(F.col("nth") % F.col("each") == 0).alias("homes")).where("n > 1 AND homes > 0").drop("homes")
        members = work.keep(met.select(*KEY, "id").join(shared, KEY).select(*KEY, "n", "id"), "met").join(shorts.select("id", "sketch"), "id")
        few = members.where(F.col("n") <= small).select(*KEY, "id", "sketch")
        edges = few.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(lambda batches: in_small_cells(batches, least, 4096), "a long, b long")
        many = members.where(F.col("n") > small).withColumn("group", F.xxhash64(*KEY))
        if many.limit(1).count():

            def alike(a: pa.Table, b: pa.Table) -> np.ndarray:
                """Cells whose keys have one hash are told apart here."""
                same = np.ones((a.num_rows, b.num_rows), bool)
                for k in KEY:
                    same &= a.column(k).to_numpy(zero_copy_only=False)[:, None] == b.column(k).to_numpy(zero_copy_only=False)[None, :]
                dims = a.column("dimension").to_numpy()
                out = np.zeros_like(same)
                for d in np.unique(dims):
                    i, j = np.flatnonzero(dims == d), np.flatnonzero(b.column("dimension").to_numpy() == d)
                    if len(j):
                        out[np.ix_(i, j)] = _close(_short(a.take(i)), _short(b.take(j)), reach(int(d), least))
                return out & same

            hot = dealt(many.select("group", *KEY, "id", "sketch", F.lit(1).alias("copies")), work, "hot", "group", block)
            edges = edges.unionByName(counted(hot, "group", alike).select(F.col("id").alias("a"), F.col("root").alias("b")).where("a != b"))
        edges = work.keep(edges.distinct(), "edges")
        groups = components(edges, work, "groups").withColumnRenamed("component", "group")

        def cosine(a: pa.Table, b: pa.Table) -> np.ndarray:
            x = _unit(a.column("vector").to_pylist(), width)
            return x @ (x if a is b else _unit(b.column("vector").to_pylist(), width)).T >= least

        near = groups.join(classes.select("id", "vector", "copies"), "id")
        near = dealt(near, work, "near", "group", block, "octet_length(vector)", 1 << 23)
        links = summed(work.keep(counted(near, "group", cosine), "pairs"), work, "links")
        known = classes.drop("vector").join(links, "id", "left").where("copies > 1 OR links > 0")
        known = known.select("label", "f1", "f2", "vec_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
        first = known.groupBy("component").agg(F.min("vec_id").alias("component_id"))
        named = known.drop("vec_id").join(first, "component").drop("component").withColumn("found", F.lit(True))
        out = every.select("vec_id", "label", "f1", "f2").join(named, ["label", "f1", "f2"], "left")
        out = out.select(
            "vec_id",
            F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
        ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
        return (space or Workspace(vectors.sparkSession, "lattice-links")).keep(out, "links")


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a), c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.b, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
