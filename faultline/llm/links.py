"""Links within groups of rows, counted without a row for each pair, and the components they make."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import Workspace

COUNTED = "id long, links long, root long, whole boolean"


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """id and component, the smallest id that links reach, of each id in edges (a, b).

    Each round takes the smallest label among neighbours, then the label's own label,
    so the number of rounds grows with the logarithm of the longest path in practice.
    """
    edges = edges.where("a != b")
    both = space.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = space.keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("c")), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        nearer = labels.join(near, "id").select("id", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("c").alias("up"))
        now = space.keep(nearer.join(jump, "c", "left").select("id", "was", F.least("c", F.coalesce("up", "c")).alias("c")), f"{name}-{k}")
        moved = now.where("was != c").limit(1).count()
        space.drop(f"{name}-{k - 1}")
        labels = now.select("id", "c")
        if not moved:
            return labels.withColumnRenamed("c", "component")


def forest(linked: np.ndarray) -> np.ndarray:
    """Of each node of a symmetric matrix of links, the smallest node that it reaches."""
    label = np.arange(len(linked))
    while len(linked):
        least = np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n nodes, the smallest that the links (a, b) reach."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str], of: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """of(rows) for the rows of each key, of batches sorted by keys."""
    held: list[pa.RecordBatch] = []
    last, out, rows = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        new[0] = last is not None and last != tuple(v[0] for v in values)
        at = 0
        for cut in [*np.flatnonzero(new).tolist(), batch.num_rows]:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if cut < batch.num_rows:
                out.append(of(pa.Table.from_batches(held)))
                rows += out[-1].num_rows
                held, at = [], cut
                if rows > 20_000:
                    yield from pa.concat_tables(out).combine_chunks().to_batches()
                    out, rows = [], 0
        last = tuple(v[-1] for v in values)
    if held:
        out.append(of(pa.Table.from_batches(held)))
    if out:
        yield from pa.concat_tables(out).combine_chunks().to_batches()


def sorted_groups(df: DataFrame, keys: list[str], of: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """of(rows) for the rows of each key; one task has many keys, and no group is looked at row by row."""
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: in_groups(batches, keys, of), schema)


def dealt(members: DataFrame, space: Workspace, name: str, group: str, rows: int, size: str = "0", most: int = 1 << 22, band: str = "0") -> DataFrame:
    """members with own, a block of their group, and others, all blocks that it has to meet, itself included.

    A block has about ``rows`` members and ``most`` of their sizes at the most. Members
    link only within a band or with the bands beside it, so only those blocks meet.
    """
    banded = members.withColumn("_band", F.expr(f"cast({band} AS bigint)"))
    sizes = banded.groupBy(group, "_band").agg(F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum(F.expr(size).cast("double")) / most)).cast("long").alias("_n"))
    number = lambda b, h: b * (1 << 32) + h
    beside = sizes.select(group, F.explode(F.array(*[F.col("_band") + d for d in (-1, 0, 1)])).alias("_to"), F.col("_band").alias("_at"), "_n")
    all_ = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda h: number(F.col("_at"), h))
    beside = beside.groupBy(group, "_to").agg(F.flatten(F.collect_list(all_)).alias("others"), F.max(F.when(F.col("_to") == F.col("_at"), F.col("_n"))).alias("_n")).withColumnRenamed("_to", "_band")
    # Written, so that the join has nothing above its exchanges and a hot group's side can be split.
    beside = space.keep(beside.where("_n IS NOT NULL"), f"{name}-blocks")
    own = number(F.col("_band"), F.pmod(F.xxhash64("id"), F.col("_n")))
    return banded.join(beside, [group, "_band"]).select(*members.columns, own.alias("own"), "others")


def counted(members: DataFrame, group: str, linked: Callable[[pa.Table, pa.Table], np.ndarray]) -> DataFrame:
    """id, links, root and whole of each member (group, own, others, id, copies, and what linked looks at) and each two blocks.

    linked(a, b) is a matrix of truth. links: copies of the linked members of the other block, not the member's own;
    root: the smallest id that links reach within the two blocks; whole: these are all of the group, so root is its
    component. A member is copied once for each block that it meets, so the result grows with members, not with pairs.
    """
    met = members.withColumn("_whole", F.size("others") == 1).withColumn("_other", F.explode("others"))
    met = met.withColumns({"_i": F.least("own", "_other"), "_j": F.greatest("own", "_other"), "_first": F.col("own") <= F.col("_other")}).drop("own", "others", "_other")

    def of(t: pa.Table) -> pa.Table:
        alone = t.column("_i")[0] == t.column("_j")[0]
        first = t.column("_first").to_numpy(zero_copy_only=False)
        a = t if alone else t.filter(pa.array(first))
        b = t if alone else t.filter(pa.array(~first))
        found = linked(a, b) if a.num_rows and b.num_rows else np.zeros((a.num_rows, b.num_rows), bool)
        if alone:
            np.fill_diagonal(found, False)
        n, m = found.shape
        copies = lambda x: x.column("copies").to_numpy().astype(np.float64)
        ids, links = a.column("id").to_numpy(), found @ copies(b)
        i, j = np.nonzero(found)
        if not alone:
            ids, links, j = np.concatenate([ids, b.column("id").to_numpy()]), np.concatenate([links, found.T @ copies(a)]), j + n
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        root = ids[order][reached(len(ids), rank[i], rank[j])][rank]
        whole = np.full(len(ids), bool(alone and t.column("_whole")[0].as_py()))
        return pa.table([pa.array(ids, pa.int64()), pa.array(np.rint(links).astype(np.int64)), pa.array(root, pa.int64()), pa.array(whole)], names=["id", "links", "root", "whole"])

    return sorted_groups(met, [group, "_i", "_j"], of, COUNTED)


def summed(pairs: DataFrame, space: Workspace, name: str) -> DataFrame:
    """id, links and component of each member, of counted() as written; groups of several blocks are put together."""
    parts = pairs.where("NOT whole")
    merged = components(parts.select(F.col("id").alias("a"), F.col("root").alias("b")), space, name) if parts.limit(1).count() else None
    links = pairs.groupBy("id").agg(F.sum("links").alias("links"), F.min("root").alias("_root"))
    if merged is None:
        return links.withColumnRenamed("_root", "component")
    return links.join(merged, "id", "left").select("id", "links", F.coalesce("component", "_root").alias("component"))
