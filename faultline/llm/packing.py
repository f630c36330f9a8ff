"""Best-fit packing of token sequences, bulk-synchronous.

Documents are range-sorted by length and gaps by size. In each round one sweep over
both, by growing size, gives every gap the longest unplaced document for which it is
the successor, the smallest gap that is large enough; where more documents than gaps
meet, ranks decide. Then gaps are updated, and the next round begins. When a sweep
places nothing, as many sequences are opened as what is left needs at least.

Lengths are integers up to the capacity, so the sorted documents are at most ``capacity``
runs of equal lengths at any number of documents, and gaps are runs of sequences that
were filled alike. The sweep over rows is worked out on these runs: which gap a row gets
follows from its rank within its length, so a round moves intervals of ranks, and rows
are ranked and placed once, on the executors:

* a task that cuts texts into pieces also numbers its pieces within each length;
* counts by (task, length) give each task its first rank; the table joined back is
  that of counts, and a length that a third of all rows have stays spread over tasks;
* a piece finds its interval by binary search in the list of intervals, the only thing
  that is broadcast. Its length depends on the lengths that occur and on the rounds, not
  on the number of documents: the README has figures, and tests hold it against sweeps
  over rows with carries between ranges.

Defined results: a null text is empty; an empty text is the closing id alone; a very
long text is cut by one task, its ids held whole; of pieces of one length those of
earlier tasks have the lower ranks, and of equal gaps the sequence opened first is
filled first; rows that repeat are packed each; null doc_ids are kept; further columns
are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import Workspace, sliced
from faultline.llm.tokens import default_path, tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def cut(docs: DataFrame, capacity: int, path: str, closing: int, with_ids: bool) -> DataFrame:
    """A row for each piece of at most capacity ids, with its place among the task's pieces of its length."""
    end = int(closing).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        for batch in sliced(batches, "text"):
            docs, nth, start, length, crc, place, ids = [], [], [], [], [], [], []
            for doc, got in zip(batch.column("doc_id").to_pylist(), tokenizer(path).ids(batch.column("text"))):
                got += end
                for k, at in enumerate(range(0, len(got), 4 * capacity)):
                    part = got[at : at + 4 * capacity]
                    n = len(part) // 4
                    docs.append(doc)
                    nth.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    place.append(seen[n])
                    seen[n] += 1
                    if with_ids:
                        ids.append(part)
            out = [pa.array(docs, pa.int64()), pa.array(nth, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            out += [pa.array([task] * len(docs), pa.int32()), pa.array(place, pa.int64())]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, documents, documents a sequence, first sequence, offset): the rounds over runs of equal sizes."""
    left = dict(counts)
    used = dict.fromkeys(counts, 0)
    gaps: dict[int, list[list[int]]] = {}
    out: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def place(size: int, n: int, each: int, first: int, gap: int) -> None:
        out.append((size, used[size], n * each, each, first, capacity - gap))
        used[size] += n * each
        left[size] -= n * each
        if rest := gap - size * each:
            updated.setdefault(rest, []).append([first, n])

    def open_for(sizes: list[int], most: int) -> None:
        nonlocal opened
        for size in sizes:
            if (n := min(left[size], most)) > 0:
                place(size, n, 1, opened, capacity)
                opened, most = opened + n, most - n

    updated = gaps
    open_for([s for s in sorted(left, reverse=True) if 2 * s > capacity], sum(left.values()))
    while any(left.values()):
        updated = {}
        stack: list[int] = []
        placed = False
        for size in sorted({s for s, n in left.items() if n} | gaps.keys()):
            if left.get(size):
                stack.append(size)
            runs = gaps.pop(size, [])
            for first, n in runs:
                while n and stack:
                    top = stack[-1]
                    take = min(n, left[top])
                    each = min(size // top, max(1, left[top] // n))
                    place(top, take, each, first, size)
                    placed = True
                    first, n = first + take, n - take
                    if not left[top]:
                        stack.pop()
                if n:
                    updated.setdefault(size, []).append([first, n])
        gaps = updated
        if not placed:
            rest = sum(s * n for s, n in left.items())
            open_for([s for s in sorted(left, reverse=True) if left[s]], -(-rest // capacity))
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def pack(docs: DataFrame, capacity: int = 4096, path: str | None = None, closing: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for, of each piece of each row."""
    spark = docs.sparkSession
    kept = Workspace(spark, "pack").keep(cut(docs, capacity, path or default_path(), closing, with_ids), "pieces")
    counts = kept.groupBy("task", "length").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    intervals = spark.sparkContext.broadcast(plan(totals, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    shift = 40

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, _, each, sequence, offset = intervals.value.T if len(intervals.value) else np.zeros((6, 0), np.int64)
        keys = (size << shift) + first
        for batch in batches:
            n, rank = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            i = np.searchsorted(keys, (n << shift) + rank, "right") - 1
            nth = rank - first[i]
            found = [pa.array(sequence[i] + nth // each[i]), pa.array(offset[i] + nth % each[i] * n)]
            keep = [x for x in batch.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in keep] + found, [*keep, "sequence_id", "offset"])

    out = kept.join(ranks, ["task", "length"]).withColumn("rank", F.col("place") + F.col("before"))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids + "sequence_id long, offset long"
    return out.select(*cols, "rank").mapInArrow(placed, schema)
