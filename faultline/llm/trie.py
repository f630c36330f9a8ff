"""Prefix trie of conversations, from an LCP-aware mergesort of their turns.

A turn is known by a SHA-256 digest of its role and text. Conversations are dealt by
ranges of their sequences of digests and, where those are equal, of conv_id, so however
many begin or are alike, no range has more than its share. In each range Arrow batches
become sorted runs that carry, with each sequence, the number of turns that it shares
with the one before (LCP); a loser tree merges the runs and compares turns only beyond
what the LCPs already tell. The merged stream keeps its open path on a stack, and a node
is finished when a sequence comes that doesn't go through it.

What a node has (members, leaves, words) are sums over its members, so a node whose
members lie in several ranges is the sum of its parts. Only nodes on the path of a
range's first or last sequence can be such: these are given out as parts and added up;
whether the first path was new, and whether the last node is a leaf, is told by the range
before and the one behind, of which only the first and the last sequence are read.

Memory: a range's digests (32 bytes a turn) and its nodes; ranges are as many as there
are shuffle partitions. The list of a node's ends is hashed in order, piece by piece.

Defined results: rows without a conv_id belong to no conversation; null roles and texts
are empty; of turns with one number (or none) that with the smaller digest comes first,
and repeated ones all count. A conversation, however long, is held whole by one task, as
digests. Other columns are ignored. An empty table has no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations of one group of so many ids begin with turns of the group's first.
GROUP = 20
#: Ids of a piece of a node's ends.
PIECE = 4096
#: Parts that children of divided nodes are dealt to.
SALTS = 64
_EMPTY = hashlib.sha256(b"").hexdigest()
BUILT = (
    "kind string, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "used long, told long, text string, part int, first_keys array<binary>, first_words array<long>, last_keys array<binary>"
)
Sequence = list[bytes]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, each an id and its words, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"))
    ordered = F.array_sort(F.collect_list("t"), lambda a, b: _compared(a, b))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def _compared(a: Column, b: Column) -> Column:
    """Turns in order, nulls first, then digests."""
    null = F.when(a["turn"].isNull(), 0).otherwise(1) - F.when(b["turn"].isNull(), 0).otherwise(1)
    by = lambda x: F.when(a[x] < b[x], -1).when(a[x] > b[x], 1).otherwise(0)
    return F.when(null != 0, null).when(by("turn") != 0, by("turn")).otherwise(by("id"))


def rebuilt(conversations: DataFrame, space: Workspace) -> DataFrame:
    """turns() where each conversation's first h turns are those of its group's first conversation; h = crc32(conv_id) % 4."""
    own = space.keep(turns(conversations), "turns")
    c = F.col("conv_id")
    heads = own.where(c % GROUP == 0).select(c.alias("base"), F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(c.cast("string").cast("binary")) % 4).cast("int")
    rows = own.select("conv_id", "turns", h.alias("h"), (c - c % GROUP).alias("base")).join(heads, "base", "left")
    none = F.array().cast(own.schema["turns"].dataType)
    return rows.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def common(a: Sequence, b: Sequence, k: int = 0) -> int:
    """How many turns two sequences share, of which k are known to be alike."""
    most = min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    return k


class Run:
    """Conversations in order, each with its LCP with the one before."""

    def __init__(self, rows: Iterable[tuple[Sequence, int, list[int]]]):
        self.rows = sorted(rows, key=lambda r: r[:2])
        self.lcp = [common(a[0], b[0]) for a, b in zip([([], 0, []), *self.rows], self.rows, strict=False)]


def merged(runs: list[Run]) -> Iterator[tuple[Sequence, int, list[int], int]]:
    """All rows of the runs in order, each with its LCP with the one before.

    A tree of losers: lcp[i] is that of run i's next row with the row that beat it last,
    so of two rows that one row beat, that with the larger LCP comes first, unseen.
    """
    at = [0] * len(runs)
    lcp = [0] * len(runs)

    def beats(a: int, b: int) -> bool:
        """Whether run a's next row comes before run b's; the loser's LCP becomes that with the winner."""
        if at[a] == len(runs[a].rows) or at[b] == len(runs[b].rows):
            return at[b] == len(runs[b].rows)
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        x, y = runs[a].rows[at[a]], runs[b].rows[at[b]]
        k = common(x[0], y[0], lcp[a])
        first = x[1] <= y[1] if k == len(x[0]) == len(y[0]) else k == len(x[0]) or (k < len(y[0]) and x[0][k] < y[0][k])
        lcp[b if first else a] = k
        return first

    n = len(runs)
    losers = [-1] * n
    for leaf in range(n):
        i, node = leaf, (leaf + n) // 2
        while node and losers[node] >= 0:
            if not beats(i, losers[node]):
                i, losers[node] = losers[node], i
            node //= 2
        losers[node] = i
    while n and at[winner := losers[0]] < len(runs[winner].rows):
        yield (*runs[winner].rows[at[winner]], lcp[winner])
        at[winner] += 1
        lcp[winner] = runs[winner].lcp[at[winner]] if at[winner] < len(runs[winner].rows) else 0
        i, node = winner, (winner + n) // 2
        while node:
            if not beats(i, losers[node]):
                i, losers[node] = losers[node], i
            node //= 2
        losers[0] = i


class _Node:
    """An open node. used: words of its subtree by members; told: by nodes, but for those of the first path."""

    __slots__ = ("children", "conv", "convs", "depth", "ends", "first", "id", "key", "kids", "inner", "leaves", "told", "used", "words")

    def __init__(self, depth: int, id_: bytes, words: int, key: bytes | None):
        self.depth, self.id, self.words, self.key, self.first = depth, id_, words, key, key is not None
        self.conv, self.inner, self.convs, self.children, self.leaves, self.used, self.told = None, False, 0, 0, 0, 0, 0
        self.ends: list[int] = []
        self.kids: list[dict] = []


def below(key: bytes, id_: bytes) -> bytes:
    """The key of the node that a turn leads to."""
    return hashlib.sha256(key + id_).digest()


def listed(ends: list[int]) -> str:
    return ",".join(map(str, ends))


def nodes(stream: Iterator[tuple[Sequence, int, list[int], int]], part: int) -> Iterator[dict]:
    """Rows of BUILT: nodes that are whole, parts of those on the first or the last path, pieces of their ends, and the two paths."""
    root = _Node(0, b"", 0, b"")
    path, first, seen = [root], None, False

    def finished(last: bool = False) -> Iterator[dict]:
        n = path.pop()
        # Whether the last conversation's own node is a leaf, the next range tells.
        n.leaves += not n.inner and not (last and n is tip)
        n.used += n.convs * n.words
        n.told += 0 if n.first else n.words
        row = {"conv_id": n.conv, "depth": n.depth, "n_convs": n.convs, "n_children": n.children, "n_leaves": n.leaves, "used": n.used, "told": n.told}
        whole = n.key is None
        if path:
            up = path[-1]
            up.conv = n.conv if up.conv is None else min(up.conv, n.conv)
            up.convs, up.leaves, up.used, up.told = up.convs + n.convs, up.leaves + n.leaves, up.used + n.used, up.told + n.told
            up.children += not n.first
        for kid in n.kids:
            yield kid | ({"parent_conv_id": n.conv} if whole else {"parent_key": n.key})
        if whole:
            path[-1].kids.append(row | {"kind": "node", "text": hashlib.sha256(listed(n.ends).encode()).hexdigest()})
            return
        yield row | {"kind": "part", "key": n.key, "parent_key": path[-1].key if path else None}
        for i in range(0, len(n.ends), PIECE):
            yield {"kind": "piece", "key": n.key, "conv_id": n.ends[i], "text": listed(n.ends[i : i + PIECE])}

    for ids, conv, words, lcp in stream:
        while len(path) > lcp + 1:
            yield from finished()
        for k in range(lcp, len(ids)):
            path[-1].inner = True
            path.append(_Node(k + 1, ids[k], words[k], None if seen else below(path[-1].key, ids[k])))
        if not seen:
            first, seen = ([n.key for n in path[1:]], words), True
        tip = path[-1]
        tip.ends.append(conv)
        tip.convs += 1
        tip.conv = conv if tip.conv is None else min(tip.conv, conv)
    if not seen:
        return
    for up, n in zip(path, path[1:], strict=False):
        n.key = n.key or below(up.key, n.id)
    yield {"kind": "path", "part": part, "first_keys": first[0], "first_words": first[1], "last_keys": [n.key for n in path[1:]]}
    while path:
        yield from finished(last=True)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = []
    for batch in batches:
        both = (batch.column(c).to_pylist() for c in ("ids", "words", "conv_id"))
        runs.append(Run((i, c, w) for i, w, c in zip(*both, strict=True)))
    names = [x.split()[0] for x in BUILT.split(", ")]
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in BUILT.split(", ")])
    held = []
    for row in nodes(merged(runs), TaskContext.get().partitionId()):
        held.append({c: row.get(c) for c in names})
        if len(held) == 4096:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the neighbours of a range tell of the nodes on its first and last path: children and words that are new, a leaf."""
    for batch in batches:
        for r in batch.to_pylist():
            keys, out = [b"", *r["first_keys"]], []
            shared = common(r["first_keys"], r["before"]) if r["before"] is not None else 0
            told = 0
            for e in range(len(keys) - 1, -1, -1):
                told += r["first_words"][e - 1] if e > shared else 0
                out.append((keys[e], int(shared < e + 1 < len(keys)), 0, told))
            last = r["last_keys"]
            if r["behind"] is None or common(last, r["behind"]) < len(last):
                out += [(key, 0, 1, 0) for key in [b"", *last]]
            key, children, leaves, told = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), *[pa.array(x, pa.int64()) for x in (children, leaves, told)]], names=["key", "n_children", "n_leaves", "told"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's texts, comma-joined as they come."""
    key, digest = None, None
    made = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "text"])
    for batch in batches:
        for k, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if k != key or digest is None:
                if digest is not None:
                    yield made()
                key, digest = k, hashlib.sha256(text.encode())
            else:
                digest.update(f",{text}".encode())
    if digest is not None:
        yield made()


def trie(sequences: DataFrame, space: Workspace) -> DataFrame:
    """The nodes of conversations (conv_id, turns of id and words): see the contract of op12; their tables are kept in space."""
    n = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sequences.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words"))
    built = space.keep(rows.repartitionByRange(n, "ids", "conv_id").mapInArrow(_build, BUILT), "built")
    of = lambda kind: built.where(F.col("kind") == kind)
    order = Window.orderBy("part")  # one row a range
    paths = of("path").select("first_keys", "first_words", "last_keys", F.lag("last_keys").over(order).alias("before"), F.lead("first_keys").over(order).alias("behind"))
    mended = paths.mapInArrow(_corrected, "key binary, n_children long, n_leaves long, told long")
    sums = ("n_convs", "n_children", "n_leaves", "used", "told")
    parts = of("part").select("key", "parent_key", "conv_id", "depth", *sums).unionByName(mended, allowMissingColumns=True)
    whole = parts.groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in sums])
    ends = of("piece").select("key", "conv_id", "text").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hashed, "key binary, text string")
    divided = space.keep(whole.join(ends, "key", "left").withColumn("text", F.coalesce("text", F.lit(_EMPTY))), "divided")
    salted = divided.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_up"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    plain = of("node").where("parent_key IS NULL")
    under = of("node").where("parent_key IS NOT NULL").drop("key").unionByName(divided, allowMissingColumns=True)
    under = under.withColumn("_salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int")).join(salted, ["parent_key", "_salt"], "left").withColumn("parent_conv_id", F.col("_up"))
    out = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("used") - F.col("told")).alias("saved_tokens"), F.col("text").alias("ends_sha256"))
    return plain.select(*out).unionByName(under.select(*out))


def of_conversations(conversations: DataFrame, space: Workspace | None = None) -> DataFrame:
    """The nodes of the rebuilt conversations; the tables that the result reads go with space, by default at the driver's end."""
    spark = conversations.sparkSession
    with Workspace(spark, "trie-turns") as meanwhile:
        return trie(rebuilt(conversations, meanwhile), space or Workspace(spark, "trie"))


ORACLE = r"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
x AS (SELECT DISTINCT conv_id, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS steps FROM t),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, steps), lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT) % 4 AS h FROM x),
b AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
s AS (SELECT conv_id, row_number() OVER w AS d, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER w) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)),
p AS (SELECT conv_id, 0 AS d, '' AS key, 0 AS words FROM c UNION ALL SELECT conv_id, d, key, words FROM s),
q AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS up, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT d, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS sha FROM q GROUP BY d, key),
k AS (SELECT up AS key, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, key)),
a AS (SELECT p.d, p.key, count(*) FILTER (m.n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY p.d, p.key)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, a.n_leaves, a.saved_tokens, m.sha AS ends_sha256
FROM m JOIN a USING (d, key) LEFT JOIN n u ON u.key = m.up AND u.d = m.d - 1"""
