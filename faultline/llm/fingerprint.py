"""Document fingerprints by a randomised edit embedding, and near copies by bands of them.

Embedding: a shared random walk reads a text. At step j it notes the character that it
stands on, and goes on to the next or stays as a random function of j and that character
says; so an edit throws two walks apart for a while only, and edit distance becomes
Hamming distance of what they note. It takes 3 steps a character; behind the text's end
it notes a blank. Characters are code points, hashed to 15 symbols. Four steps at a time
are looked up in a table (the functions repeat every 64 steps), for all texts of a batch
at once.

Sampling: of every fourth step those are kept whose hash ends in ``level`` zero bits; the
level grows with the text, so 64 to 128 are kept of any. Samples of a level are among
those of the one below, so fingerprints of different levels can be compared.

A fingerprint is the level and, for each of WALKS walks, its samples as hex digits, blanks
at the end left out. Likeness: the share of samples, of all that aren't blank in both,
where two fingerprints are alike, by the walk where it is largest (edit embeddings are
repeated since a single walk may stay apart for long).

Near copies: TAKEN samples drawn in a random order make a band, however many texts there
are, so whether two texts are linked by a band is up to them alone; texts that share a band are candidates, and links are counted between candidates in
blocks, by the likeness of whole fingerprints. Equal fingerprints are one class with a
count, so copies aren't expanded into pairs.

The next document, by descending doc_id, is found by ranges: their first rows (as many as
ranges) are also sent to the range before. A text is sent once, compressed.

Defined results: a null text is empty, and its likeness is 1 to an empty text, else 0.
Rows of one doc_id follow each other in the order of their places; null doc_ids come last.
A single document is its own next. Very long texts are held whole by one task. Columns of
the documents other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import links
from faultline.llm.shared import Workspace, located, sliced

SEED, WALKS, PERIOD, LEAST, BANDS, TAKEN = 11, 4, 16, 64, 12, 10
#: Likeness from which two texts are near copies.
NEAR = 0.9
#: Text of a batch whose walks go side by side.
BATCH_BYTES = 1 << 22
PRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@functools.cache
def tables() -> np.ndarray:
    """How far four steps lead, by block, walk and the four symbols ahead, 4 bits each; symbol 0 is behind the end and goes nowhere."""
    goes = np.random.default_rng(SEED).integers(0, 2, (PERIOD, WALKS, 4, 16)).astype(np.uint8)
    goes[..., 0] = 0
    ahead = np.arange(1 << 16, dtype=np.uint32)
    out = np.zeros((PERIOD, WALKS, 1 << 16), np.uint8)
    for b in range(PERIOD):
        for w in range(WALKS):
            at = out[b, w]
            for k in range(4):
                at += goes[b, w, k][(ahead >> (4 * at.astype(np.uint32))) & 15]
    return out.reshape(PERIOD, -1)


@functools.lru_cache(256)
def samples(level: int, blocks: int) -> np.ndarray:
    """The blocks, of so many, whose first step is kept at a level."""
    h = np.arange(blocks, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.flatnonzero(h & np.uint64((1 << level) - 1) == 0)


def shape(n: int) -> tuple[int, int]:
    """Blocks of four steps, and level, of a text of n characters."""
    blocks = (3 * n + 3) // 4
    return blocks, max(0, (blocks // LEAST).bit_length() - 1)


def _known(level: int, blocks: int) -> np.ndarray:
    """samples(), cached by powers of two."""
    out = samples(level, 1 << max(blocks, 1).bit_length())
    return out[: np.searchsorted(out, blocks)]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The four symbols from each character on, of all texts, each with four blanks behind it; and where texts begin."""
    parts, starts, at = [], [], 0
    for t in texts:
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        parts += [1 + ((c * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16) % np.uint16(15), np.zeros(4, np.uint16)]
        starts.append(at)
        at += len(c) + 4
    one = np.concatenate([*parts, np.zeros(4, np.uint16)])
    del parts
    n = len(one) - 4
    ahead = one[:n].copy()
    for k in (1, 2, 3):
        ahead |= one[k : n + k] << 4 * k
    return ahead, np.array(starts, np.int64)


def embedded(texts: list[str]) -> list[np.ndarray]:
    """Of each text the samples of its walks, WALKS rows."""
    out: list[np.ndarray] = [np.zeros((WALKS, 0), np.uint8)] * len(texts)
    shapes = [shape(len(t)) for t in texts]
    steps = tables()
    for level in {s[1] for s in shapes}:
        own = [i for i, s in enumerate(shapes) if s[1] == level]
        ahead, starts = symbols([texts[i] for i in own])
        most = max(shapes[i][0] for i in own)
        kept = _known(level, most)
        walk = np.tile(np.arange(WALKS, dtype=np.int64) << 16, len(own))
        at = np.repeat(starts, WALKS)
        seen = np.zeros((len(kept), len(at)), np.uint8)
        value, place, step = np.empty(len(at), np.uint16), np.empty(len(at), np.int64), np.empty(len(at), np.uint8)
        k = 0
        for b in range(most):
            np.take(ahead, at, out=value, mode="clip")
            if k < len(kept) and kept[k] == b:
                np.bitwise_and(value, 15, out=seen[k], casting="unsafe")
                k += 1
                # The last samples are blank once every walk is through.
                if k % 64 == 0 and not value.any():
                    break
            np.add(value, walk, out=place)
            np.take(steps[b % PERIOD], place, out=step, mode="clip")
            at += step
        for j, i in enumerate(own):
            out[i] = seen[: np.searchsorted(kept, shapes[i][0]), j * WALKS : (j + 1) * WALKS].T.copy()
    return out


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def shown(level: int, walks: np.ndarray) -> str:
    return ".".join([str(level), *(_HEX[w].tobytes().decode().rstrip("0") for w in walks)])


def parsed(fingerprint: str) -> tuple[int, np.ndarray]:
    """level and samples, blanks at the end."""
    level, *walks = fingerprint.split(".")
    out = np.zeros((WALKS, max(map(len, walks))), np.uint8)
    for w, digits in enumerate(walks):
        d = np.frombuffer(digits.encode(), np.uint8)
        out[w, : len(d)] = np.where(d >= 97, d - 87, d - 48)
    return int(level), out


def lifted(level: int, walks: np.ndarray, to: int) -> np.ndarray:
    """The samples that a higher level would have kept."""
    if level == to:
        return walks
    many = 1 << (4 * (walks.shape[-1] + LEAST) << level).bit_length()
    return walks[..., np.isin(samples(level, many)[: walks.shape[-1]], samples(to, many))]


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    level = max(a[0], b[0])
    x, y = lifted(*a, level), lifted(*b, level)
    n, m = min(x.shape[1], y.shape[1]), max(x.shape[1], y.shape[1])
    longer = x if x.shape[1] == m else y
    alike = ((x[:, :n] == y[:, :n]) & (x[:, :n] > 0)).sum(1)
    there = ((x[:, :n] > 0) | (y[:, :n] > 0)).sum(1) + (longer[:, n:] > 0).sum(1)
    return float((alike / np.maximum(there, 1)).max()) if there.any() else 1.0


def _ranges(docs: DataFrame, n: int) -> list[tuple]:
    """The first row's order (see _order) of each of about n ranges of docs."""
    order = (F.desc_nulls_last("doc_id"), "file", "at")
    key = F.struct(F.col("doc_id").isNull().alias("none"), (-F.coalesce("doc_id", F.lit(0)).cast("decimal(20,0)")).alias("down"), "file", "at")
    firsts = docs.select("doc_id", "file", "at").repartitionByRange(n, *order).groupBy(F.spark_partition_id()).agg(F.min(key).alias("k")).collect()
    return sorted((r.k.none, int(r.k.down), r.k.file, r.k.at) for r in firsts)


def _order(doc_id: int | None, file: int, at: int) -> tuple:
    return doc_id is None, -(doc_id or 0), file, at


def in_order(docs: DataFrame, space: Workspace) -> DataFrame:
    """doc_id, file, at, packed (the text, compressed), range and guest: each range in order holds its rows, and as a guest the row that follows its last."""
    rows = located(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), space)
    rows = rows.select("row.doc_id", "file", "at", "row.text")
    firsts = _ranges(rows, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in sliced(batches, "text"):
            out = []
            for doc_id, file, at, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "file", "at", "text")), strict=True):
                row, key = (doc_id, file, at, pack(text.encode())), _order(doc_id, file, at)
                r = bisect_right(firsts, key) - 1
                out.append((*row, r, False))
                if firsts[r] == key:
                    out.append((*row, (r - 1) % len(firsts), True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "file", "at", "packed", "range", "guest"])

    sent = rows.mapInArrow(of, "doc_id long, file long, at long, packed binary, range int, guest boolean")
    return sent.repartition("range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), "file", "at")


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the following one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    held: list[tuple] = []

    def of() -> pa.RecordBatch:
        """All held rows but guests and the last, which waits for the one that follows it."""
        texts = [h[1] for h in held]
        own = [i for i in range(len(held) - 1) if not held[i][2]]
        changed = [edited(texts[i], texts[i + 1]) for i in own]
        found = embedded(texts + changed)
        prints = [(shape(len(t))[1], f) for t, f in zip(texts + changed, found, strict=True)]
        out = []
        for k, i in enumerate(own):
            a, e = prints[i], prints[len(texts) + k]
            out.append((held[i][0], len(texts[i]), hashlib.sha256(changed[k].encode("utf-8", "surrogatepass")).hexdigest(), shown(*a), shown(*e), likeness(a, e), likeness(a, prints[i + 1])))
        del held[:-1]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        columns = zip(*out, strict=True) if out else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PRINTS.split(", ")])

    size = 0
    for batch in sliced(batches, "packed"):
        for doc_id, packed, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "guest")), strict=True):
            text = unpack(packed)
            size += len(text)
            held.append((doc_id, text.decode(), guest))
            if size > BATCH_BYTES:
                yield of()
                size = 0
    if held:
        yield of()


def fingerprints(docs: DataFrame, space: Workspace) -> DataFrame:
    """PRINTS of each document."""
    return in_order(docs, space).mapInArrow(_printed, PRINTS)


@functools.cache
def _draws() -> np.ndarray:
    """For each band an order of samples."""
    r = np.random.default_rng(SEED + 1)
    return np.array([r.permutation(4 * LEAST) for _ in range(BANDS)])


@functools.lru_cache(4096)
def _drawn(band: int, reach: int) -> tuple[np.ndarray, bytes]:
    """The first samples of a band's order that lie below reach, and as bytes."""
    order = _draws()[band]
    at = order[order < reach][:TAKEN]
    return at, at.astype(np.uint8).tobytes()


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands of TAKEN samples each; of a text near the next level also those of that level."""
    for batch in sliced(batches, "fingerprint"):
        ids, keys = [], []
        for id_, text, n in zip(*(batch.column(c).to_pylist() for c in ("id", "fingerprint", "n_chars")), strict=True):
            level, walks = parsed(text)
            blocks = shape(n)[0]
            for up in (level, level + 1) if blocks / (LEAST << level) > 1.75 else (level,):
                found = lifted(level, walks, up)
                reach = max(1, round(blocks / (1 << up) * 2 / 3))
                padded = np.zeros((WALKS, 4 * LEAST), np.uint8)
                padded[:, : found.shape[1]] = found[:, : 4 * LEAST]
                for b in range(BANDS):
                    at, places = _drawn(b, reach)
                    ids.append(id_)
                    keys.append(int.from_bytes(hashlib.blake2b(padded[b % WALKS][at].tobytes() + places, digest_size=8, key=bytes((b, up))).digest(), "little", signed=True))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64())], names=["band", "id"])


def _linked(a: pa.Table, b: pa.Table) -> np.ndarray:
    """Whether the likeness of fingerprints of two blocks, of one level each, is NEAR at least."""
    both = [[parsed(f) for f in t.column("fingerprint").to_pylist()] for t in (a, b)]
    level = max(both[0][0][0], both[1][0][0])
    wide = 0
    lifts = [[lifted(*f, level) for f in side] for side in both]
    wide = max(x.shape[1] for side in lifts for x in side)
    x, y = (np.stack([np.pad(f, ((0, 0), (0, wide - f.shape[1]))) for f in side]) for side in lifts)
    out = np.zeros((len(x), len(y)), bool)
    for i, f in enumerate(x):
        alike = ((y == f) & (f > 0)).sum(2)
        there = ((y > 0) | (f > 0)).sum(2)
        out[i] = (alike >= NEAR * np.maximum(there, 1)).any(1) | ~there.any(1)
    return out


def near_copies(prints: DataFrame, space: Workspace) -> DataFrame:
    """prints (doc_id, n_chars, fingerprint and more) with n_near, the other documents linked to each, and near_id, the smallest doc_id that links reach."""
    with Workspace(prints.sparkSession, "fingerprint-links") as meanwhile:
        classes = prints.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min("n_chars").alias("n_chars"))
        classes = meanwhile.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
        bands = classes.select("id", "fingerprint", "n_chars").mapInArrow(_bands, "band long, id long")
        least = meanwhile.keep(bands.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").select("band", "a"), "bands")
        # A class hangs on the least of the first classes of its bands, as each of these does on another; only those that classes hang on are linked, few and often the same.
        hooks = bands.join(least, "band").groupBy("id").agg(F.min("a").alias("hook"), F.collect_set("a").alias("firsts"))
        hooks = meanwhile.keep(hooks, "hooks")
        firsts = hooks.select("hook", F.explode("firsts").alias("first")).where("hook != first").distinct()
        hung = hooks.select(F.col("id").alias("first"), F.col("hook").alias("b"))
        edges = meanwhile.keep(firsts.join(hung, "first").select(F.col("hook").alias("a"), "b").where("a != b").distinct(), "edges")
        groups = links.components(edges, meanwhile, "candidates").select(F.col("id").alias("hook"), "component")
        groups = hooks.join(groups, "hook", "left").select("id", F.coalesce("component", "hook").alias("component"))
        members = meanwhile.keep(groups.join(classes, "id").select("component", "id", "copies", "fingerprint"), "members")
        level = "CAST(substring_index(fingerprint, '.', 1) AS BIGINT)"
        dealt = meanwhile.keep(links.dealt(members, meanwhile, "members", "component", 512, band=level), "dealt")
        pairs = meanwhile.keep(links.counted(dealt, "component", _linked), "pairs")
        merged = links.summed(pairs, meanwhile, "near")
        found = classes.select("id", "fingerprint", "copies", "least").join(merged, "id", "left").withColumn("component", F.coalesce("component", "id"))
        found = meanwhile.keep(found, "found")
        top = found.groupBy("component").agg(F.min("least").alias("near_id"))
        result = found.join(top, "component").select("fingerprint", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_near"), "near_id")
        kept = space.keep(result, "near")
    # The few columns of classes are hashed by partition, so the wide rows need no sort.
    return prints.join(kept.hint("shuffle_hash"), "fingerprint")


def of_documents(docs: DataFrame, space: Workspace | None = None) -> DataFrame:
    """PRINTS, n_near and near_id of each document; the tables that the result reads go with space, by default at the driver's end."""
    space = space or Workspace(docs.sparkSession, "fingerprints")
    return near_copies(space.keep(fingerprints(docs, space), "prints"), space)
