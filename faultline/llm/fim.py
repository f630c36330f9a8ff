"""Fill-in-middle transformation: documents cut at seeded token boundaries that an index of distinct texts gives.

A token is a word with the white space before it, or the white space that ends a text;
white space is ASCII's. A distinct text's boundaries are a growing list of code point
offsets and are held as an Elias-Fano list, about 5 bits a token, whose i-th entry is
found without decoding the others.

Texts are dealt by a 64-bit hash and sorted by it and by content, so identical ones lie
side by side. Each is compared with the one before it, whole, so texts that merely share
a hash stay apart. The list of a distinct text is made once, where its copies begin, and
the documents that follow are merged with it: the join back moves nothing. Texts are
shuffled once, and only narrow columns are read before.

Skew: a hash with more than 1/1024 of all rows is dealt to several tasks by the place of
the row. There are 1,024 such hashes at most, whatever the table, so they are broadcast;
their lists are made once for each task that holds copies, 2,048 times more in all at most.

Defined results: a null text is empty; an empty text, and one that holds a sentinel,
is plain. A null doc_id counts as the empty string. Rows that repeat, or share a doc_id,
each give a row. A very long text is held whole by one task. Columns of the documents
stay, but those named like a result; text becomes a string. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from faultline.llm.shared import flattened, sliced, with_text
from faultline.llm.words import SPACE, flat, words

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MADE = ("n", "form", "prefix_chars", "middle_chars", "output")
#: A hash with more than this share of all rows is dealt to several tasks.
SHARE = 1024
_HEAD = struct.Struct("<QQB")
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def encoded(values: np.ndarray, most: int) -> bytes:
    """An Elias-Fano list of values that don't fall, none above most."""
    n = len(values)
    low = max(0, (most // max(n, 1)).bit_length() - 1)
    lows = np.packbits(((values[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel(), bitorder="little")
    unary = np.zeros(n + (most >> low) + 1, np.uint8)
    unary[(values >> low) + np.arange(n)] = 1
    return _HEAD.pack(n, most, low) + lows.tobytes() + np.packbits(unary, bitorder="little").tobytes()


def length(data: bytes) -> int:
    return _HEAD.unpack_from(data)[0]


def select(data: bytes, i: int) -> int:
    """The i-th value of a list, from 0."""
    n, _, low = _HEAD.unpack_from(data)
    if not 0 <= i < n:
        raise IndexError(i)
    at = _HEAD.size + (n * low + 7) // 8
    high = np.frombuffer(data, np.uint8, offset=at)
    upto = np.cumsum(_ONES[high])
    byte = int(np.searchsorted(upto, i + 1))
    rest = i - (int(upto[byte - 1]) if byte else 0)
    bit = [k for k in range(8) if high[byte] >> k & 1][rest]
    first, last = i * low, (i + 1) * low
    part = int.from_bytes(data[_HEAD.size + first // 8 : _HEAD.size + (last + 7) // 8], "little") >> first % 8
    return (byte * 8 + bit - i << low) | (part & (1 << low) - 1)


def boundaries(column: pa.Array) -> list[bytes]:
    """Of each text of a column the list of the offsets behind its tokens."""
    data, bounds = flat(column)
    _, ends = words(data, bounds)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    cut = np.searchsorted(ends, bounds, side="right")
    out = []
    for i in range(len(bounds) - 1):
        begin, end = bounds[i], bounds[i + 1]
        own = chars[ends[cut[i] : cut[i + 1]]] - chars[begin]
        most = int(chars[end] - chars[begin])
        if end > begin and SPACE[data[end - 1]]:
            own = np.append(own, most)
        out.append(encoded(own, most))
    return out


def seeded(seed: int, doc_id: object) -> list[int]:
    """Four numbers of 32 bits for a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(h[4 * k : 4 * k + 4], "big") for k in range(4)]


def arranged(text: str, tokens: bytes, plain: bool, h: list[int], rate: int, spm: int) -> tuple[str, int | None, int | None, str]:
    """form, code points of prefix and middle, and output of a text whose list is tokens."""
    if plain or h[2] % 100 >= rate:
        return "plain", None, None, text
    n = length(tokens)
    first, last = (select(tokens, k - 1) if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h[3] % 100 < spm:
        return "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def dealt(docs: DataFrame) -> DataFrame:
    """row (see nested) and key, where rows of one text lie together, in as many tasks as its share of all rows asks for."""
    rows = with_text(docs)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    key = F.xxhash64(text).alias("key")
    counts = rows.select(key).groupBy("key").agg(F.count("*").alias("copies"))
    most = max(1, (docs.count()) // SHARE)
    hot = counts.where(F.col("copies") > most).select("key", F.ceil(F.col("copies") / most).alias("salts"))
    salted = rows.select("row", key).join(F.broadcast(hot), "key", "left")
    salt = F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1))).alias("salt")
    return salted.select("row", "key", salt).repartition("key", "salt").sortWithinPartitions("key", "salt", F.coalesce(F.col("row.text"), F.lit("")))


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output.

    rate: percent of documents that are cut; spm: percent of those whose suffix comes first.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, plain = None, b"", True
        for batch in sliced(batches, "row.text"):
            row = batch.column("row")
            texts, ids = (x.to_pylist() for x in (row.field("text"), row.field("doc_id")))
            texts = [t or "" for t in texts]
            new = [i for i, t in enumerate(texts) if t != (texts[i - 1] if i else held)]
            lists = dict(zip(new, boundaries(row.field("text").take(pa.array(new, pa.int64()))), strict=True)) if new else {}
            out = []
            for i, (text, doc_id) in enumerate(zip(texts, ids, strict=True)):
                if i in lists:
                    held, tokens = text, lists[i]
                    plain = not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE))
                out.append((length(tokens), *arranged(text, tokens, plain, seeded(seed, doc_id), rate, spm)))
            n, form, before, between, output = zip(*out, strict=True)
            made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays([row, *made], names=["row", *MADE])

    rows = dealt(docs)
    kinds = (LongType(), StringType(), LongType(), LongType(), StringType())
    schema = StructType([rows.schema["row"], *[StructField(m, k) for m, k in zip(MADE, kinds, strict=True)]])
    return flattened(rows.mapInArrow(of, schema), *MADE)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No sentinel is in a text that was cut, nor can one arise across a cut."""
    part = F.split(output, "<[PSM]>")
    psm = F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1)))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and digests of the outputs and of the texts that they give back."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, text, n, form, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256 FROM p"""
