"""Types and members of compiled classes, as archives hold them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.inheritance import compare_effective

PUBLIC, PRIVATE, PROTECTED = 1, 2, 4
#: Bytes behind the tag of each constant of a class file, but for texts, whose length is told.
_SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
_MAGIC = b"\xca\xfe\xba\xbe"
CLASS = "path string, type string, flags int, supers array<string>, members array<struct<kind string, name string, descriptor string, flags int>>"


def parsed(data: bytes) -> dict | None:
    """type, flags, supers (the superclass first) and members of a class file; None where it is none, or is cut off."""
    try:
        return _parsed(data) if data[:4] == _MAGIC else None
    except (struct.error, KeyError, IndexError):
        return None


def _parsed(data: bytes) -> dict:
    at = 8

    def number(kind: str) -> int:
        nonlocal at
        (v,) = struct.unpack_from(f">{kind}", data, at)
        at += struct.calcsize(kind)
        return v

    count, i = number("H"), 1
    texts: dict[int, str] = {}
    names: dict[int, int] = {}
    while i < count:
        tag = number("B")
        if tag == 1:
            n = number("H")
            texts[i] = data[at : at + n].decode("utf-8", "replace")
            at += n
        else:
            if tag == 7:
                (names[i],) = struct.unpack_from(">H", data, at)
            at += _SIZES[tag]
        i += 2 if tag in (5, 6) else 1
    name = lambda k: texts[names[k]].replace("/", ".")
    flags, this, up = number("H"), number("H"), number("H")
    supers = [name(up)] if up else []
    supers += [name(number("H")) for _ in range(number("H"))]
    members = []
    for kind in ("FIELD", "METHOD"):
        for _ in range(number("H")):
            access, called, descriptor = number("H"), texts[number("H")], texts[number("H")]
            for _ in range(number("H")):
                at += 2
                size = number("I")
                at += size
            members.append({"kind": "CONSTRUCTOR" if called == "<init>" else kind, "name": called, "descriptor": descriptor, "flags": access})
    return {"type": name(this), "flags": flags, "supers": supers, "members": members}


def classes(entries: DataFrame) -> DataFrame:
    """The classes among the entries of archives (path, entry, content; see readers.archive_entries); what isn't a whole class file is left out."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = pa.struct([("kind", pa.string()), ("name", pa.string()), ("descriptor", pa.string()), ("flags", pa.int32())])
        schema = pa.schema([("path", pa.string()), ("type", pa.string()), ("flags", pa.int32()), ("supers", pa.list_(pa.string())), ("members", pa.list_(member))])
        for batch in batches:
            found = zip(batch.column("path").to_pylist(), map(parsed, batch.column("content").to_pylist()), strict=True)
            yield pa.RecordBatch.from_pylist([{"path": path, **c} for path, c in found if c], schema)

    return entries.where(F.col("entry").endswith(".class")).select("path", "content").mapInArrow(of, CLASS)


def snapshot(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (type, kind, name, descriptor, flags) that others can use, and supertypes (type, super), of classes."""
    visible = lambda flags: flags.bitwiseAND(PUBLIC | PROTECTED) != 0
    members = found.where(visible(F.col("flags"))).select("type", F.explode("members").alias("m")).select("type", "m.*")
    supers = found.select("type", F.explode("supers").alias("super")).where("super != 'java.lang.Object'")
    return members.where(visible(F.col("flags"))), supers


def compare_archives(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changed between two archives' classes (see classes): type, kind, name, descriptor, changeStatus, flags and moved; types themselves as kind TYPE.

    A member counts wherever it is inherited from, so one that moved to a supertype of the
    archive isn't removed.
    """

    def of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        members, supers = snapshot(found)
        itself = found.where(F.col("flags").bitwiseAND(PUBLIC) != 0).select("type", F.lit("TYPE").alias("kind"), F.lit("").alias("name"), F.lit("").alias("descriptor"), "flags")
        return members.unionByName(itself), supers

    passed = F.col("kind").isin("FIELD", "METHOD") & (F.col("flags").bitwiseAND(PRIVATE) == 0)
    return compare_effective(of(old), of(new), ["kind", "name", "descriptor"], ["flags"], passed)
