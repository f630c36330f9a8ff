"""What has no built-in: unified diffs, and formatters and readers registered by id."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

IDENTICAL = "Files are identical.\n"


def _masks(a: list[str], often: int = 64) -> Callable[[str], int]:
    """Of a line the places in a where it is, as bits; masks of lines that are there often are kept, others made when asked."""
    places: dict[str, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    kept: dict[str, int] = {}

    def of(line: str) -> int:
        if line in kept:
            return kept[line]
        at = places.get(line)
        if at is None:
            return 0
        bits = bytearray(len(a) // 8 + 1)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        mask = int.from_bytes(bits, "little")
        if len(at) >= often:
            kept[line] = mask
        return mask

    return of


def _row(a: list[str], b: list[str]) -> np.ndarray:
    """Of each i the length of the longest common subsequence of a[:i] and b, by rows of bits."""
    n, mask = len(a), _masks(a)
    full = (1 << n) - 1
    v = full
    for x in b:
        u = v & mask(x)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _short(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, read back from all rows of bits."""
    mask, full = _masks(a), (1 << len(a)) - 1
    v, rows = full, []
    for x in b:
        u = v & mask(x)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def matching(a: list[str], b: list[str], bits: int = 1 << 24) -> list[tuple[int, int]]:
    """Pairs of places of lines that stay, growing in both: as many as can be, for texts of any size.

    Rows of the table of common subsequences are held as bits, 64 lines a step. A table
    of more than ``bits`` is halved where the best paths meet, so memory grows with the
    lines alone; the result is as long either way.
    """
    here, there = set(a), set(b)
    x, y = [i for i, v in enumerate(a) if v in there], [j for j, v in enumerate(b) if v in here]
    a, b = [a[i] for i in x], [b[j] for j in y]
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        if (m - i) * (n - j) <= bits or n - j == 1:
            out += [(i + p, j + q) for p, q in _short(a[i:m], b[j:n])]
            continue
        half = (j + n) // 2
        met = _row(a[i:m], b[j:half]) + _row(a[i:m][::-1], b[half:n][::-1])[::-1]
        k = i + int(met.argmax())
        todo += [(i, k, j, half), (k, m, half, n)]
    return sorted((x[i], y[j]) for i, j in out)


def diff(old: str, new: str, context: int = 3) -> str:
    """A unified diff of two texts. Lines are compared as they are, and shown with tabs expanded."""
    a, b = (re.findall(r"[^\n]*\n|[^\n]+", x) for x in (old, new))
    if a == b:
        return IDENTICAL
    matcher = difflib.SequenceMatcher(None, [], [], autojunk=False)
    opcodes, i, j = [], 0, 0
    for x, y in [*matching(a, b), (len(a), len(b))]:
        if i < x or j < y:
            opcodes.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        if x < len(a) and y < len(b):
            if opcodes and opcodes[-1][0] == "equal":
                opcodes[-1] = ("equal", opcodes[-1][1], x + 1, opcodes[-1][3], y + 1)
            else:
                opcodes.append(("equal", x, x + 1, y, y + 1))
        i, j = x + 1, y + 1
    matcher.opcodes = opcodes
    out = ["--- original\n", "+++ updated\n"]
    span = lambda lo, hi: str(lo + 1) if hi - lo == 1 else f"{lo + (hi > lo)},{hi - lo}"
    shown = lambda mark, line: f"{mark}{line.rstrip(chr(10)).expandtabs()}\n" + ("" if line.endswith("\n") else "\\ No newline at end of file\n")
    for group in matcher.get_grouped_opcodes(context):
        out.append(f"@@ -{span(group[0][1], group[-1][2])} +{span(group[0][3], group[-1][4])} @@\n")
        for tag, lo, hi, lo2, hi2 in group:
            if tag == "equal":
                out += [shown(" ", x) for x in a[lo:hi]]
            else:
                out += [shown("-", x) for x in a[lo:hi]] + [shown("+", x) for x in b[lo2:hi2]]
    return "".join(out)


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """A unified diff, or a line that says that both are identical; a null text is an error, as a missing file is."""

    def one(a: str | None, b: str | None) -> str:
        if a is None or b is None:
            raise ValueError("the original text is missing" if a is None else "the updated text is missing")
        return diff(a, b)

    return pd.Series([one(a, b) for a, b in zip(old, new)])


class Registry:
    """Column functions by id, asked by an exact key, then by a default one, else an error."""

    def __init__(self):
        self.known: dict[tuple[str, ...], Callable[..., Column]] = {}

    def register(self, *key: str):
        def put(f: Callable[..., Column]) -> Callable[..., Column]:
            self.known[tuple(k.lower() for k in key)] = f
            return f

        return put

    def find(self, *key: str) -> Callable[..., Column]:
        key = tuple(k.lower() for k in key)
        for n in range(len(key)):
            if key[n:] in self.known:
                return self.known[key[n:]]
        raise KeyError(f"nothing is registered for {key}")


def install(spark: SparkSession) -> None:
    """Make unified_diff known to SQL."""
    spark.udf.register("unified_diff", unified_diff)
