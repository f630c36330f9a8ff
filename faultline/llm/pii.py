"""Personal data: patterns, and a linear-chain conditional random field over word shapes.

The field labels white-space words as email, ip, card, phone or none. Its features are
the shapes of a word and of its neighbours (runs of equal character classes; words that
spell a digit, at or dot have shapes of their own), the word's length and its number of
digits. It is trained on a small labelled table of sentences, by gradients of the
log-likelihood, and decoded by Viterbi over numpy batches: every word of every text, in
windows of words that overlap on either side, so long texts are as many rows of a batch.

What the patterns find stays; the field adds spans that overlap none of them: numbers
written another way, and addresses and numbers that are spelled out. Adjacent words of
one label may be several items, such as a list with a number a line: what the patterns
leave of them is parted so that plausible items cover most digits.

Every text is read whole, within its row: no shuffle, and memory is bounded by a
batch of about 1 MB of text or one text.

Defined results: a null text is empty and has no spans; of equally likely labels of a
word the first of none, email, ip, card and phone counts; rows that repeat get a row
each; null doc_ids are kept; further columns are ignored by find() and kept by redact(),
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import words
from faultline.llm.shared import sliced

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A try from inside a run of digits fails where the one from its start did, so only starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards so that long runs cost no second look."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def patterns(text: str) -> list[Span]:
    """The base spans, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(int(x) <= 255 if len(x) < 4 else not x.lstrip("0")[3:] and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# --- the labelled table -------------------------------------------------------


#: Words that spell digits, and those that spell signs of addresses.
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "oh")
SIGNS = {"at": "@", "[at]": "@", "(at)": "@", "dot": ".", "[dot]": ".", "(dot)": "."}


def labelled_table(sentences: int = 1200, seed: int = 23) -> list[list[tuple[str, str]]]:
    """Sentences of (word, label): prose, personal data in several spellings, and numbers that are none."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    name = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9)))

    def prose(n):
        return [(name().capitalize() if r.random() < 0.1 else name() + r.choice(["", "", "", ",", "."]), "none") for _ in range(n)]

    def email():
        return [f"{name()}{r.choice(['', '.', '_', '-'])}{r.choice([name(), digits(2)])}@{name()}{r.choice(['', digits(1)])}.{r.choice(['com', 'org', 'example.com', 'co.uk'])}"]

    def ip():
        return [".".join(str(r.randint(1, 255)) for _ in range(4))]

    def card():
        parts = r.choice([[16], [15], [4, 4, 4, 4], [4, 6, 5], [13], [19]])
        sep = r.choice([" ", "-"])
        return sep.join(digits(n) for n in parts).split(" ")

    def spelled_email():
        at, dot = r.choice([("at", "dot"), ("[at]", "[dot]"), ("(at)", "(dot)")])
        return [name(), at, *f" {dot} ".join(name() for _ in range(r.randint(2, 3))).split()]

    def spelled_phone():
        return r.choices(NUMBERS[:10], k=r.randint(9, 12)) if r.random() < 0.5 else [digits(1) for _ in range(r.randint(9, 12))]

    def spelled_ip():
        return r.choice(["[.]", " . ", "(.)", " dot "]).join(str(r.randint(1, 255)) for _ in range(4)).split()

    def loose():
        return r.choice([["at"], ["dot"], [r.choice(NUMBERS)], [r.choice(NUMBERS), r.choice(NUMBERS)], [name(), "at", name()], [digits(1), digits(1)], ["."]])

    def phone():
        shape = r.choice(["+1 (ddd) 555-dddd", "(ddd) ddd-dddd", "+dd ddd ddddddd", "+d ddd-ddd-dddd", "ddd-ddd-dddd", "+dd.ddd.ddd.dddd"])
        return "".join(digits(1) if c == "d" else c for c in shape).split(" ")

    def number():
        some = [
            digits(r.randint(1, 6)),
            f"{digits(1)},{digits(3)}",
            f"${digits(2)}.{digits(2)}",
            f"{digits(1)}.{digits(1)}",
            f"{digits(1)}.{digits(1)}.{digits(1)}",
            f"20{digits(2)}-{digits(2)}-{digits(2)}",
            f"{digits(2)}:{digits(2)}",
            f"{name()}{digits(2)}",
            f"{digits(2)}%",
            f"#{digits(3)}",
            f"({digits(1)})",
            f"+{digits(1)}",
            f"@{name()}",
            f"{digits(20)}{name()}",
            f"{digits(4)}-{digits(4)}",
            f"{name()}={digits(6)}{name()}{digits(4)}",
        ]
        return [r.choice(some)]

    items = [("email", email), ("ip", ip), ("card", card), ("phone", phone)]
    spelled = [("email", spelled_email), ("phone", spelled_phone), ("ip", spelled_ip)]
    makers = [*items, *spelled, ("none", loose), ("none", loose), ("none", number), ("none", number), ("none", number)]
    out = []
    for _ in range(sentences):
        row = prose(r.randint(1, 5))
        for _ in range(r.randint(0, 2)):
            kind, make = r.choice(makers)
            got = make()
            got[-1] += r.choice(["", "", "", ".", ","])
            row += [(w, kind) for w in got] + prose(r.randint(1, 4))
        out.append(row)
    return out


# --- features -----------------------------------------------------------------

_CLASS = np.full(256, 9, np.uint8)
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
for _k, _c in enumerate("@.-()+", 4):
    _CLASS[ord(_c)] = _k if _k < 9 else 10
_CLASS[words.SPACE] = 0
#: Words of a window, and those on either side of it that are decoded with it.
_WINDOW, _BESIDE = 48, 16


def _spelled() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words with shapes of their own, sorted, and those shapes."""
    known = {**dict.fromkeys(NUMBERS, 1), **{k: 2 if v == "@" else 3 for k, v in SIGNS.items()}}
    data, bounds = words.flat(pa.array([" ".join(known)]))
    h = words.hashes(data, *words.words(data, bounds))
    order = np.argsort(h)
    return h[order], np.array(list(known.values()), np.uint64)[order]


_SPELLED, _SPELLED_AS = _spelled()


class Words:
    """Words of a batch: byte spans, shapes, lengths, digits, and whether they can start a chain."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        kind = _CLASS[data]
        self.starts, self.ends = words.runs((kind != 0).view(np.uint8), bounds)
        change = np.ones(len(data), bool)
        change[1:] = kind[1:] != kind[:-1]
        change[self.starts] = True
        change &= kind != 0
        runs = kind[change]
        before = np.concatenate([[0], np.cumsum(change)])
        self.shape = words.hashes(runs, before[self.starts], before[self.ends])
        count = lambda mask: (lambda c: c[self.ends] - c[self.starts])(np.concatenate([[0], np.cumsum(mask)]))
        self.digits = count(kind == 3)
        self.length = self.ends - self.starts
        own = words.hashes(data, self.starts, self.ends)
        at = np.minimum(np.searchsorted(_SPELLED, own), len(_SPELLED) - 1)
        spelled = _SPELLED[at] == own
        self.shape[spelled] = _SPELLED_AS[at[spelled]]
        self.sign = (self.digits + count((kind == 4) | (kind == 10))) > 0
        self.doc = np.searchsorted(bounds, self.starts, "right") - 1


def windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of a text's words the first and last (exclusive) that are decoded, and those whose labels count."""
    n = len(w.starts)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    begin = np.flatnonzero(np.append(True, w.doc[1:] != w.doc[:-1]))
    end = np.append(begin[1:], n)
    each = -(-(end - begin) // _WINDOW)
    nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    begin, end = np.repeat(begin, each), np.repeat(end, each)
    core = begin + nth * _WINDOW
    core_end = np.minimum(core + _WINDOW, end)
    return np.maximum(core - _BESIDE, begin), np.minimum(core_end + _BESIDE, end), core, core_end


class Field:
    """Weights over the shapes that training has seen; others have none."""

    def __init__(self, shapes: np.ndarray):
        self.shapes = np.sort(shapes)
        self.m = len(shapes) + 1
        self.n_labels = len(KINDS) + 1
        self.emit = np.zeros((3 * self.m + 50, self.n_labels))
        self.step = np.zeros((self.n_labels, self.n_labels))
        self.edge = np.zeros((2, self.n_labels))

    def index(self, w: Words) -> np.ndarray:
        """Rows of emit for each word: its shape, those before and after, length and digits."""
        at = np.minimum(np.searchsorted(self.shapes, w.shape), self.m - 2)
        known = np.where(self.shapes[at] == w.shape, at + 1, 0)
        same = w.doc[1:] == w.doc[:-1]
        before, after = np.zeros_like(known), np.zeros_like(known)
        before[1:] = np.where(same, known[:-1], 0)
        after[:-1] = np.where(same, known[1:], 0)
        return np.stack([known, self.m + before, 2 * self.m + after, 3 * self.m + np.minimum(w.length, 24), 3 * self.m + 25 + np.minimum(w.digits, 24)], 1)

    def train(self, index: np.ndarray, y: np.ndarray, first: np.ndarray, last: np.ndarray, rounds: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> None:
        """Adam on the negative log-likelihood of chains, all of them in each round."""
        n, longest = len(first), int((last - first).max())
        pos = first[:, None] + np.arange(longest)
        real = pos < last[:, None]
        pos = np.where(real, pos, 0)
        idx, gold, size = index[pos], y[pos], last - first
        one = np.eye(self.n_labels)[gold] * real[..., None]
        params = [self.emit, self.step, self.edge]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        soft = lambda x, axis: (lambda top: np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis))(x.max(axis, keepdims=True))
        for r in range(1, rounds + 1):
            s = self.emit[idx].sum(2)
            a, b = np.zeros((longest, n, self.n_labels)), np.zeros((longest, n, self.n_labels))
            a[0] = s[:, 0] + self.edge[0]
            for t in range(1, longest):
                a[t] = np.where(real[:, t, None], soft(a[t - 1][:, :, None] + self.step, 1) + s[:, t], a[t - 1])
            z = soft(a[longest - 1] + self.edge[1], 1)
            b[longest - 1] = self.edge[1]
            for t in range(longest - 2, -1, -1):
                b[t] = np.where(real[:, t + 1, None], soft(self.step + (s[:, t + 1] + b[t + 1])[:, None, :], 2), self.edge[1])
            p = np.exp(a.transpose(1, 0, 2) + b.transpose(1, 0, 2) - z[:, None, None]) * real[..., None]
            g = [np.zeros_like(x) for x in params]
            np.add.at(g[0], idx, np.broadcast_to((p - one)[:, :, None, :], (*idx.shape, self.n_labels)))
            for t in range(1, longest):
                joint = np.exp(a[t - 1][:, :, None] + self.step + (s[:, t] + b[t])[:, None, :] - z[:, None, None]) * real[:, t, None, None]
                g[1] += joint.sum(0) - one[:, t - 1].T @ one[:, t]
            ends = np.arange(n), size - 1
            g[2][0], g[2][1] = (p[:, 0] - one[:, 0]).sum(0), (p[ends] - one[ends]).sum(0)
            for k, x in enumerate(params):
                grad = g[k] / n + ridge * x
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                x -= rate * (m[k] / (1 - 0.9**r)) / (np.sqrt(v[k] / (1 - 0.999**r)) + 1e-8)

    def decode(self, w: Words, first: np.ndarray, last: np.ndarray, core: np.ndarray | None = None, core_end: np.ndarray | None = None, batch: int = 2048) -> np.ndarray:
        """The likeliest label of each word in the chains from first to last; of those from core to core_end, if given, they are kept."""
        core, core_end = (first, last) if core is None else (core, core_end)
        out = np.zeros(len(w.starts), np.int8)
        order = np.argsort(last - first, kind="stable")
        index = self.index(w)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            f, e, c, d = first[pick], last[pick], core[pick], core_end[pick]
            longest = int((e - f).max())
            back = np.zeros((longest, len(f), self.n_labels), np.int8)
            score = self.emit[index[f]].sum(1) + self.edge[0]
            for t in range(1, longest):
                live = f + t < e
                path = score[:, :, None] + self.step
                best = path.argmax(1)
                now = np.take_along_axis(path, best[:, None, :], 1)[:, 0] + self.emit[index[np.where(live, f + t, 0)]].sum(1)
                if live.all():
                    back[t], score = best, now
                else:
                    back[t] = np.where(live[:, None], best, np.arange(self.n_labels))
                    score = np.where(live[:, None], now, score)
            label = (score + self.edge[1]).argmax(1)
            row = np.arange(len(f))
            for t in range(longest - 1, -1, -1):
                kept = (f + t >= c) & (f + t < d)
                out[(f + t)[kept]] = label[kept]
                if t:
                    label = back[t][row, label]
        return out


def trained(table: list[list[tuple[str, str]]], rounds: int = 120) -> Field:
    w = Words(*words.flat(pa.array([" ".join(x for x, _ in row) for row in table])))
    y = np.array([(("none",) + KINDS).index(label) for row in table for _, label in row])
    field = Field(np.unique(w.shape))
    first = np.flatnonzero(np.append(True, w.doc[1:] != w.doc[:-1]))
    field.train(field.index(w), y, first, np.append(first[1:], len(w.starts)), rounds)
    return field


@functools.cache
def default_field() -> Field:
    return trained(labelled_table())


# --- spans --------------------------------------------------------------------

_TRIM = ".,;:!?\"'<>[]{}*$%&#|"


_NUMBER_WORD = re.compile(rf"(?i)\b({'|'.join(NUMBERS)})\b")
_SPELLED_EMAIL = re.compile(r"(?i)[a-z0-9._%+-]+\s?[\[( ]\s?at\s?[\]) ]\s?[a-z0-9-]+(\s?([\[( ]\s?dot\s?[\]) ]|\.)\s?[a-z0-9-]+)+")
_DOT = re.compile(r"(?i)\[\.\]|\(\.\)|\bdot\b|\.")


def digits_of(text: str) -> int:
    """Its digits, as such or as words."""
    n = sum(map(text.count, "0123456789"))
    return n if n == len(text) or text.lower() == text.upper() else n + len(_NUMBER_WORD.findall(text))


def plausible(kind: str, text: str) -> bool:
    n = digits_of(text)
    if kind == "email":
        return "@" in text[1:-1] or _SPELLED_EMAIL.fullmatch(text) is not None
    if kind == "ip":
        parts = [x.strip() for x in _DOT.split(text)]
        return len(parts) == 4 and n >= 4 and all(x.isascii() and x.isdigit() and int(x) <= 255 for x in parts if len(x) < 5) and all(len(x) < 5 for x in parts)
    return 13 <= n <= 19 if kind == "card" else 9 <= n <= 15


def items(kind: str, text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The plausible items that adjacent pieces of words of one label make up.

    Of emails each has one word with an @. Else they cover as many digits as can be;
    of the ways to do so, items have few line ends, + and ( inside, and are few. An item
    starts and ends at a digit's word, so each start is tried with few ends.
    """
    if kind == "email":
        parts: list[tuple[int, int]] = []
        whole, signed = False, False  # of the last part: has a complete address, has an @
        for a, b in pieces:
            at = "@" in text[a:b] or text[a:b].lower() in SIGNS and SIGNS[text[a:b].lower()] == "@"
            if not parts or (signed and (at and "@" in text[a:b] or whole)):
                parts.append((a, b))
                whole = signed = False
            parts[-1] = (parts[-1][0], b)
            signed, whole = signed or at, whole or plausible(kind, text[a:b])
        if len(parts) > 1 and not signed:
            parts[-2:] = [(parts[-2][0], parts[-1][1])]
        return [trimmed(text, a, b) for a, b in parts if plausible(kind, text[slice(*trimmed(text, a, b))])]
    n = len(pieces)
    most = {"ip": 12, "card": 19, "phone": 15}[kind]
    digits = [digits_of(text[a:b]) for a, b in pieces]
    opens = [text[a : a + 1] for a, _ in pieces]
    breaks = [0, *(any(c in "\r\n" for c in text[x[1] : y[0]]) for x, y in zip(pieces, pieces[1:]))]
    # Of the first i pieces: digits covered, what speaks against it, items, and the last item's first piece (or none).
    best: list[tuple[int, int, int]] = [(0, 0, 0)] + [(-1, 0, 0)] * n
    first = [-1] * (n + 1)
    for i in range(n):
        if best[i] > best[i + 1]:
            best[i + 1], first[i + 1] = best[i], -1
        if not digits[i]:
            continue
        got, against, start = 0, 0, i - 1 if i and not digits[i - 1] and opens[i - 1] in "+(" and first[i] < 0 and not breaks[i] else i
        for j in range(i, n):
            got += digits[j]
            if j > i:
                against += breaks[j] + 4 * (opens[j] == "+") + (opens[j] == "(" and opens[i] != "+")
            if j > i and got > most:
                break
            if digits[j]:
                a, b = trimmed(text, pieces[start][0], pieces[j][1])
                if plausible(kind, text[a:b]):
                    value = (best[i][0] + got, best[i][1] - against, best[i][2] - 1)
                    if value > best[j + 1]:
                        best[j + 1], first[j + 1] = value, start
    out, i = [], n
    while i > 0:
        if first[i] >= 0:
            out.append(trimmed(text, pieces[first[i]][0], pieces[i - 1][1]))
            i = first[i]
        else:
            i -= 1
    return out[::-1]


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and (text[b - 1] in _TRIM or text[b - 1].isspace()):
        b -= 1
    while a < b and (text[a] in _TRIM or text[a].isspace()):
        a += 1
    return a, b


def left_over(words_at: list[tuple[int, int]], base: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Stretches of adjacent words less the base spans, which are sorted and part them."""
    starts, out = [a for a, _ in base], []
    reach = list(itertools.accumulate((b for _, b in base), max))
    for a, b in words_at:
        k = bisect.bisect_left(reach, a + 1)  # the first base span that can end in or after the word
        while k < len(base) and starts[k] < b:
            if a < starts[k]:
                out.append((a, starts[k]))
            if out:
                yield out
                out = []
            a = max(a, base[k][1])
            k += 1
        if a < b:
            out.append((a, b))
    if out:
        yield out


def spans_of(column: pa.Array, field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Of each text its base spans and those that the field adds; places in code points, ends exclusive."""
    data, bounds = words.flat(column)
    w = Words(data, bounds)
    label = field.decode(w, *windows(w))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    texts = column.to_pylist()
    signs = np.zeros(len(column), bool)
    signs[w.doc[w.sign]] = True  # all that a pattern finds has a digit, an @ or a +
    out: list[tuple[list[Span], list[Span]]] = [([], []) for _ in texts]
    for d in np.flatnonzero(signs).tolist():
        out[d] = (patterns(texts[d]), [])
    hit = np.flatnonzero(label)
    covered: dict[int, list[tuple[int, int]]] = {}
    if len(hit):
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) != 1) | (label[hit][1:] != label[hit][:-1]) | (w.doc[hit][1:] != w.doc[hit][:-1])
        edges = np.flatnonzero(np.append(new, True))
        for i, j in zip(edges[:-1], edges[1:]):
            d = int(w.doc[hit[i]])
            base = points[bounds[d]]
            at = hit[i:j]
            kind = KINDS[label[at[0]] - 1]
            places = list(zip((points[w.starts[at]] - base).tolist(), (points[w.ends[at]] - base).tolist()))
            if d not in covered:
                covered[d] = sorted((x, y) for _, x, y in out[d][0])
            for pieces in left_over(places, covered[d]):
                out[d][1].extend((kind, x, y) for x, y in items(kind, texts[d], pieces))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id; n_email, n_ip, n_card, n_phone and base_sha256 of the base spans; spans, all of them; n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = spans_of(batch.column("text"), shared.value)
            count = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found])
            spans = pa.array([joined(base + more) for base, more in found], pa.string())
            added = pa.array([len(more) for _, more in found], pa.int64())
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *count, digest, spans, added], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(of, schema)


def masked(text: str, spans: list[Span]) -> str:
    """Each stretch of overlapping spans becomes the first one's kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with all spans of text masked; n_chars, if there, is that of the new text. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            column = batch.column("text")
            texts = column.to_pylist()
            for i, (base, more) in enumerate(spans_of(column, shared.value)):
                if base or more:
                    texts[i] = masked(texts[i], base + more)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, column.type))

    out = docs.mapInArrow(of, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
