"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule's cost and selectivity are measured on a sample, in one job; then the rules are
asked in the order of rejections per cost, and a text that one rejects meets no further
one: CASE evaluates its branches one after the other, and a rule computes what it needs
only when it is asked. The order changes the time, never the verdict. Selectivity is that
among texts which the base rule leaves; a rule's cost is the median of its times over
the sample's texts, by the clock around it within the row. The sample is the first rows
of a few files, or of a few partitions, so it costs the same at any size.

Everything is computed within a row: no shuffle, no join, and long or hot rows stay
where the scan puts them. Words that repeat are found by sorting, in a row, packed
hashes of its 3-word windows; equal hashes are then compared as words, so results
are exact. A very long text needs about 100 bytes a word for a moment, in one task.

Defined results: a null or empty text has no words, so it fails the base rule; a text
that several rules reject is rejected by the first in their order, and kept the same in
any order; rows that repeat get a row each; null doc_ids are kept; columns of the input
stay, whatever their names, but for those named like a result, which are replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import flattened, nested


class Rule(NamedTuple):
    """A name, and SQL over the metrics, _text, _w (its words) and _lines that is true for texts to reject."""

    name: str
    rejects: str


#: Frequent words of English, German, French and Spanish.
STOP_WORDS = ("the", "of", "and", "to", "in", "that", "with", "der", "die", "und", "von", "zu", "das", "den", "de", "la", "le", "et", "les", "des", "en", "que", "el", "los", "y", "un")


_SPACE = r"[ \\t-\\r]"


def let(name: str, value: str, body: str) -> str:
    """SQL that evaluates value once, whatever the optimizer does to the columns around it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


#: How often the most frequent pair of neighbouring words is there: the longest run of sorted pairs.
_TOP_PAIR = (
    "aggregate(sort_array(transform(slice(_w, 1, greatest(size(_w) - 1, 0)), (x, i) -> concat(x, ' ', get(_w, i + 1)))),"
    " named_struct('last', '', 'n', 0, 'most', 0), (a, x) -> named_struct('last', x, 'n', if(x = a.last, a.n + 1, 1), 'most', greatest(a.most, if(x = a.last, a.n + 1, 1))), a -> a.most)"
)

RULES = (
    Rule("many symbols", "10 * n_symbols > n_words"),
    Rule("lines repeat", "2 * n_dup_lines > n_lines"),
    Rule("words too short or long", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("few letters", r"2 * length(regexp_replace(_text, '\\P{L}+', '')) < word_chars"),
    Rule("mostly capitals", r"2 * length(regexp_replace(_text, '\\P{Lu}+', '')) > word_chars"),
    Rule("no stop words", f"size(array_intersect(transform(_w, x -> lower(x)), array({', '.join(repr(w) for w in STOP_WORDS)}))) < 2"),
    Rule("one pair of words prevails", f"10 * {_TOP_PAIR} > n_words"),
    Rule("few different words", "5 * size(array_distinct(_w)) < n_words"),
    Rule("lines end in dots", r"10 * size(filter(_lines, x -> x RLIKE '([.][.][.]|\u2026)[ \\t-\\r]*$')) > 3 * n_lines"),
    Rule("lines are bullets", r"10 * size(filter(_lines, x -> x RLIKE '^[ \\t-\\r]*[-*\u2022]')) > 9 * n_lines"),
)

#: Of _w: hashes of windows packed with their places and sorted; the places of equal hashes; of those, the equal windows.
_REPEATS = let(
    "w",
    "_w",
    let(
        "bits",
        "cast(ceil(log2(size(w) + 2)) AS int)",
        let(
            "p",
            "sort_array(transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> shiftleft(xxhash64(x, get(w, i + 1), get(w, i + 2)), bits) | cast(i AS bigint)))",
            let(
                "k",
                "sort_array(transform(filter(p, (x, i) -> coalesce(shiftright(x, bits) = shiftright(get(p, i + 1), bits), false) OR coalesce(shiftright(x, bits) = shiftright(get(p, i - 1), bits), false)),"
                " x -> named_struct('k', concat_ws(' ', slice(w, cast(x & (shiftleft(1L, bits) - 1) AS int) + 1, 3)), 'i', cast(x & (shiftleft(1L, bits) - 1) AS int))))",
                "aggregate(sort_array(transform(filter(k, (x, i) -> coalesce(x.k = get(k, i + 1).k, false) OR coalesce(x.k = get(k, i - 1).k, false)), x -> x.i)),"
                " named_struct('n', 0L, 'last', -3), (a, x) -> named_struct('n', a.n + cast(least(3, x - a.last) AS bigint), 'last', x), a -> a.n)",
            ),
        ),
    ),
)


METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def metrics(docs: DataFrame) -> DataFrame:
    """row, a struct of the columns of docs, _text, _w, _lines, and METRICS."""
    out = nested(docs).withColumn("_text", F.expr("coalesce(cast(row.text AS string), '')"))
    out = out.withColumns(
        {
            "_w": F.expr(r"array_remove(split(regexp_replace(_text, '[\\t-\\r]', ' '), ' '), '')"),
            "_lines": F.expr(rf"filter(split(_text, '\\n'), x -> x RLIKE '[^ \\t-\\r]')"),
            "word_chars": F.expr(rf"cast(length(regexp_replace(_text, '{_SPACE}+', '')) AS bigint)"),
            "n_symbols": F.expr("cast(regexp_count(_text, '[#*$%&|<>]') AS bigint)"),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.expr("cast(size(_w) AS bigint)"),
            "n_lines": F.expr("cast(size(_lines) AS bigint)"),
            "n_dup_lines": F.expr("cast(size(_lines) - size(array_distinct(_lines)) AS bigint)"),
        }
    )
    return out.withColumn("n_repeat_words", F.expr(_REPEATS)).select("row", "_text", "_w", "_lines", *METRICS)


BASE = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def sampled(docs: DataFrame, rows: int, files: int = 8) -> DataFrame:
    """The first rows of a few files spread over docs, or where docs isn't read from files, of its first partitions."""
    names = docs.inputFiles()
    if len(names) > files:
        place = docs.metadataColumn("_metadata")["file_path"]
        picked = docs.where(place.isin(*names[:: -(-len(names) // files)])).limit(rows)
        if picked.limit(1).count():
            return picked
    return docs.limit(rows)


_NOW = "cast(java_method('java.lang.System', 'nanoTime') AS bigint)"


def measured(sample: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, float]]:
    """Of each rule how many texts of a sample (see metrics) it rejects, and the nanoseconds that it takes, by one job.

    The clock is read before a rule and behind it, within the row, whose branches CASE takes in turn.
    """
    timed = [let("began", _NOW, f"CASE WHEN {r.rejects} THEN named_struct('hit', 1, 'ns', {_NOW} - began) ELSE named_struct('hit', 0, 'ns', {_NOW} - began) END") for r in rules]
    rows = sample.select(*[F.expr(t).alias(f"r{i}") for i, t in enumerate(timed)])
    of = [x for i in range(len(rules)) for x in (F.coalesce(F.sum(f"r{i}.hit"), F.lit(0)), F.percentile_approx(f"r{i}.ns", 0.5))]
    found = rows.agg(*of).first()
    return [(int(found[2 * i]), float(found[2 * i + 1] or 0)) for i in range(len(rules))]


def order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 400) -> list[Rule]:
    """The rules by rejections per cost on a sample; only the sample's texts are measured."""
    found = measured(metrics(sampled(docs, sample_rows)).where(f"NOT {BASE}"), rules)
    return [rule for rule, (n, ns) in sorted(zip(rules, found, strict=True), key=lambda x: -(x[1][0] + 0.5) / max(x[1][1], 1.0))]


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 400) -> DataFrame:
    """The columns of docs, the metrics, base_failed, rejected_by (null if kept) and kept."""
    out = metrics(docs).withColumn("base_failed", F.expr(BASE))
    cascade = "CASE WHEN base_failed THEN 'base'"
    for rule in order(docs.select("text"), rules, sample_rows):
        cascade += f" WHEN {rule.rejects} THEN '{rule.name}'"
    out = out.withColumn("rejected_by", F.expr(cascade + " END")).withColumn("kept", F.col("rejected_by").isNull())
    return flattened(out, *METRICS, "base_failed", "rejected_by", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
k AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM m)),
twice AS (SELECT r, i FROM k QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
top AS (SELECT r, max(c) AS most FROM (SELECT r, w[i] || ' ' || w[i + 1] AS p, count(*) AS c FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM m) GROUP BY ALL) GROUP BY r),
b AS (
  SELECT doc_id, t, w, lines, coalesce(most, 0) AS most, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines FROM m LEFT JOIN covered USING (r) LEFT JOIN top USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 2 * length(regexp_replace(t, '\P{L}+', '', 'g')) < word_chars
    OR 2 * length(regexp_replace(t, '\P{Lu}+', '', 'g')) > word_chars
    OR len(list_filter(STOPS, lambda x: list_contains(list_transform(w, lambda y: lower(y)), x))) < 2
    OR 10 * most > n_words OR 5 * len(list_distinct(w)) < n_words
    OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[ \x09-\x0D]*$'))) > 3 * n_lines
    OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[ \x09-\x0D]*[-*\x{2022}]'))) > 9 * n_lines) AS kept
FROM b
""".replace("STOPS", str(list(STOP_WORDS)))
