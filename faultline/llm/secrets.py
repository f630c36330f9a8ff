"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 12 or more letters, digits and +/_-; a word has as many as it
has such runs, numbered from 0, and none overlaps another. The forest scores every one.
It looks at its length and shares of characters; at character transitions: changes
between letters and digits, of case, runs of consonants, and pairs of letters that words
don't have; at how much of it a dictionary covers, the commonest words of a text table
and a list of fragments; at paths; and at what stands before it: the neighbouring words,
and in its word the run and the characters before it. It is trained on labelled
findings, a small table, and then written as one SQL expression, so a scan is a
projection of one row and an explode of its candidates: DataFrame functions only. Training
evaluates the same SQL on the labelled findings and grows the trees on the driver. The
dictionary is counted over all words of the table, with partial sums before the shuffle;
its ``most`` words are all that reaches the driver.

Defined results: candidates of words with a digit are rows whatever their score, those
of words without one (most long words of prose) are rows where they are secrets; null
and empty texts have no findings, so no rows; a very long text is cut into words whole,
in its row; a finding that repeats is a row each time; equally common words are taken by
their spelling; null doc_ids are kept; further columns are ignored whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import random
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.quality_rules import let

#: Fragments of ordinary words and names.
DICTIONARY = ("password", "secret", "version", "example", "python", "package", "image", "index", "test", "data", "file", "user", "name", "order", "site", "lib", "html", "http", "www", "com", "tion", "ing", "the", "and", "ment", "ness", "able", "ist", "ung", "sch", "ion", "ent", "ter", "pro", "con", "est", "ver", "port", "line", "mail", "ado", "que", "eau")

_RUN = "[A-Za-z0-9+/_-]{12,}"
_MARKED = "pass|pwd|secret|token|api.?key|auth|credential|private"
_OTHER = "commit|sha|md5|hash|checksum|digest|integrity|base64|image/|uuid|guid|http|isbn|order|invoice|serial|version"

#: Of a candidate c: what its word has before it (pre) and on both sides (around); by_* tell of the neighbouring words.
FEATURES = {
    "length": "length(c)",
    "digits": "length(regexp_replace(c, '[^0-9]+', '')) / greatest(length(c), 1)",
    "capitals": "length(regexp_replace(c, '[^A-Z]+', '')) / greatest(length(c), 1)",
    "transitions": "length(regexp_replace(regexp_replace(regexp_replace(c, '[0-9]+', '0'), '[a-z]+', 'a'), '[A-Z]+', 'A')) / greatest(length(c), 1)",
    "mixed": "regexp_count(c, '[A-Za-z][0-9]|[0-9][A-Za-z]') / greatest(length(c), 1)",
    "flips": "regexp_count(c, '[a-z][A-Z][A-Z]|[A-Z][a-z][A-Z]|[A-Z][A-Z][a-z][A-Z]') / greatest(length(c), 1)",
    "consonants": "length(regexp_replace(regexp_replace(lower(c), '[bcdfghjklmnpqrstvwxz]{4,}', '    '), '[^ ]+', '')) / greatest(length(c), 1)",
    "odd_pairs": "regexp_count(lower(c), 'q[^u]|[jqvxz][jqvxz]|[bcdfghjklmnpqrstvwxz][jqx]|[jx][bcdfghklmnpqrstvw]') / greatest(length(c), 1)",
    "vowels": "length(regexp_replace(lower(c), '[^aeiou]+', '')) / greatest(length(c), 1)",
    "hex": "CASE WHEN c RLIKE '^[0-9a-f]+$' THEN 1 ELSE 0 END",
    "dictionary": f"1 - length(regexp_replace(lower(c), '{'|'.join(DICTIONARY)}', '')) / greatest(length(c), 1)",
    "known": "aggregate(split(lower(regexp_replace(c, '([a-z])([A-Z])', '$1 $2')), '[^a-z]+'), 0, (a, x) -> a + CASE WHEN x IN ({words}) THEN length(x) ELSE 0 END) / greatest(length(c), 1)",
    "path": "length(regexp_replace(around, '[^/.]+', ''))",
    "rooted": "CASE WHEN around RLIKE '^[^A-Za-z0-9]*(~|[.]{0,2}/|[A-Za-z]:|(https?|ftp|file|s3):)?/[A-Za-z.]' THEN 1 ELSE 0 END",
    "file": "CASE WHEN around RLIKE '[.](js|py|java|c|h|go|rs|html?|css|json|xml|ya?ml|md|txt|jar|png|jpe?g|gif|svg|zip|gz|so|dll|exe)[^A-Za-z0-9]*$' THEN 1 ELSE 0 END",
    "dashes": "length(regexp_replace(c, '[^-]+', ''))",
    "uuid": "CASE WHEN c RLIKE '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$' THEN 1 ELSE 0 END",
    "marked": f"CASE WHEN by_marked OR pre RLIKE '{_MARKED}' THEN 1 ELSE 0 END",
    "assigned": "CASE WHEN by_assigned OR pre RLIKE '[=:]' THEN 1 ELSE 0 END",
    "other": f"CASE WHEN by_other OR pre RLIKE '{_OTHER}' THEN 1 ELSE 0 END",
    "issued": "CASE WHEN c RLIKE '^(AKIA|ASIA|gh[pousr]_|sk_live_|xox[abp]-|AIza|glpat-|npm_|eyJ[A-Za-z0-9])' THEN 1 ELSE 0 END",
}


#: Names that labelled secrets are assigned to; never secrets themselves.
KEYS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "auth_token", "client_secret")


def labelled_findings(n: int = 1500, seed: int = 31, known: tuple[str, ...] = ()) -> list[tuple[str, str, str, str, bool]]:
    """(two words before, the word before, the word, the word after, is a secret)."""
    r = random.Random(seed)
    some = lambda letters, k: "".join(r.choices(letters, k=k))
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    every = low + up + dig
    word = lambda: some(low, r.randint(2, 9))
    common = known or DICTIONARY
    fragment = lambda: r.choice(common if r.random() < 0.5 else DICTIONARY)
    secret = lambda: r.choice([some(hexa, r.choice([16, 18, 20, 32, 40, 64])), some(every, r.randint(16, 44)), some(every + "+/", r.choice([24, 32, 40]))])
    key = lambda: r.choice(KEYS)
    good = [
        lambda: (word(), word(), "AKIA" + some(up + "234567", 16)),
        lambda: (word(), word(), r.choice(["ghp_", "gho_"]) + some(every, 36)),
        lambda: (word(), word(), "sk_live_" + some(every, 24)),
        lambda: (word(), word(), f"{key()}={secret()}"),
        lambda: (word(), f"{key()}:", f'"{secret()}"'),
        lambda: (key(), "=", f'"{secret()}"'),
        lambda: (key(), r.choice(["=", "is", ":"]), secret()),
        lambda: (word(), word(), f"{r.choice(['postgres', 'mysql', 'amqp'])}://{word()}:{secret().replace('/', 'x')}@{word()}.com/{word()}"),
        lambda: (word(), word(), f'{{"{key()}":"{secret()}"}}'),
        lambda: (r.choice(["Authorization:", "bearer", word()]), "Bearer", "eyJ" + some(every, 33)),
    ]
    bad = [
        lambda: (word(), '"integrity":', f'"sha512-{some(every + "+/", 86)}=="'),
        lambda: (word(), word(), f"data:image/png;base64,iVBORw0KGgo{some(every + '+/', 60)}"),
        lambda: (word(), word(), f"{fragment()}/{fragment()}/{fragment().capitalize()}{fragment().capitalize()}{some(dig, 1)}.{r.choice(['js', 'py', 'java'])}"),
        lambda: (word(), word(), f"{fragment()}-{fragment()}-{some(dig, 1)}.{some(dig, 1)}.{some(dig, 2)}.jar"),
        lambda: (word(), word(), fragment().upper() + "_" + fragment().upper() + "_" + some(dig, 2)),
        lambda: (word(), r.choice(["commit", "sha1", "md5:", "checksum", "digest"]), some(hexa, r.choice([32, 40, 64]))),
        lambda: (word(), word(), some(hexa, r.choice([32, 40]))),
        lambda: (word(), r.choice(["uuid", "id", word()]), "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: (word(), word(), some(dig, r.randint(12, 19))),
        lambda: (word(), word(), "/".join(["https:/", word() + ".com", word() + some(dig, 2), word() + some(dig, 3)])),
        lambda: (word(), word(), "/usr/" + "/".join(fragment() + some(dig, r.randint(0, 2)) for _ in range(4))),
        lambda: (word(), word(), "".join(fragment() for _ in range(4)) + some(dig, 2)),
        lambda: (word(), r.choice(["order", "invoice", word()]), f"{fragment()}-20{some(dig, 2)}-{some(dig, 2)}-{some(dig, 4)}"),
        lambda: (word(), word(), "".join(word().capitalize() for _ in range(4)) + some(dig, 1)),
        lambda: ("your", key(), "_".join(fragment() for _ in range(4)) + "1"),
        lambda: (word(), word(), f"{word()}.{some(dig, 2)}@{word()}{some(dig, 1)}-{word()}{word()}.com"),
        lambda: (word(), word(), "-".join(some(dig, 4) for _ in range(4))),
    ]
    out = []
    for _ in range(n):
        is_secret = r.random() < 0.45
        out.append((*r.choice(good if is_secret else bad)(), word(), is_secret))
    return out


#: Syllables of European words, also those that join consonants.
CLUSTERS = (
    "th he an er en es on at ou ei ie re st sh nd le ai as os de te ra heit keit para wh ti ou be ach und icht lich ein die pf"
    " tz ck sch schl schr schw str spr ll rr ss tt ff zz ng nk nt ld rt rst chts tzt pft ngs ghts rld gth mpf ndsch zu zer zw kn kr kl fl gl br cht"
).split()


def labelled_letters(n: int = 1500, seed: int = 41) -> list[tuple[str, str, str, str, bool]]:
    """As labelled_findings, of words without a digit."""
    r = random.Random(seed)
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    some = lambda letters, k: "".join(r.choices(letters, k=k))
    word = lambda: some(low, r.randint(2, 9))
    near = lambda: r.choice([word(), word(), word(), *KEYS[:5], "token:", "="])
    syllable = lambda: r.choice([*DICTIONARY, *CLUSTERS])
    long = lambda: (lambda s: s if len(s) > 11 else s + syllable() + "tion" + syllable() + "ation")("".join(syllable() for _ in range(r.randint(4, 8))))
    ended = lambda s: s + r.choice(["", "", "", ".", ",", ")", '"'])
    secret = lambda: some(low + up, r.randint(16, 44))
    good = [
        lambda: (word(), word(), "AKIA" + some(up, 16)),
        lambda: (word(), word(), r.choice(["ghp_", "gho_"]) + some(low + up, 36)),
        lambda: (word(), word(), "sk_live_" + some(low + up, 24)),
        lambda: (word(), word(), f"{r.choice(KEYS)}={secret()}"),
        lambda: (word(), word(), f"{r.choice(KEYS)}={some(low, r.randint(16, 32))}"),
        lambda: (word(), f"{r.choice(KEYS)}:", f'"{secret()}"'),
        lambda: (r.choice(KEYS), r.choice(["=", "is", ":"]), secret()),
    ]
    bad = [
        lambda: (near(), near(), ended(long())),
        lambda: (near(), near(), ended(long().capitalize())),
        *[lambda: (near(), near(), ended(long().upper()))] * 4,
        lambda: (near(), near(), ended("".join(syllable().capitalize() + syllable() for _ in range(4)))),
        lambda: (near(), near(), ended(r.choice(["_", "-"]).join(long()[:7] for _ in range(3)))),
        lambda: (near(), near(), "_".join(long()[:7].upper() for _ in range(3))),
        lambda: (near(), near(), "/".join(["https:/", word() + ".com", word(), long()])),
        lambda: (near(), near(), "/usr/" + "/".join(syllable() for _ in range(5))),
        lambda: (near(), near(), f"{word()}={long()}"),
        lambda: (near(), near(), r.choice(["client_secret", "client_secret:", "client_secret="])),
        lambda: (near(), near(), r.choice("-=_") * r.randint(12, 80)),
    ]
    out = []
    for _ in range(n):
        is_secret = r.random() < 0.3
        out.append((*r.choice(good if is_secret else bad)(), word(), is_secret))
    return out


class Tree(NamedTuple):
    """A split with its two sides, or a share of secrets."""

    feature: str | None
    at: float
    low: Tree | None
    high: Tree | None

    def sql(self) -> str:
        return f"{self.at!r}D" if self.feature is None else f"CASE WHEN f_{self.feature} <= {self.at!r}D THEN {self.low.sql()} ELSE {self.high.sql()} END"


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int = 4) -> Tree:
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return Tree(None, round(share, 6), None, None)
    best = (np.inf, -1, 0.0)
    for k in rng.choice(x.shape[1], max(2, int(np.sqrt(x.shape[1])) + 1), replace=False).tolist():
        order = np.argsort(x[:, k], kind="stable")
        v, hits = x[order, k], np.cumsum(y[order])
        n = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
        if ok.any():
            a, b = hits[:-1] / n, (hits[-1] - hits[:-1]) / (len(y) - n)
            impurity = np.where(ok, n * a * (1 - a) + (len(y) - n) * b * (1 - b), np.inf)
            i = int(impurity.argmin())
            if impurity[i] < best[0]:
                best = (float(impurity[i]), k, round(float(v[i] + v[i + 1]) / 2, 6))
    if best[1] < 0:
        return Tree(None, round(share, 6), None, None)
    low = x[:, best[1]] <= best[2]
    if low.all() or not low.any():
        return Tree(None, round(share, 6), None, None)
    return Tree(list(FEATURES)[best[1]], best[2], grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1))


def _candidates(p2: str, p1: str, word: str, n1: str) -> str:
    """SQL: of a word and those beside it, an array of its candidates. In all as long as the words, however many there are."""
    each = (
        "transform(runs, (c, k) -> named_struct('run_no', k, 'c', c, 'around', concat(get(gaps, k), c, get(gaps, k + 1)),"
        f" 'pre', lower(concat(CASE WHEN k = 0 THEN concat(right({p1}, 4), ' ') ELSE get(runs, k - 1) END, get(gaps, k))),"
        " 'by_marked', beside.m, 'by_assigned', beside.a, 'by_other', beside.o, 'listed', beside.l))"
    )
    beside = f"named_struct('m', before RLIKE '{_MARKED}', 'a', before RLIKE '[=:]', 'o', before RLIKE '{_OTHER}' OR lower({n1}) RLIKE '{_OTHER}', 'l', {word} RLIKE '[0-9]')"
    return let("runs", f"regexp_extract_all({word}, '{_RUN}', 0)", let("gaps", f"split({word}, '{_RUN}')", let("before", f"lower(concat_ws(' ', {p2}, {p1}))", let("beside", beside, each))))


def dictionary(table: DataFrame, most: int = 2000) -> tuple[str, ...]:
    """The commonest words of 4 to 16 letters a to z, in any case, of all texts of a table (text)."""
    words = F.split(F.lower(F.col("text").cast("string")), "[^a-z]+")
    found = table.select(F.explode(words).alias("w")).where("length(w) BETWEEN 4 AND 16").groupBy("w").agg(F.count("*").alias("n"))
    return tuple(r["w"] for r in found.orderBy(F.desc("n"), "w").limit(most).collect())  # most rows at the most


def _with_features(found: DataFrame, known: tuple[str, ...]) -> DataFrame:
    words = ", ".join(f"'{w}'" for w in (*known, *DICTIONARY))
    return found.withColumns({f"f_{k}": F.expr(f"cast({v.replace('{words}', words)} AS double)") for k, v in FEATURES.items()})


def forest(spark: SparkSession, findings: list[tuple[str, str, str, str, bool]], known: tuple[str, ...] = (), trees: int = 21, depth: int = 7, seed: int = 37) -> list[Tree]:
    """Grown from findings and labelled_letters(). Of a labelled word every run has its label, but KEYS and words of the dictionary are none."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(w)}, {quoted(n)}, {str(y).lower()})" for a, b, w, n, y in findings + labelled_letters())
    found = spark.sql(f"SELECT * FROM VALUES {values} AS t(p2, p1, word, n1, y)").select("y", F.explode(F.expr(_candidates("p2", "p1", "word", "n1"))).alias("x")).select("y", "x.*")
    rows = _with_features(found.withColumn("y", F.col("y") & ~F.col("c").isin(*KEYS)), known).select(*[f"f_{k}" for k in FEATURES], "y").collect()
    x, y = np.array([r[:-1] for r in rows], float), np.array([r[-1] for r in rows], float)
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        pick = rng.integers(len(y), size=len(y))
        out.append(grow(x[pick], y[pick], rng, depth))
    return out


#: Of _w, the candidates of all words.
_FOUND = let(
    "w",
    "_w",
    f"flatten(transform(filter(sequence(0, size(w)), i -> get(w, i) RLIKE '{_RUN}'),"
    f" i -> transform({_candidates("coalesce(get(w, i - 2), '')", "coalesce(get(w, i - 1), '')", "get(w, i)", "coalesce(get(w, i + 1), '')")},"
    " x -> named_struct('word_no', i, 'x', x))))",
)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, word_no and the fields of _candidates; those listed are rows whatever their score."""
    out = docs.select("doc_id", F.col("text").cast("string").alias("_text"))
    out = out.withColumn("_w", F.expr(r"array_remove(split(regexp_replace(_text, '[\\t-\\r]', ' '), ' '), '')"))
    return out.select("doc_id", F.explode(F.expr(_FOUND)).alias("f")).select("doc_id", "f.word_no", "f.x.*")


def scan(docs: DataFrame, trees: list[Tree] | None = None, threshold: float = 0.5, known: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, word_no and run_no (from 0), candidate, score and is_secret of each candidate listed.

    known: the dictionary, by default that of docs; trees, if given, are those grown with it.
    """
    known = dictionary(docs) if known is None else known
    trees = trees or forest(docs.sparkSession, labelled_findings(known=known), known)
    score = f"({' + '.join(t.sql() for t in trees)}) / {len(trees)}"
    out = _with_features(candidates(docs), known).withColumn("score", F.expr(score))
    # Always listed; not deterministic to the optimizer, which else moves the condition below the features and repeats them in it.
    listed = F.col("listed") | (F.spark_partition_id() < 0)
    out = out.select("doc_id", "word_no", "run_no", F.col("c").alias("candidate"), "score", (F.col("score") >= threshold).alias("is_secret"), listed.alias("listed"))
    return out.where("listed OR is_secret").drop("listed")
