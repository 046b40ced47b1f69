"""Quality rules whose cutoffs are certified on labelled holdouts by exact binomial bounds. DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, materialize, table

#: Strata whose cutoffs are broadcast at most; more are joined by a shuffle.
STRATA = 10_000

_SHARES = [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
_RATES = [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5, 2.0]
#: Rule: (numerator, denominator, cutoffs). A document fails a rule if the ratio is over the stratum's cutoff.
RULES: dict[str, tuple[str, str, list[float]]] = {
    "symbols": ("n_symbols", "n_words", _RATES),
    "exclamations": ("n_exclamations", "n_words", _RATES),
    "capitals": ("n_capitals", "word_chars", _SHARES),
    "dup_lines": ("n_dup_lines", "n_lines", _SHARES),
    "repeats": ("n_repeat_words", "n_words", _SHARES[2:9]),
    "word_length": ("word_chars", "n_words", [5.5, 6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0]),
}


def repeat_words(words: Column) -> Column:
    """Words in windows of three words that occur twice or more in the array, the first occurrence included.

    Windows are compared by 64-bit hashes. Where two are alike, structs of hash and place are sorted, so that equal
    windows lie side by side; the places of those are sorted again and their cover summed."""

    def of_hashes(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) >= 3, let(windows, of_windows)).otherwise(F.lit(0).cast("long"))

    def of_windows(t: Column) -> Column:
        placed = F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(let(placed, of_placed))

    def of_placed(p: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(p, a)["h"] == F.get(p, b)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return let(F.sort_array(F.transform(twice, lambda j: F.get(p, j)["i"])), of_places)

    def of_places(s: Column) -> Column:
        more = F.aggregate(F.sequence(F.lit(1), F.size(s) - 1), F.lit(3).cast("long"), lambda n, i: n + F.least(F.lit(3), F.get(s, i) - F.get(s, i - 1)))
        return F.when(F.size(s) == 0, F.lit(0).cast("long")).when(F.size(s) == 1, F.lit(3).cast("long")).otherwise(more)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def features(docs: DataFrame, text: str = "text", to: str = "_q") -> DataFrame:
    """docs and the struct `to` of counts that the rules look at, over whole texts. Null counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("long")
    counts = let(F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dups = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.withColumns({"_q_words": counts, "_q_lines": dups, "_q_chars": left(r"[\x20\x09-\x0D]+"), "_q_symbols": left(r"[^#*$%&|<>]+"), "_q_capitals": left(r"\P{Lu}+"), "_q_exclamations": left("[^!]+")})
    made = F.struct(
        "_q_words.n_words", F.col("_q_chars").alias("word_chars"), F.col("_q_symbols").alias("n_symbols"), "_q_lines.n_dup_lines", "_q_words.n_repeat_words",
        "_q_lines.n_lines", F.col("_q_capitals").alias("n_capitals"), F.col("_q_exclamations").alias("n_exclamations"),
    )
    return out.withColumn(to, made).drop("_q_words", "_q_lines", "_q_chars", "_q_symbols", "_q_capitals", "_q_exclamations")


def base_failed(q: str = "_q") -> Column:
    return (F.col(f"{q}.n_words") < 50) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))


def _ratio(rule: str, q: str = "_q") -> Column:
    over, under, _ = RULES[rule]
    return F.when(F.col(f"{q}.{under}") > 0, F.col(f"{q}.{over}") / F.col(f"{q}.{under}")).otherwise(0.0)


def at_most(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X of the binomial distribution (n, rate), summed exactly in logarithms; 1 where k >= rate * n, as
    no bound below the rate can hold there."""
    odds = math.log(rate / (1 - rate))
    first = n * math.log1p(-rate)
    start = F.struct(first.alias("term"), F.exp(first).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), start, lambda acc, i: F.when(i <= k, add(acc, i)).otherwise(acc))["sum"]
    return F.when(k >= rate * n, 1.0).otherwise(total)


def _over(rule: str, cutoff: Column, q: str = "_q") -> Column:
    return F.coalesce(_ratio(rule, q) > cutoff, F.lit(False))


def drafted(labelled: DataFrame, price: float = 10.0, stratum: str = "_stratum", q: str = "_q") -> DataFrame:
    """(stratum, place, rule, cutoff): the cutoffs that a stratum's drafting half proposes, in the order in which they
    join the verdict.

    For each rule the cutoff with the largest gain: the share of bad documents that it rejects, less `price` times that
    of good ones; none if that isn't over 0. Rules join by falling gain, ties by name."""
    grids = {r: F.array(*[F.lit(float(c)) for c in sorted(grid)]) for r, (_, _, grid) in RULES.items()}
    below = lambda r: F.size(F.filter(grids[r], lambda c: c < _ratio(r, q)))
    hits = labelled.select(stratum, "_good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.slice(grids[r], 1, below(r)).alias("over")) for r in RULES])).alias("x"))
    hits = hits.groupBy(stratum, "_good", "x.rule", "x.over").agg(F.count("*").alias("n"))  # few rows: a prefix of a grid each
    n = lambda good: F.sum(F.when(F.col("_good") == good, F.col("n")).otherwise(0))
    totals = labelled.groupBy(stratum).agg(F.sum(F.col("_good").cast("long")).alias("_g"), F.sum((~F.col("_good")).cast("long")).alias("_b"))
    rows = hits.select(stratum, "_good", "rule", "n", F.explode("over").alias("cutoff")).groupBy(stratum, "rule", "cutoff").agg(n(True).alias("good"), n(False).alias("bad")).join(totals, stratum)
    share = lambda k, of: F.coalesce(F.col(k) / F.nullif(F.col(of), F.lit(0)), F.lit(0.0))
    rows = rows.withColumn("gain", share("bad", "_b") - price * share("good", "_g")).where("gain > 0")
    best = rows.groupBy(stratum, "rule").agg(F.max(F.struct("gain", "cutoff")).alias("x")).select(stratum, "rule", "x.*")
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(F.desc("gain"), "rule"))
    return best.select(stratum, place.alias("place"), "rule", "cutoff")


def cutoffs(labelled: DataFrame, rate: float = 0.05, error: float = 0.05, price: float = 10.0, stratum: str = "_stratum", q: str = "_q") -> DataFrame:
    """(stratum, good, bad, steps, cut_<rule>...): the certified verdict of each stratum, a cutoff or null for each rule.

    labelled has the stratum, the counts, `_good`, and `_half`, which tells the drafting half (0) from the holdout (1).
    The drafting half proposes a path of verdicts, each with one rule more (drafted()). The holdout tests them in that
    order: the good documents that a verdict rejects by any of its rules give an exact binomial test that its true rate
    of false rejection is `rate` or more. Testing stops at the first verdict that isn't certified, which needs no
    correction along the path; over strata the error is divided by their number. So with probability 1 - error, no
    stratum's verdict rejects `rate` or more of its good documents, all rules together. A stratum with too few labels
    gets no cutoff and loses no document; neither does one without good ones."""
    path = materialize(drafted(labelled.where("_half = 0"), price, stratum, q), "draft")
    wide = path.groupBy(stratum).agg(*[F.max(F.when(F.col("rule") == r, F.struct("place", "cutoff"))).alias(f"_{r}") for r in RULES])
    held = labelled.where("_half = 1").join(wide, stratum, "left")
    # The step of the path at which a document is first rejected.
    first = F.least(*[F.when(_over(r, F.col(f"_{r}.cutoff"), q), F.col(f"_{r}.place")) for r in RULES])
    counts = held.groupBy(stratum).agg(F.sum(F.col("_good").cast("long")).alias("good"), F.sum((~F.col("_good")).cast("long")).alias("bad"), *[F.sum(F.when(F.col("_good") & (first <= i), 1).otherwise(0)).cast("long").alias(f"_k{i}") for i in range(1, len(RULES) + 1)])
    counts = materialize(counts, "holdout")  # a row for each stratum
    strata = max(1, counts.count())
    steps, sure = F.lit(0), F.col("good") > 0
    for i in range(1, len(RULES) + 1):
        sure = sure & (at_most(F.col(f"_k{i}"), F.col("good"), rate) <= error / strata)
        steps = F.when(sure, i).otherwise(steps)
    out = counts.withColumn("steps", steps).join(wide, stratum, "left")
    return out.select(stratum, "good", "bad", "steps", *[F.when(F.col(f"_{r}.place") <= F.col("steps"), F.col(f"_{r}.cutoff")).alias(f"cut_{r}") for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, rate: float = 0.05, error: float = 0.05, text: str = "text", doc_id: str = "doc_id", stratum: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all but the text, if None), `_q` and booleans `_failed` (the base rules) and `_kept`.

    Strata are the values of `stratum`; null is one of its own. Labels (doc_id, quality): 1 is good, 0 bad; other
    values, nulls and documents labelled both ways don't count. Labelled documents that pass the base rules are halved by
    the MD5 of doc_id into a drafting half and a holdout. Rows that repeat are judged alike. Without labels only the base
    rules reject; an empty table stays empty. Columns of docs named _q,
    _failed or _kept give way to the operator's."""
    keep = [c for c in (docs.columns if keep is None else keep) if (keep or c != text) and c not in ("_q", "_failed", "_kept")]
    own = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], F.col(doc_id).alias("_id"), F.coalesce(F.col(stratum), F.lit("")).alias("_stratum"), F.col(text).alias("_text"))
    own = materialize(features(own, "_text").drop("_text").withColumn("_failed", base_failed()), "quality")
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_low"), F.max("quality").alias("_high")).where("_low = _high")
    half = F.conv(F.substring(F.md5(F.col("_id").cast("string").cast("binary")), 1, 1), 16, 10).cast("int") % 2
    labelled = own.where("not _failed").join(marks, "_id").select("_stratum", "_q", (F.col("_low") == 1).alias("_good"), half.alias("_half"))
    best = cutoffs(materialize(labelled, "labelled"), rate, error)
    over = reduce(Column.__or__, [_over(r, F.col(f"cut_{r}")) for r in RULES])
    out = own.join(F.broadcast(best) if best.count() <= STRATA else best, "_stratum", "left").withColumn("_kept", ~F.col("_failed") & ~over)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], "_q", "_failed", "_kept")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document. Null and empty texts have no words and fail; repeated rows have a row each;
    other columns are dropped; an empty table gives an empty table."""
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", *[f"_q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def _oracle() -> str:
    """SQL for op8_quality(): counts by regular expressions and numbered words, the path of verdicts and its exact tests."""
    ratios = ",\n  ".join(f"CASE WHEN {under} > 0 THEN {over} / {under} ELSE 0 END AS r_{r}" for r, (over, under, _) in RULES.items())
    grid = ", ".join(f"('{r}', {float(c)!r}::DOUBLE)" for r, (_, _, cuts) in RULES.items() for c in cuts)
    long = " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule, r_{r} AS ratio FROM rt" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, stratum, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT k, unnest(range(1, len(words) - 1)) AS i, words FROM w),
win AS (SELECT k, i, struct_pack(a := words[i], b := words[i + 1], c := words[i + 2]) AS x FROM g),
twice AS (SELECT k, i FROM (SELECT *, count(*) OVER (PARTITION BY k, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, i + o AS j FROM twice, (VALUES (0), (1), (2)) AS v(o)) GROUP BY k),
f AS (SELECT w.k, doc_id, stratum, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclamations
  FROM w LEFT JOIN rep ON rep.k = w.k),
rt AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed,
  {ratios} FROM f),
lab AS (SELECT doc_id, min(quality) = 1 AS good, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 1))::INTEGER % 2 AS half FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
lr AS (SELECT rt.k, stratum, rule, ratio, good, half FROM ({long.replace("SELECT doc_id", "SELECT k, doc_id, stratum, failed")}) rt JOIN lab ON lab.doc_id = rt.doc_id WHERE NOT failed),
gain AS (SELECT stratum, g.rule, cutoff, coalesce(count(*) FILTER (NOT good AND ratio > cutoff) / nullif(count(*) FILTER (NOT good), 0), 0) - 10 * coalesce(count(*) FILTER (good AND ratio > cutoff) / nullif(count(*) FILTER (good), 0), 0) AS gain
  FROM lr JOIN (VALUES {grid}) AS g(rule, cutoff) ON g.rule = lr.rule WHERE half = 0 GROUP BY ALL),
draft AS (SELECT stratum, rule, cutoff, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, rule) AS place FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cutoff DESC) AS nth FROM gain WHERE gain > 0) WHERE nth = 1),
hold AS (SELECT k, lr.stratum, good, min(place) FILTER (ratio > cutoff) AS first FROM lr LEFT JOIN draft ON draft.stratum = lr.stratum AND draft.rule = lr.rule WHERE half = 1 GROUP BY ALL),
cnt AS (SELECT stratum, s, count(*) FILTER (good) AS n, count(*) FILTER (good AND first <= s) AS x FROM hold, range(1, {len(RULES) + 1}) AS r(s) GROUP BY ALL),
tst AS (SELECT stratum, s, n > 0 AND x < 0.05 * n AND (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95))) FROM range(x + 1) AS q(i)) <= 0.05 / (SELECT count(DISTINCT stratum) FROM cnt) AS sure FROM cnt),
steps AS (SELECT stratum, count(*) FILTER (ok) AS steps FROM (SELECT stratum, s, bool_and(sure) OVER (PARTITION BY stratum ORDER BY s) AS ok FROM tst) GROUP BY stratum),
cut AS (SELECT draft.* FROM draft JOIN steps ON steps.stratum = draft.stratum WHERE place <= steps),
rej AS (SELECT DISTINCT k FROM ({long.replace("SELECT doc_id", "SELECT k, stratum")}) l JOIN cut ON cut.stratum = l.stratum AND cut.rule = l.rule WHERE ratio > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND k NOT IN (SELECT k FROM rej) AS kept FROM rt"""


ORACLE = _oracle()
