"""Secret scans over a trigram inverted index. DataFrame functions only."""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let, materialize, table
from .common import scan as scan_array

#: Candidates that are broadcast at most; more are joined by a shuffle.
BROADCAST = 500_000
#: Characters of the pieces that a text is cut into for masking.
PIECE = 4096
#: Strings that a part of a pattern may stand for before its trigrams are taken.
STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A pattern that Java and Python read alike; a match counts if its group has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # the same matches as [0-9a-f]+ of 16 or more
]
MORE = [
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
]
RULES = BASE + MORE

#: A trigram query: a trigram, ("and", queries), ("or", queries), or None where anything may match.
Query = str | tuple | None


def _both(a: Query, b: Query) -> Query:
    return b if a is None else a if b is None else ("and", a, b)


def _of_strings(strings: set[str]) -> Query:
    """At least one of the strings occurs."""
    if any(len(x) < 3 for x in strings):
        return None
    each = []
    for x in sorted(strings):
        grams = sorted({x[i : i + 3] for i in range(len(x) - 2)})
        each.append(grams[0] if len(grams) == 1 else ("and", *grams))
    return each[0] if len(each) == 1 else ("or", *each)


def _walk(items) -> tuple[set[str] | None, Query]:
    """The strings that a sequence stands for, if they are few, or else None; and a query that its matches satisfy."""
    strings, query, whole = {""}, None, True

    def flush() -> None:
        nonlocal strings, query, whole
        query, strings, whole = _both(query, _of_strings(strings)), {""}, False

    for op, arg in items:
        own, inner = None, None
        if op is sre.LITERAL:
            own = {chr(arg).lower()}
        elif op is sre.IN:
            own = _class(arg)
        elif op is sre.SUBPATTERN:
            own, inner = _walk(arg[3])
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(x[0] is not None for x in parts) and sum(len(x[0]) for x in parts) <= STRINGS:
                own = set().union(*(x[0] for x in parts))
            else:
                queries = [_both(q, _of_strings(s) if s is not None else None) for s, q in parts]
                inner = None if any(q is None for q in queries) else ("or", *queries)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, body = arg
            one, q = _walk(body)
            if one is not None and most <= 1:
                own = one | {""} if not least else one
            elif one is not None and least == most and len(one) ** least <= STRINGS:
                own = {""}
                for _ in range(least):
                    own = {a + b for a in own for b in one}
            elif one is not None and least and len(one) <= 4 and len(strings) * len(one) <= STRINGS:
                strings = {a + b for a in strings for b in one}  # one at least, then who knows
            elif least:
                inner = q
        elif op is sre.AT:
            continue
        if own is not None and len(strings) * len(own) <= STRINGS:
            strings = {a + b for a in strings for b in own}
        else:
            flush()
            if own is not None:
                strings = own
            query = _both(query, inner)
    return (strings, query) if whole else (None, _both(query, _of_strings(strings)))


def _class(arg) -> set[str] | None:
    """The letters of a small character class."""
    out: set[str] = set()
    for op, x in arg:
        if op is sre.LITERAL:
            out.add(chr(x).lower())
        elif op is sre.RANGE and x[1] - x[0] < 8:
            out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def trigram_query(pattern: str) -> Query:
    """A query on the lower-cased trigrams of a text that holds wherever the pattern matches; None: scan every text."""
    strings, query = _walk(parser.parse(pattern))
    return _both(query, _of_strings(strings)) if strings is not None else query


def trigrams(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:]))


def _holds(query: Query, grams: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(grams, query)
    parts = [_holds(q, grams) for q in query[1:]]
    return reduce(Column.__and__ if query[0] == "and" else Column.__or__, parts)


def build_index(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Postings (trigram, doc_id) of every trigram that a rule's query asks for, over whole lower-cased texts."""
    wanted = sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))
    if not wanted:
        return docs.select(F.lit("").alias("trigram"), F.col(doc_id).alias("doc_id")).limit(0)
    have = let(F.lower(F.col(text)), lambda low: F.filter(F.array(*map(F.lit, wanted)), lambda g: F.contains(low, g)))
    return docs.select(F.explode(have).alias("trigram"), F.col(doc_id).alias("doc_id"))


def candidates(index: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, rules): the kinds of rules whose query the postings satisfy. Postings meet by document: a document has
    at most as many as there are trigrams in all queries."""
    met = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("grams"))
    asked = [(r.kind, q) for r in rules if (q := trigram_query(r.pattern)) is not None]
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("grams")), F.lit(k)) for k, q in asked]))
    return met.select("doc_id", kinds.alias("rules")).where(F.size("rules") > 0)


def _spans(text: Column, rule: Rule, nth: int) -> Column:
    """The rule's spans in a text, verified: structs (start, nth, end). A match starts where the pieces between matches
    and the matches before it end; all lengths are in code points."""
    kind = "array<struct<start: int, nth: int, end: int>>"
    none = F.array().cast(kind)
    pattern = F.lit(rule.pattern)

    def locate(found: Column) -> Column:
        return let(F.split(text, rule.pattern, -1), lambda between: let(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda sized: walk(found, between, sized)))

    def walk(found: Column, between: Column, sized: Column) -> Column:
        # Lengths of the piece before a match and of the match; their running sums are where matches start and end.
        pairs = F.transform(found, lambda m, i: F.struct((F.length(F.get(between, i)) + F.length(m)).alias("upto"), F.length(m).alias("own")))
        ends = scan_array(pairs, lambda a, x: F.struct((a["upto"] + x["upto"]).alias("upto"), x["own"].alias("own")))
        spans = F.transform(ends, lambda e: F.struct((e["upto"] - e["own"]).alias("start"), F.lit(nth).alias("nth"), e["upto"].alias("end")))
        return F.filter(spans, lambda x, i: F.length(F.get(sized, i)) >= rule.least) if rule.least else spans

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(locate(found)))


def scan(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs and `_spans`: array of structs (start, nth, end), by start and then nth; nth is the rule's place in rules.

    Rules whose pattern has mandatory trigrams are verified on the candidates that the inverted index gives; the others
    scan every text. Null texts count as empty and have no spans; documents that repeat, or have no doc_id, are scanned
    each; an empty table stays empty. A column of docs named _spans gives way to the operator's, all others stay.
    Candidates are broadcast only where they are few, and joined by a shuffle else."""
    docs = docs.drop("_spans")
    own, kinds = fresh(docs, "_candidate"), fresh(docs, "_rules")
    found = materialize(candidates(materialize(build_index(docs, rules, text, doc_id), "postings"), rules), "candidates")
    found = found.select(F.col("doc_id").alias(own), F.col("rules").alias(kinds))
    found = F.broadcast(found) if found.count() <= BROADCAST else found
    joined = docs.join(found, docs[doc_id].eqNullSafe(found[own]), "left")
    none = F.array().cast("array<struct<start: int, nth: int, end: int>>")
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = []
    for nth, rule in enumerate(rules):
        spans = _spans(whole, rule, nth)
        asked = F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False))
        parts.append(spans if trigram_query(rule.pattern) is None else F.when(asked, spans).otherwise(none))
    return joined.withColumn("_spans", F.sort_array(F.concat(*parts))).drop(own, kinds)


def listed(spans: Column, rules: list[Rule] = RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["nth"]), x["start"], x["end"])), ",")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by one mark. Null texts stay null.

    Running largest ends tell where a run starts. The text between runs is cut from pieces of PIECE characters, as a
    place in a string is found by counting from its start: so the work grows with the text, not with the product of text
    and spans."""
    kind = "array<struct<start: int, end: int>>"

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        """Characters from start (counted from 0) up to end."""
        first = F.floor(start / PIECE).cast("int")
        whole = F.array_join(F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
        return F.substr(whole, start - first * PIECE + 1, end - start)

    def between(ends: Column) -> Column:
        """(end of the run before, start of this one) where a run starts, and what is after the last."""
        gaps = F.transform(spans, lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.get(ends, i - 1)).alias("start"), x["start"].alias("end")))
        gaps = F.filter(gaps, lambda g, i: (i == 0) | (g["end"] >= g["start"]))
        return F.concat(gaps, F.array(F.struct(F.element_at(ends, -1).alias("start"), F.length(text).alias("end"))).cast(kind))

    def joined(gaps: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        return let(pieces, lambda p: F.array_join(F.transform(gaps, lambda g: F.when(g["end"] > g["start"], cut(p, g["start"], g["end"])).otherwise("")), mark))

    ends = scan_array(F.transform(spans, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
    return F.when(F.size(spans) == 0, text).otherwise(let(let(ends, between), joined))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document. Null texts are empty; repeated rows have a row each; other columns are dropped; an
    empty table gives an empty table."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_count(nth).alias(f"n_{rule.kind}") for nth, rule in enumerate(BASE)]
    base = F.filter("_spans", lambda x: x["nth"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def _count(nth: int) -> Column:
    return F.size(F.filter("_spans", lambda x: x["nth"] == nth)).cast("long")
