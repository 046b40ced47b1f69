"""Fingerprints and their likeness against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomfield.llm import imatch


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(600)]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 40, 300, 1500]))) for _ in range(60)] + ["", None, "a", "A a a", "Ünder 12"]
    return [*enumerate(texts), (3, texts[3])], texts


def hashes(spark, values, *seeds):
    """XXH64 as Spark has it: the hash itself isn't what is tested."""
    frame = spark.createDataFrame([(v,) for v in values], "v string" if isinstance(values[0], str) else "v long")
    return {r.v: [r[f"h{i}"] for i in range(len(seeds))] for r in frame.select("v", *[(F.xxhash64("v") if s is None else F.xxhash64("v", F.lit(s))).alias(f"h{i}") for i, s in enumerate(seeds)]).collect()}


def folded(spark, lists):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i long, x array<long>")
    one = F.aggregate(F.slice("x", 2, 100_000), F.xxhash64(F.get("x", F.lit(0))), lambda a, v: F.xxhash64(a, v))
    return {r.i: f"{r.h & (1 << 64) - 1:016x}"[:8] for r in frame.select("i", one.alias("h")).collect()}


def expected(spark, texts, band):
    found = {t: set(re.findall(r"[^\W_]+", (t or "").lower())) for t in texts}
    of = {w: h[0] for w, h in hashes(spark, sorted(set().union(*found.values())), None).items()}
    distinct = set(t or "" for t in texts)
    df = {w: sum(w in found.get(t, set()) for t in distinct) for w in of}
    inside = {of[w] for w, n in df.items() if band[0] * len(distinct) <= n <= band[1] * len(distinct)}
    draws = hashes(spark, sorted(of.values()), *imatch.SEEDS)
    lists, at = [], {}
    for t in texts:
        own = sorted(of[w] for w in found[t])
        kept = set(own[: imatch.FEWEST]) | (set(own) & inside)
        level = max(0, math.floor(math.log2(max(1, len(kept)) / imatch.SUBSETS)))
        for k, v in enumerate((level, level + 1)):
            modulus = imatch.SUBSETS * len(imatch.SEEDS) << v
            for i in range(imatch.SUBSETS):
                members = sorted(x for x in kept if any(h % modulus == i for h in draws[x]))
                at[t, level, k, i] = len(lists) if members else None
                if members:
                    lists.append(members)
    parts = folded(spark, lists)
    return {t: f"{level:02x}" + "".join("0" * 8 if at[t, level, k, i] is None else parts[at[t, level, k, i]] for k in (0, 1) for i in range(imatch.SUBSETS)) for t, level, *_ in at}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_fingerprints(spark, docs, limit):
    rows, texts = docs
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    words = imatch.lexicon(frame, band=(0.05, 0.3))
    want = expected(spark, texts, (0.05, 0.3))
    got = imatch.with_fingerprint(frame, "text", words, limit=limit).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fingerprint == want[r.text], (r.text or "")[:30]


def likeness(a, b):
    """The share of filled subsets alike, over the levels that both have."""
    if a == b:
        return 1.0
    cut = lambda x: [x[2 + 8 * i : 10 + 8 * i] for i in range(2 * imatch.SUBSETS)]
    la, lb, pa, pb, n = int(a[:2], 16), int(b[:2], 16), cut(a), cut(b), imatch.SUBSETS
    levels = lambda level, parts: {(level + k, i): parts[k * n + i] for k in (0, 1) for i in range(n)}
    x, y = levels(la, pa), levels(lb, pb)
    both = [(x[k], y[k]) for k in x.keys() & y.keys() if {x[k], y[k]} != {"0" * 8}]
    return sum(p == q for p, q in both) / len(both) if both else 0.0


def test_likeness(spark, docs):
    rows, texts = docs
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    prints = sorted({r.fingerprint for r in imatch.with_fingerprint(frame, "text", imatch.lexicon(frame)).collect()})
    edited = [p[:50] + "0" * 16 + p[66:] for p in prints]
    pairs = spark.createDataFrame([(a, b) for a in prints for b in [*prints[:20], *edited[:10]]], "a string, b string")
    for r in pairs.select("a", "b", imatch.likeness(F.col("a"), F.col("b")).alias("x")).collect():
        assert math.isclose(r.x, likeness(r.a, r.b)), (r.a, r.b)


def test_whole_query_on_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, _lexicon string, fingerprint string"
    for name, rows in (("empty", []), ("one", [(4, None, "x", "y")]), ("odd", [(1, None, "x", "y"), (1, "a b", "x", "y"), (None, "", "x", "y"), (3, "c", "x", "y"), (3, "c", "x", "y")])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = imatch.op1_imatch(spark, f"{tmp_path}/{name}").collect()
        assert len(out) == len(rows) and all(0 <= r.near_next <= 1 for r in out)
