import itertools
import math
import random
import time
from fractions import Fraction

from pyspark.sql import functions as F

from loomfield.functions import stats


def hyper(x, total, marked, drawn):
    return Fraction(math.comb(marked, x) * math.comb(total - marked, drawn - x), math.comb(total, drawn))


def test_hypergeometric_tail():
    for total, marked, drawn in ((10, 4, 5), (30, 7, 12), (6, 6, 3), (5, 0, 2)):
        for x in range(-1, drawn + 1):
            exact = sum((hyper(i, total, marked, drawn) for i in range(max(x + 1, 0, drawn - total + marked), min(marked, drawn) + 1)), Fraction(0))
            assert math.isclose(stats.hypergeom_sf(x, total, marked, drawn), float(exact), abs_tol=1e-12)


def test_fisher():
    for a, b, c, d in ((3, 1, 1, 3), (0, 5, 5, 0), (2, 2, 2, 2), (0, 0, 3, 1), (8, 2, 1, 5)):
        total, marked, drawn = a + b + c + d, a + b, a + c
        p = {i: hyper(i, total, marked, drawn) for i in range(max(0, drawn - total + marked), min(marked, drawn) + 1)}
        assert math.isclose(stats.fisher_two_sided(a, b, c, d), float(sum(v for v in p.values() if v <= p[a])), rel_tol=1e-9)


def test_mann_whitney_exact():
    for first, second in (([1.0, 5.0, 6.0], [2.0, 3.0, 4.0, 7.0]), ([1.0, 2.0], [3.0, 4.0, 5.0])):
        values, n1 = [*first, *second], len(first)
        u = lambda chosen: sum(x > y for x in chosen for y in values if y not in chosen)
        every = [u(c) for c in itertools.combinations(values, n1)]
        own = max(u(tuple(first)), n1 * len(second) - u(tuple(first)))
        assert math.isclose(stats.mann_whitney(first, second), min(1.0, 2 * sum(x >= own for x in every) / len(every)))


def test_mann_whitney_degenerate():
    assert stats.mann_whitney([], [1.0]) == 1.0
    assert stats.mann_whitney([1.0] * 9, [1.0] * 9) == 1.0
    assert stats.mann_whitney([1.0] * 10 + [2.0], [3.0] * 10) < 0.001


def test_student_tail():
    assert math.isclose(stats.t_two_sided(1.0, 1.0), 0.5, rel_tol=1e-9)  # Cauchy
    assert math.isclose(stats.t_two_sided(math.sqrt(2), 2.0), 1 - math.sqrt(2) / 2, rel_tol=1e-9)
    assert math.isclose(stats.t_two_sided(1.96, 1e7), stats.normal_two_sided(1.96), rel_tol=1e-5)


def test_corrections(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None), ("e", 0.5)], "k string, p_value double")
    got = {r.k: r.adj_p_value for r in stats.benjamini_hochberg(df).collect()}
    assert [round(got[k], 6) if got[k] else None for k in "abcde"] == [0.04, 0.053333, 0.053333, None, 0.5]
    got = {r.k: r.adj_p_value for r in stats.holm(df).collect()}
    assert [round(got[k], 6) if got[k] else None for k in "abcde"] == [0.04, 0.09, 0.09, None, 0.5]
    assert stats.benjamini_hochberg(df.where("false")).count() == 0


def test_z(spark):
    row = spark.range(1).select(stats.fisher_z(F.lit(1.0), F.lit(10), F.lit(0.0), F.lit(10)).alias("z"), stats.fisher_z(F.lit(0.5), F.lit(3), F.lit(0.0), F.lit(10)).alias("few")).first()
    assert math.isclose(row.z, math.atanh(0.9999) / math.sqrt(2 / 7)) and row.few is None


def test_blocks_are_one_window(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), None if rng.random() < 0.05 else round(rng.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "f string, p_value double")
    key = lambda rows: sorted(map(str, rows))
    made = lambda: [key(g(df, family=f).collect()) for g in (stats.benjamini_hochberg, stats.holm) for f in (None, ["f"])] + [key(stats.percentile_ranks(df, "p_value").collect())]
    whole = made()
    monkeypatch.setattr(stats, "WINDOW", 9)
    assert made() == whole
    own = sorted(p for f, p in rows if f == "a" and p is not None)
    least = {p: min(1.0, min(q * len(own) / sum(x <= q for x in own) for q in own if q >= p)) for p in own}
    got = {r.p_value: r.adj_p_value for r in stats.benjamini_hochberg(df, family=["f"]).where("f = 'a' and p_value is not null").collect()}
    assert all(math.isclose(got[p], least[p]) for p in own)


def test_a_billion_cells():
    began = time.time()
    assert 0.3 < stats.hypergeom_sf(10_000_000, 10**9, 10**8, 10**8) < 0.6
    assert math.isclose(stats.hypergeom_sf(10_003_000, 10**9, 10**8, 10**8), stats.normal_two_sided(3000.5 / math.sqrt(1e7 * 0.9 * 0.9)) / 2, rel_tol=0.01)
    assert 0 < stats.fisher_two_sided(10_004_000, 89_996_000, 89_996_000, 810_004_000) < 0.25
    assert time.time() - began < 1


def test_fisher_at_random():
    rng = random.Random(8)
    for _ in range(300):
        a, b, c, d = (rng.randint(0, 40) for _ in range(4))
        total, marked, drawn = a + b + c + d, a + b, a + c
        p = {i: hyper(i, total, marked, drawn) for i in range(max(0, drawn - total + marked), min(marked, drawn) + 1)}
        assert math.isclose(stats.fisher_two_sided(a, b, c, d), float(sum(v for v in p.values() if v <= p[a])), rel_tol=1e-9)
        assert math.isclose(stats.hypergeom_sf(a, total, marked, drawn), float(sum((v for i, v in p.items() if i > a), Fraction(0))), rel_tol=1e-9, abs_tol=1e-14)
