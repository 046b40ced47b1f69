import itertools
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomfield.operators import covariation as cov
from loomfield.operators import enrichment as enr
from loomfield.operators import expression as exp
from loomfield.operators import neighbors as nb
from loomfield.operators import patterns as pat
from loomfield.operators import summary
from loomfield.sources import tables

SCHEMA = "dataset string, fov string, cell_id long, label string, x double, y double"


def points(spark, rows):
    return spark.createDataFrame([("d", "f", i, *r) for i, r in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = random.Random(3)
    rows = [("d" + str(i % 2), f"f{i % 4}", i, rng.choice("ABC"), rng.uniform(0, 12), rng.uniform(0, 12)) for i in range(400)]
    return rows, spark.createDataFrame(rows, SCHEMA).cache()


def near(rows, r):
    return {(a[2], b[2]) for a in rows for b in rows if a[1] == b[1] and a[2] != b[2] and (a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2 <= r * r}


def test_line(spark):
    line = points(spark, [("A", 0.0, 0.0), ("B", 1.0, 0.0), ("A", 2.0, 0.0), ("B", 3.0, 0.0), ("C", 4.0, 0.0)])
    assert {(r.center_id, r.neighbor_id) for r in nb.radius_join(line, 1.0).collect()} == {(i, j) for i in range(5) for j in range(5) if abs(i - j) == 1}
    assert {(r.center_id, r.neighbor_id) for r in nb.knn_join(line, 1, 5.0).collect()} == {(0, 1), (1, 0), (2, 1), (3, 2), (4, 3)}  # ties by id
    assert {r.x for r in nb.normalize(line).collect()} == {0.0, 1.0, 2.0, 3.0, 4.0}
    at_cut_off = nb.knn_join(line, 4, 1.0, strict=True)
    assert at_cut_off.count() == 0 and nb.knn_join(line, 4, 1.0).count() == 8


def test_coincident_and_alone(spark):
    both = points(spark, [("A", 1.0, 1.0), ("B", 1.0, 1.0), ("A", 2.0, 1.0)])
    assert {(r.center_id, r.neighbor_id) for r in nb.radius_join(both, 0.5).collect()} == {(0, 1), (1, 0)}
    with pytest.raises(ValueError):
        nb.nearest_distance(points(spark, [("A", 0.0, 0.0)]))
    far = points(spark, [("A", 0.0, 0.0), ("A", 0.1, 0.0), ("A", 5000.0, 0.0)])
    assert {r.cell_id: round(r.dist2, 4) for r in nb.nearest_distance(far).collect()} == {0: 0.01, 1: 0.01, 2: round(4999.9**2, 4)}
    with pytest.raises(ValueError):
        nb.neighbors(far, far)


def test_many_rounds(spark):
    began = time.time()
    rows = [("A", float(2**i), 0.0) for i in range(16)]
    got = {r.cell_id: r.dist2 for r in nb.nearest_distance(points(spark, rows)).collect()}
    assert got == {i: (2.0 ** max(0, i - 1)) ** 2 for i in range(16)}
    rng = random.Random(2)
    rows = [("A", rng.gauss(0, 1e-4), rng.gauss(0, 1e-4)) for _ in range(300)] + [("B", rng.uniform(-1e3, 1e3), rng.uniform(-1e3, 1e3)) for _ in range(20)]
    got = {r.cell_id: r.dist2 for r in nb.nearest_distance(points(spark, rows)).collect()}
    for i, (_, x, y) in enumerate(rows):
        assert math.isclose(got[i], min((x - u) ** 2 + (y - v) ** 2 for j, (_, u, v) in enumerate(rows) if j != i), rel_tol=1e-9)
    assert time.time() - began < 60


def test_radius_is_brute_force(cloud):
    rows, cells = cloud
    for r in (0.7, 3.0):
        assert {(x.center_id, x.neighbor_id) for x in nb.radius_join(cells, r).collect()} == near(rows, r)


def test_knn_rounds_are_brute_force(cloud):
    rows, cells = cloud
    for k, cut in ((1, 40.0), (3, 2.0), (5, 60.0)):
        want = set()
        for a in rows:
            own = sorted(((a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2, b[2]) for b in rows if b[1] == a[1] and b[2] != a[2])
            want |= {(a[2], j) for d2, j in own[:k] if d2 <= cut * cut}
        assert {(x.center_id, x.neighbor_id) for x in nb.knn_join(cells, k, cut).collect()} == want


def test_growth_is_enumeration(spark, monkeypatch):
    rng = random.Random(5)
    sets = spark.createDataFrame([("d", "f", i, sorted(rng.sample("abcdef", rng.randint(1, 5)))) for i in range(200)], "dataset string, fov string, center_id long, labels array<string>")
    plain = {(tuple(r.itemset), r.freq) for r in pat.mine(sets, 0.2).collect()}
    grouped = {(tuple(r.itemset), r.freq) for r in pat.mine(sets, 0.2, ["fov"]).collect()}
    monkeypatch.setattr(pat, "ENUMERATED", 0)
    assert plain == {(tuple(r.itemset), r.freq) for r in pat.mine(sets, 0.2).collect()}
    assert plain == grouped == {(tuple(r.itemset), r.freq) for r in pat.mine(sets, 0.2, ["fov"]).collect()}


def test_wide_neighbourhoods_by_group(spark):
    rng = random.Random(6)
    names = [f"{i:02d}" for i in range(34)]
    rows = [("d", f"f{i % 2}", i, sorted(rng.sample(names[:30] if i % 2 else names[4:], 30 if i % 4 == 0 else 6))) for i in range(400)]
    found = pat.mine(spark.createDataFrame(rows, "dataset string, fov string, center_id long, labels array<string>"), 0.52, ["fov"]).collect()
    assert found
    for fov in ("f0", "f1"):
        own = [set(r[3]) for r in rows if r[1] == fov]
        got = {tuple(r.itemset): r.freq for r in found if r.fov == fov}
        ones = [x for x in names if sum(x in s for s in own) >= 0.52 * len(own)]
        for n in (1, 2):
            want = {c: k for c in itertools.combinations(ones, n) if (k := sum(s.issuperset(c) for s in own)) >= 0.52 * len(own)}
            assert {c: k for c, k in got.items() if len(c) == n} == want


def test_maximal(spark):
    found = spark.createDataFrame([(["a"],), (["b"],), (["c"],), (["a", "b"],)], "itemset array<string>")
    for f in (pat.maximal, pat.maximal_of_any):
        assert {tuple(r.itemset) for r in f(found).collect()} == {("c",), ("a", "b")}
    odd = spark.createDataFrame([(["a"],), (["c", "b", "a"],)], "sets array<string>")
    assert [tuple(r.sets) for r in pat.maximal_of_any(odd, "sets").collect()] == [("c", "b", "a")]


def test_multiset(spark):
    row = spark.range(1).select(*[pat.has_motif(F.array(*map(F.lit, "aab")), F.array(*map(F.lit, m))).alias(m) for m in ("ab", "aab", "abb")]).first()
    assert (row.ab, row.aab, row.abb) == (True, True, False)


def test_empty_transactions(spark):
    cells = points(spark, [("A", 0.0, 0.0), ("B", 1.0, 0.0), ("A", 50.0, 0.0)])
    assert enr.center_sets(cells, "A", 2.0, 3).count() == 2  # by k, the lone centre counts
    assert enr.center_sets(cells, "A", 2.0, None).count() == 1


def test_enrichment_edges(spark):
    cells = points(spark, [("A", 0.0, 0.0), ("B", 1.0, 0.0), ("A", 3.0, 0.0), ("C", 3.5, 0.0)])
    row = enr.enrichment(cells, "A", ["B", "no such"], 1.0).first()
    assert (row.n_center_motif, row.n_center, row.n_motif, row.n_cells) == (1, 2, 1, 4) and row.adj_p_value == row.p_value
    with pytest.raises(ValueError):
        enr.enrichment(cells, "A", ["no such"], 1.0)
    with pytest.raises(ValueError):
        enr.enrichment(cells, "Z", ["B"], 1.0)
    assert enr.enrichment(cells, "A", None, 0.1).count() == 0  # nothing found
    twice = enr.motif_counts(cells, nb.radius_join(cells, 9.0), "A", enr._motifs(spark, [["A", "A"]])).first()
    assert twice.n_center == 1


def test_motif_pairs_with_own_label(spark):
    cells = points(spark, [("A", 0.0, 0.0), ("A", 1.0, 0.0), ("B", 0.5, 0.5)])
    got = {(r.center_id, r.neighbor_id) for r in cov.motif_pairs(cells, "A", ["A", "B"], 5.0).collect()}
    assert got == {(0, 2), (1, 2)}


def test_factorised_is_pair_by_pair(spark, cloud):
    rows, cells = cloud
    rng = random.Random(9)
    value = {(r[2], g): float(rng.randint(1, 6)) for r in rows for g in "xyz" if rng.random() < 0.4}
    label, fov = {r[2]: r[3] for r in rows}, {r[2]: r[1] for r in rows}
    long = spark.createDataFrame([(c, g, v) for (c, g), v in value.items()], "cell_id long, gene string, value double")
    expr, genes = tables.expression(long, cells), spark.createDataFrame([("x",), ("y",), ("z",)], "gene string")
    pairs = cov.motif_pairs(cells, "A", ["B", "C"], 2.0)
    listed = [(r.center_id, r.neighbor_id) for r in pairs.collect()]
    members = {}
    for c in label:
        members.setdefault((fov[c], label[c]), []).append(c)
    mean = lambda c, g: sum(value.get((m, g), 0) for m in members[fov[c], label[c]]) / len(members[fov[c], label[c]])
    sums = {(r.gene_center, r.gene_motif): r for r in cov.paired_sums(pairs, expr, exp.label_means(expr, cells, ["fov"]), genes, "A").collect()}
    assert len(sums) == 9
    for (g, h), r in sums.items():
        u = [value.get((a, g), 0) - mean(a, g) for a, _ in listed]
        v = [value.get((b, h), 0) - mean(b, h) for _, b in listed]
        for got, want in ((r.cov, sum(map(math.prod, zip(u, v, strict=True)))), (r.ss_center, sum(x * x for x in u)), (r.ss_motif, sum(x * x for x in v))):
            assert math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-9)


def test_groups_named_twice(spark):
    cells = points(spark, [("A", 0.0, 0.0), ("B", 1.0, 0.0)])
    expr = tables.expression(spark.createDataFrame([(0, "g", 1.0), (1, "h", 0.0), (1, None, 2.0)], "cell_id long, gene string, value double"), cells)
    groups = spark.createDataFrame([(0, 1), (0, 1), (1, 2)], "cell_id long, grp int")
    rows = exp.de_fisher(expr, groups, alpha=None).collect()
    assert [(r.gene, r.a, r.b, r.c, r.d, r.de_in) for r in rows] == [("g", 1, 0, 0, 1, "group1")]


def test_tables(spark, tmp_path):
    cells = points(spark, [("A", 0.0, 0.0)])
    with pytest.raises(ValueError):
        tables.cells(cells, "x", "z", "label")
    tables.save(cells, str(tmp_path / "t"))
    assert tables.load(spark, str(tmp_path / "t")).count() == 1
    with pytest.raises(ValueError):
        tables.merge(cells, cells.drop("x"))


def test_grid_probes_follow_the_cells(spark, cloud):
    rows, cells = cloud
    got = {(r.fov, r.center_id, r.neighbor_id) for r in nb.probe_join(cells, 2.5, 2.0).collect()}
    assert got == {(r.fov, r.center_id, r.neighbor_id) for r in nb.probe_join(cells, nb.grid_probes(cells, 2.5), 2.0).collect()} and got
    # A box of 4e12 grid points, which no table of them could hold, for three cells.
    wide = points(spark, [("A", 0.0, 0.0), ("A", 1.0, 0.0), ("B", 1e7, 1e7)])
    assert {(r.center_id // 2_000_002, r.center_id % 2_000_002, r.neighbor_id) for r in nb.probe_join(wide, 5.0, 4.9).collect()} == {(1, 1, 0), (1, 1, 1), (2, 1, 1), (2_000_001, 2_000_001, 2)}
    found = summary.motif_probes(wide, 5.0, ["A", "A"], 4.9).collect()
    assert [r.n for r in found] == [2]


def test_a_center_keeps_to_one_bucket(spark, cloud, monkeypatch):
    """What is asked by center needs no exchange of the pairs: two exchanges, those of the join's sides."""
    rows, cells = cloud
    monkeypatch.setattr(nb, "ROWS", 100)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for asked in (pat.transactions(nb.radius_join(cells, 2.0)), nb.knn_join(cells, 3, 2.0)):
            plan = asked._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hash") == 2, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    pairs = nb.radius_join(cells, 2.0)
    assert pairs.select("center_id", *nb.BUCKET).distinct().count() == pairs.select("center_id").distinct().count()


def test_parts_follow_the_cells(spark, cloud, monkeypatch):
    """More cells make more parts of a join, not larger ones; the pairs are the same."""
    rows, cells = cloud
    want = near(rows, 2.0)
    monkeypatch.setattr(nb, "ROWS", 10)
    found = nb.radius_join(cells, 2.0)
    assert found.rdd.getNumPartitions() == 40 and {(r.center_id, r.neighbor_id) for r in found.collect()} == want


def test_other_pairs_by_every_way(spark, cloud):
    """Centres and neighbours left out before the join, or after it where all neighbours count, give the pairs of plain loops."""
    rows, cells = cloud
    pairs = cov.motif_pairs(cells, "A", ["B", "C"], 0.8)
    centers, taken = {(r.fov, r.center_id) for r in pairs.collect()}, {(r.fov, r.neighbor_id) for r in pairs.collect()}
    of = {r[2]: r for r in rows}
    full = [(a, b) for a, b in near(rows, 0.8) if of[a][3] == "A"]
    want = {(a, b) for a, b in full if of[b][3] != "A" and (of[a][1], a) not in centers and (of[b][1], b) not in taken}
    assert {(r.center_id, r.neighbor_id) for r in cov.other_pairs(cells, "A", pairs, 0.8).collect()} == want and want
    want = {(a, b) for a, b in want if sum(x == a for x, _ in full) >= 2}
    assert {(r.center_id, r.neighbor_id) for r in cov.other_pairs(cells, "A", pairs, 0.8, min_size=2).collect()} == want


def test_covariation_reads_the_expression_few_times(spark, cloud, monkeypatch):
    """A cell's expression is packed into one row once; no join of pairs or cells reads the table by gene again."""
    rows, cells = cloud
    rng = random.Random(4)
    long = [(r[2], g, float(rng.randint(1, 6))) for r in rows for g in "xyz" if rng.random() < 0.6]
    expr = tables.written(tables.expression(spark.createDataFrame(long, "cell_id long, gene string, value double"), cells), "expression")
    plans = []
    monkeypatch.setattr(cov, "written", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or tables.written(df, label))
    found = cov.covariation(cells, expr, "A", ["B", "C"], None, 2.0, by_type=True)
    assert sum(len(re.findall(r"gene#\d+,value#\d+\] parquet", p)) for p in plans) <= 4
    assert found.select("cell_type", "gene_center", "gene_motif").distinct().count() == found.count() == 18


def test_small_joins_make_few_parts(spark, cloud):
    """The parts asked for hold below the session's shuffle partitions too."""
    rows, cells = cloud
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = nb.radius_join(cells, 2.0, n=3)
        assert found.rdd.getNumPartitions() == 3 and {(r.center_id, r.neighbor_id) for r in found.collect()} == near(rows, 2.0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_nearest_is_brute_force_over_uneven_places(spark):
    """Cells that the first rounds leave over keep their places for the next."""
    rng = random.Random(8)
    rows = [("d", f"f{i % 2}", i, "A", rng.gauss(0, 1) * 10 ** (i % 5), rng.gauss(0, 1) * 10 ** (i % 5)) for i in range(300)]
    want = {a[2]: min((a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2 for b in rows if a[1] == b[1] and a[2] != b[2]) for a in rows}
    got = {r.cell_id: r.dist2 for r in nb.nearest_distance(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
