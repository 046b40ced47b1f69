"""Every query on the spatial operators over the order tables, and its SQL.

CT is the label of centres, MOTIF a set of labels, R a radius in mean nearest distances, FOV the field of view of the
queries whose operator takes a single one. Doubles are rounded to six
places on both sides, arrays are joined to strings."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import stats
from loomfield.operators import covariation as cov
from loomfield.operators import enrichment as enr
from loomfield.operators import expression as exp
from loomfield.operators import geneindex as gi
from loomfield.operators import neighbors as nb
from loomfield.operators import patterns as pat
from loomfield.operators import summary
from loomfield.sources import tables

CT, MOTIF, R = "5-LOW", ["1-URGENT", "2-HIGH"], 3.0
MOTIFS = [["1-URGENT", "2-HIGH"], ["3-MEDIUM"], ["1-URGENT", "3-MEDIUM", "5-LOW"], ["2-HIGH", "4-NOT SPECIFIED"]]
ITEMS4 = ["Brand#11", "Brand#12", "Brand#13", "Brand#21"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
FOV = "NATION_7"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PRELUDE = f"""WITH raw AS (
  SELECT o_orderkey AS cell_id, r_name AS dataset, n_name AS fov, o_orderpriority AS label,
    CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS DOUBLE) AS x0, o_totalprice / 200 AS y0
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
nn AS (SELECT a.fov, a.cell_id, min((a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0)) AS d2
  FROM raw a JOIN raw b ON a.fov = b.fov AND a.cell_id <> b.cell_id GROUP BY ALL),
sc AS (SELECT fov, 1 / avg(sqrt(d2)) AS s FROM nn GROUP BY fov),
cells AS MATERIALIZED (SELECT dataset, raw.fov, cell_id, label, x0 * s AS x, y0 * s AS y FROM raw JOIN sc ON raw.fov = sc.fov),
expr AS (SELECT dataset, fov, cell_id, label, p_brand AS gene, sum(l_quantity) AS value
  FROM raw JOIN lineitem ON l_orderkey = cell_id JOIN part ON l_partkey = p_partkey GROUP BY ALL),
near AS (SELECT a.dataset, a.fov, a.cell_id AS center_id, a.label AS center_label, b.cell_id AS neighbor_id, b.label AS neighbor_label,
    (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS dist2
  FROM cells a JOIN cells b ON a.fov = b.fov AND a.cell_id <> b.cell_id),
pairs AS (SELECT * FROM near WHERE dist2 <= {R * R}),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fov, center_id ORDER BY dist2, neighbor_id) AS nth FROM near WHERE dist2 <= 25) WHERE nth <= 5),
sets AS (SELECT dataset, fov, center_id, center_label, list_sort(list(DISTINCT neighbor_label)) AS labels, count(*) AS size FROM pairs GROUP BY ALL)"""


def _q(name: str, sql: str | None = None, fov: str | None = None):
    """Registers a query, and its SQL after the common prelude, over one field of view where one is named."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            prelude = PRELUDE.replace("FROM raw JOIN", f"FROM (SELECT * FROM raw WHERE fov = '{fov}') AS raw JOIN") if fov else PRELUDE
            ORACLES[name] = (prelude + ",\n" if sql.lstrip().startswith("+") else prelude + "\n") + sql.lstrip().removeprefix("+")
        return f

    return add


_HELD: dict[tuple[str, str, str], DataFrame] = {}


def _held(spark: SparkSession, d: str, name: str, make) -> DataFrame:
    """A table that many queries start from, written once an application."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _HELD or not tables.exists(spark, _HELD[key].inputFiles()[0]):
        _HELD[key] = make()
    return _HELD[key]


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return _held(spark, d, "raw", lambda: tables.written(tables.orders_as_cells(spark, d), "points"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    return _held(spark, d, "cells", lambda: nb.normalize(_raw(spark, d)))


def expr(spark: SparkSession, d: str) -> DataFrame:
    return _held(spark, d, "expr", lambda: tables.written(tables.expression(tables.orders_as_expression(spark, d), _raw(spark, d), repeated=False), "expression"))


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _joined(column: str | Column, sep: str = "+") -> Column:
    return F.array_join(column, sep)


def _sql_list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


MOTIF_SQL = _sql_list(MOTIF)
MOTIFS_SQL = "(VALUES " + ", ".join(f"({_sql_list(sorted(m))})" for m in MOTIFS) + ") AS m(motif)"

# Sources


@_q("s1_load_cells", "SELECT dataset, fov, cell_id, label, round(x, 6) AS x, round(y, 6) AS y FROM cells")
def s1(spark, d):
    return _r(cells(spark, d), "x", "y")


@_q("s2_number_fovs", "SELECT dataset, fov, CAST(row_number() OVER (PARTITION BY dataset ORDER BY fov) - 1 AS INTEGER) AS fov_no, replace(dataset, '_', '-') || '_' || (row_number() OVER (PARTITION BY dataset ORDER BY fov) - 1) AS fov_name FROM (SELECT DISTINCT dataset, fov FROM raw)")
def s2(spark, d):
    return tables.number_fovs(tables.orders_as_cells(spark, d).select("dataset", "fov").distinct())


PHI = "CASE WHEN {z} = 0 THEN 0.5 WHEN abs({z}) > 7 THEN CASE WHEN {z} > 0 THEN 1 ELSE 0 END ELSE 0.5 + 0.5 * sign({z}) * list_sum(list_transform(range(400), lambda n: exp((2 * n + 1) * ln(abs({z}) / sqrt(2)) - {z} * {z} / 2 - lgamma(n + 1.5)))) END"
ZS = "zs AS (SELECT fov, gene, cell_id, value, mu, sigma, coalesce((ln(value) - mu) / nullif(sigma, 0), 0) AS z FROM (SELECT *, avg(ln(value)) OVER w AS mu, coalesce(stddev_samp(ln(value)) OVER w, 0) AS sigma FROM expr WINDOW w AS (PARTITION BY fov, gene)))"
BUCKETS = ZS + ", bk AS (SELECT *, CAST(least(3, floor(4 * (" + PHI.format(z="z") + ") + 1e-12)) AS INTEGER) AS bucket FROM zs)"
INDEX_SQL = "+ " + BUCKETS + " SELECT fov, gene, string_agg(CAST(cell_id AS VARCHAR), ',' ORDER BY cell_id) AS cell_ids, string_agg(CAST(bucket AS VARCHAR), ',' ORDER BY cell_id) AS quantiles, count(*) AS n_cells, round(avg(ln(value)), 6) AS mu, round(coalesce(stddev_samp(ln(value)), 0), 6) AS sigma FROM bk GROUP BY ALL"


@_q("s4_build_index", INDEX_SQL)
def s4(spark, d):
    out = gi.build(expr(spark, d)).withColumns({c: _joined(F.col(c).cast("array<string>"), ",") for c in ("cell_ids", "quantiles")})
    return _r(out.drop("bits"), "mu", "sigma")


@_q("s9_save_and_load", INDEX_SQL)
def s9(spark, d):
    path = f"{tables.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    tables.save(gi.build(expr(spark, d)), path)
    out = tables.load(spark, path).withColumns({c: _joined(F.col(c).cast("array<string>"), ",") for c in ("cell_ids", "quantiles")})
    return _r(out.drop("bits"), "mu", "sigma")


@_q("s10_merge", "SELECT fov, gene, count(*) AS n_cells FROM expr GROUP BY ALL")
def s10(spark, d):
    e = expr(spark, d)
    return gi.merge(gi.build(e.where(F.col("dataset") == "ASIA")), gi.build(e.where(F.col("dataset") != "ASIA"))).select("fov", "gene", "n_cells")


@_q("s11_index_rows", "SELECT fov, gene, cell_id FROM expr")
def s11(spark, d):
    return gi.cells_of(gi.build(expr(spark, d)))


@_q("s7_quantize", "+ " + BUCKETS + " SELECT fov, gene, cell_id, bucket FROM bk")
def s7(spark, d):
    return gi.quantize(expr(spark, d)).select("fov", "gene", "cell_id", "bucket")


#: z at which the normal distribution has an eighth, three, five and seven.
MIDDLES = [-1.1503493803760083, -0.31863936396437514, 0.31863936396437514, 1.1503493803760083]


@_q("x9_expression_of_index", "+ " + BUCKETS + f" SELECT fov, gene, cell_id, round(exp(mu + sigma * {MIDDLES}[bucket + 1]), 6) AS value FROM bk")
def x9(spark, d):
    return _r(gi.expression_of(gi.build(expr(spark, d))), "value")


@_q("s14_posting", "+ no AS (SELECT gene, fov, row_number() OVER (ORDER BY gene, fov) - 1 AS n FROM (SELECT DISTINCT gene, fov FROM expr)) SELECT fov, gene, cell_id FROM expr JOIN no USING (gene, fov) WHERE n = 7")
def s14(spark, d):
    return gi.posting(gi.build(expr(spark, d)), 7)


@_q("x10_genes_by_cell", "SELECT fov, cell_id, string_agg(gene, ',' ORDER BY gene) AS genes FROM expr WHERE gene IN ('Brand#11', 'Brand#12', 'Brand#55') GROUP BY ALL")
def x10(spark, d):
    return gi.genes_by_cell(gi.build(expr(spark, d)), ["Brand#11", "brand#12", "BRAND#55"])


@_q("j12_concat_outer", "SELECT dataset, gene, count(*) AS n FROM expr GROUP BY ALL")
def j12(spark, d):
    parts = [tables.of_datasets(expr(spark, d), r) for r in REGIONS]
    return tables.concat(parts, outer=True).groupBy("dataset", "gene").agg(F.count("*").alias("n"))


@_q("s12_binary_matrix", "SELECT fov, cell_id, gene FROM expr WHERE gene IN (SELECT gene FROM expr GROUP BY gene HAVING count(*) >= 10)")
def s12(spark, d):
    own = expr(spark, d)
    return own.join(exp.frequent_genes(own), "gene", "left_semi").select("fov", "cell_id", "gene")


@_q("s6_lognormalize", "+ tot AS (SELECT fov, cell_id, sum(value) AS t FROM expr GROUP BY ALL), med AS (SELECT fov, median(t) AS m FROM tot GROUP BY fov) SELECT e.fov, e.cell_id, gene, round(ln(1 + value / t * m), 6) AS value FROM expr e JOIN tot ON e.fov = tot.fov AND e.cell_id = tot.cell_id JOIN med ON med.fov = e.fov")
def s6(spark, d):
    return _r(exp.lognormalize(expr(spark, d)).select("fov", "cell_id", "gene", "value"), "value")


# Joins


@_q("j1_radius_join", "SELECT fov, center_id, neighbor_id, round(dist2, 6) AS dist2 FROM pairs")
def j1(spark, d):
    return _r(nb.radius_join(cells(spark, d), R).select("fov", "center_id", "neighbor_id", "dist2"), "dist2")


@_q("j2_knn_join", "SELECT fov, center_id, neighbor_id, CAST(nth AS INTEGER) AS nth FROM knn")
def j2(spark, d):
    return nb.knn_join(cells(spark, d), 5, 5.0).select("fov", "center_id", "neighbor_id", "nth")


@_q("j3_nearest", "SELECT fov, cell_id, round(sqrt(d2), 6) AS dist FROM nn")
def j3(spark, d):
    return nb.nearest_distance(tables.orders_as_cells(spark, d)).select("fov", "cell_id", F.round(F.sqrt("dist2"), 6).alias("dist"))


GRID_SQL = """+ box AS (SELECT dataset, fov, min(x) - 5 AS x0, min(y) - 5 AS y0, CAST(ceil((max(x) + 5 - (min(x) - 5)) / 5) AS BIGINT) AS nx, CAST(ceil((max(y) + 5 - (min(y) - 5)) / 5) AS BIGINT) AS ny FROM cells GROUP BY ALL),
gx AS (SELECT *, unnest(range(nx)) AS i FROM box), gxy AS (SELECT *, unnest(range(ny)) AS j FROM gx),
probes AS (SELECT dataset, fov, i * ny + j AS probe_id, x0 + i * 5.0::DOUBLE AS px, y0 + j * 5.0::DOUBLE AS py FROM gxy),
hits AS (SELECT p.dataset, p.fov, probe_id AS center_id, cell_id AS neighbor_id, label AS neighbor_label FROM probes p JOIN cells c ON c.fov = p.fov WHERE (px - x) * (px - x) + (py - y) * (py - y) <= 25)"""


@_q("j4_probe_grid", GRID_SQL + " SELECT fov, center_id AS probe_id, count(*) AS n FROM hits GROUP BY ALL")
def j4(spark, d):
    c = cells(spark, d)
    return nb.probe_join(c, 5.0, 5.0).groupBy("fov", F.col("center_id").alias("probe_id")).agg(F.count("*").alias("n"))


def _units(n: int = 1000, seed: int = 2023) -> str:
    state = np.random.RandomState(seed)
    return ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, x, y in zip(range(n), state.random_sample(n).tolist(), state.random_sample(n).tolist(), strict=True))


RANDOM_SQL = f"""+ unit AS (SELECT * FROM (VALUES {_units()}) AS u(probe_id, ux, uy)),
box AS (SELECT dataset, fov, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells GROUP BY ALL),
probes AS (SELECT dataset, fov, CAST(probe_id AS BIGINT) AS probe_id, x0 + ux * (x1 - x0) AS px, y0 + uy * (y1 - y0) AS py FROM box, unit),
hits AS (SELECT p.dataset, p.fov, probe_id AS center_id, cell_id AS neighbor_id, label AS neighbor_label FROM probes p JOIN cells c ON c.fov = p.fov WHERE (px - x) * (px - x) + (py - y) * (py - y) <= 25)"""


@_q("j4_probe_random", RANDOM_SQL + " SELECT fov, center_id AS probe_id, count(*) AS n FROM hits GROUP BY ALL")
def j4_random(spark, d):
    c = cells(spark, d)
    return nb.probe_join(c, nb.random_probes(c), 5.0).groupBy("fov", F.col("center_id").alias("probe_id")).agg(F.count("*").alias("n"))


QUALIFY = f"SELECT fov, center_id FROM sets WHERE center_label = '{CT}' AND len(list_intersect(labels, {MOTIF_SQL})) = {len(MOTIF)}"
J5 = f"""+ mp AS (SELECT p.dataset, p.fov, p.center_id, neighbor_id, neighbor_label FROM pairs p JOIN ({QUALIFY}) q ON p.fov = q.fov AND p.center_id = q.center_id WHERE list_contains({MOTIF_SQL}, neighbor_label)),
op AS (SELECT * FROM pairs p WHERE center_label = '{CT}' AND neighbor_label <> '{CT}' AND NOT EXISTS (SELECT 1 FROM mp WHERE mp.fov = p.fov AND mp.center_id = p.center_id) AND NOT EXISTS (SELECT 1 FROM mp WHERE mp.fov = p.fov AND mp.neighbor_id = p.neighbor_id)),
far AS (SELECT fov, cell_id, label FROM cells c WHERE list_contains({MOTIF_SQL}, label) AND label <> '{CT}' AND NOT EXISTS (SELECT 1 FROM mp WHERE mp.fov = c.fov AND mp.neighbor_id = c.cell_id))"""


@_q("j5_motif_pairs", J5 + " SELECT fov, center_id, neighbor_id FROM mp")
def j5(spark, d):
    return cov.motif_pairs(cells(spark, d), CT, MOTIF, R).select("fov", "center_id", "neighbor_id")


@_q("j5_motif_pairs_own_label", f"""+ q AS (SELECT fov, center_id FROM sets WHERE center_label = '{CT}' AND len(list_intersect(labels, ['1-URGENT', '{CT}'])) = 2),
b AS (SELECT p.fov, p.center_id, neighbor_id, neighbor_label FROM pairs p JOIN q ON p.fov = q.fov AND p.center_id = q.center_id WHERE neighbor_label IN ('1-URGENT', '{CT}'))
SELECT fov, center_id, neighbor_id FROM b WHERE neighbor_label <> '{CT}'
UNION SELECT s.fov, s.neighbor_id, o.neighbor_id FROM b s JOIN b o ON s.fov = o.fov AND s.center_id = o.center_id WHERE s.neighbor_label = '{CT}' AND o.neighbor_label <> '{CT}'""")
def j5_own(spark, d):
    return cov.motif_pairs(cells(spark, d), CT, ["1-URGENT", CT], R).select("fov", "center_id", "neighbor_id")


@_q("j6_other_pairs", J5 + " SELECT fov, center_id, neighbor_id FROM op")
def j6(spark, d):
    c = cells(spark, d)
    return cov.other_pairs(c, CT, cov.motif_pairs(c, CT, MOTIF, R), R).select("fov", "center_id", "neighbor_id")


@_q("j7_distant_cells", J5 + " SELECT fov, cell_id, label FROM far")
def j7(spark, d):
    c = cells(spark, d)
    return cov.distant_cells(c, CT, MOTIF, cov.motif_pairs(c, CT, MOTIF, R))


# Label sets


@_q("a1_label_counts", "SELECT fov, center_id, neighbor_label, count(*) AS n FROM pairs GROUP BY ALL")
def a1(spark, d):
    return pat.label_counts(nb.radius_join(cells(spark, d), R)).drop("dataset")


@_q("a2_transactions", "SELECT fov, center_id, array_to_string(labels, '+') AS labels, size FROM sets WHERE size > 2")
def a2(spark, d):
    return pat.transactions(nb.radius_join(cells(spark, d), R), 2).select("fov", "center_id", _joined("labels").alias("labels"), "size")


LABELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
LABELS_SQL = _sql_list(LABELS)


def _mine_sql(source: str, support: float, by: str = "", maximal: bool = True) -> str:
    """Frequent sets of `source` (labels), by enumeration of the 31 label sets."""
    g, on = (f"{by}, ", f" AND a.{by} = b.{by}") if by else ("", "")
    inner = f"""all_sets AS (SELECT list_filter({LABELS_SQL}, lambda x, i: (n >> (i - 1)) & 1 = 1) AS itemset FROM range(1, 32) AS t(n)),
src AS ({source}), tot AS (SELECT {g}count(*) AS total FROM src {"GROUP BY " + by if by else ""}),
cnt AS (SELECT {g}itemset, count(*) AS freq FROM src, all_sets WHERE len(list_intersect(labels, itemset)) = len(itemset) GROUP BY ALL),
frq AS (SELECT {"cnt." + by + ", " if by else ""}itemset, freq, freq / total AS support FROM cnt {"JOIN tot USING (" + by + ")" if by else ", tot"} WHERE freq / total >= {support})"""
    out = f"SELECT {g}array_to_string(itemset, '+') AS itemset, freq, round(support, 6) AS support FROM frq a"
    if maximal:
        out += f" WHERE NOT EXISTS (SELECT 1 FROM frq b WHERE len(b.itemset) > len(a.itemset) AND len(list_intersect(a.itemset, b.itemset)) = len(a.itemset){on})"
    return inner + " " + out


def _patterns(df: DataFrame) -> DataFrame:
    return _r(df.withColumn("itemset", _joined("itemset")), "support")


CENTERS = f"SELECT * FROM sets WHERE center_label = '{CT}'"


@_q("a3_frequent_sets", "+" + _mine_sql(CENTERS, 0.3, maximal=False))
def a3(spark, d):
    return _patterns(pat.mine(enr.center_sets(cells(spark, d), CT, R, None), 0.3))


@_q("a4_fp_dist", "+" + _mine_sql(CENTERS, 0.3))
def a4(spark, d):
    return _patterns(enr.mined(cells(spark, d), CT, R, min_support=0.3))


@_q("a4_fp_knn", "+" + _mine_sql(f"SELECT c.cell_id, list(DISTINCT neighbor_label) FILTER (neighbor_label IS NOT NULL) AS labels FROM cells c LEFT JOIN (SELECT * FROM knn WHERE dist2 < 25) k ON k.fov = c.fov AND k.center_id = c.cell_id WHERE c.label = '{CT}' GROUP BY c.cell_id", 0.3))
def a4_knn(spark, d):
    return _patterns(enr.mined(cells(spark, d), CT, 5.0, k=5, min_support=0.3))


HIT_SETS = "SELECT fov, center_id, list(DISTINCT neighbor_label) AS labels FROM hits GROUP BY ALL"


@_q("a5_patterns_grid", GRID_SQL + ", " + _mine_sql(HIT_SETS, 0.5))
def a5(spark, d):
    c = cells(spark, d)
    return _patterns(pat.maximal(pat.mine(pat.transactions(nb.probe_join(c, 5.0, 5.0)), 0.5)))


@_q("a6_patterns_random", RANDOM_SQL + ", " + _mine_sql(HIT_SETS, 0.5))
def a6(spark, d):
    c = cells(spark, d)
    return _patterns(pat.maximal(pat.mine(pat.transactions(nb.probe_join(c, nb.random_probes(c), 5.0)), 0.5)))


@_q("a7_maximal_of_any", f"+ l AS (SELECT DISTINCT labels FROM sets WHERE center_label = '{CT}') SELECT array_to_string(labels, '+') AS itemset FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE len(b.labels) > len(a.labels) AND len(list_intersect(a.labels, b.labels)) = len(a.labels))")
def a7(spark, d):
    own = enr.center_sets(cells(spark, d), CT, R, None).select(F.col("labels").alias("itemset")).distinct()
    return pat.maximal_of_any(own).select(_joined("itemset").alias("itemset"))


@_q("a9_fp_dist_fov", "+" + _mine_sql(CENTERS, 0.4, "fov"))
def a9(spark, d):
    return _patterns(enr.mined(cells(spark, d), CT, R, min_support=0.4, by=["fov"]))


@_q("a9_fp_knn_fov", "+" + _mine_sql(f"SELECT c.fov, c.cell_id, list(DISTINCT neighbor_label) FILTER (neighbor_label IS NOT NULL) AS labels FROM cells c LEFT JOIN (SELECT * FROM knn WHERE dist2 < 25) k ON k.fov = c.fov AND k.center_id = c.cell_id WHERE c.label = '{CT}' GROUP BY ALL", 0.4, "fov"))
def a9_knn(spark, d):
    return _patterns(enr.mined(cells(spark, d), CT, 5.0, k=5, min_support=0.4, by=["fov"]))


@_q("a10_pattern_cells", "+" + _mine_sql(CENTERS, 0.3).replace("SELECT array_to_string(itemset, '+') AS itemset, freq, round(support, 6) AS support FROM frq a", ", top AS (SELECT itemset FROM frq a") + f") SELECT array_to_string(itemset, '+') AS itemset, string_agg(DISTINCT CAST(neighbor_id AS VARCHAR), ',' ORDER BY CAST(neighbor_id AS VARCHAR)) AS ids FROM top, src s JOIN pairs p ON p.fov = s.fov AND p.center_id = s.center_id WHERE len(list_intersect(labels, itemset)) = len(itemset) AND list_contains(itemset, neighbor_label) GROUP BY itemset")
def a10(spark, d):
    c = cells(spark, d)
    pairs = nb.radius_join(c, R, c.where(F.col("label") == CT))
    sets = pat.transactions(pairs)
    out = pat.behind(pat.maximal(pat.mine(sets, 0.3)), sets, pairs)
    return out.select(_joined("itemset").alias("itemset"), _joined(F.sort_array(F.col("neighbor_ids").cast("array<string>")), ",").alias("ids"))


SUPPORT_SQL = f"""+ motifs AS (SELECT motif FROM {MOTIFS_SQL}), n AS (SELECT dataset, fov, count(*) FILTER (label = '{CT}') AS n FROM cells GROUP BY ALL),
h AS (SELECT fov, motif, count(*) AS hits FROM sets, motifs WHERE center_label = '{CT}' AND len(list_intersect(labels, motif)) = len(motif) GROUP BY ALL),
sup AS (SELECT dataset, n.fov, motifs.motif, CASE WHEN n > 0 THEN coalesce(hits, 0) / n ELSE 0 END AS support FROM n CROSS JOIN motifs LEFT JOIN h ON h.fov = n.fov AND h.motif = motifs.motif)"""


@_q("a11_motif_support", SUPPORT_SQL + " SELECT dataset, fov, array_to_string(motif, '+') AS itemset, round(support, 6) AS support FROM sup")
def a11(spark, d):
    return _patterns(enr.motif_supports(cells(spark, d), CT, enr._motifs(spark, MOTIFS), R))


@_q("a14_label_distribution", "SELECT dataset, label, n, round(n / sum(n) OVER (PARTITION BY dataset), 6) AS proportion FROM (SELECT dataset, label, count(*) AS n FROM raw GROUP BY ALL)")
def a14(spark, d):
    return _r(summary.label_distribution(tables.orders_as_cells(spark, d)), "proportion")


@_q("a14_label_matrix", "SELECT label, " + ", ".join(f"count(*) FILTER (dataset = '{r}') AS \"{r}\"" for r in REGIONS) + ", count(*) AS total FROM raw GROUP BY label")
def a14_matrix(spark, d):
    return summary.label_matrix(tables.orders_as_cells(spark, d))


@_q("a15_niche_composition", f"+ q AS ({QUALIFY}), k AS (SELECT p.fov, p.center_id, neighbor_label AS label, count(*) AS n FROM pairs p JOIN q ON p.fov = q.fov AND p.center_id = q.center_id GROUP BY ALL), n AS (SELECT *, n / sum(n) OVER (PARTITION BY fov, center_id) AS proportion FROM k) SELECT fov, center_id, label, round(proportion, 6) AS proportion FROM n WHERE list_contains({MOTIF_SQL}, label)")
def a15(spark, d):
    return _r(summary.niche_composition(cells(spark, d), CT, MOTIF, R), "proportion")


# Enrichment

ENRICHED = f"""cnt AS (SELECT motif, count(*) AS n_motif, count(*) FILTER (center_label = '{CT}') AS n_center_motif FROM ss, {MOTIFS_SQL} WHERE len(list_intersect(labels, motif)) = len(motif) GROUP BY motif),
tt AS (SELECT count(*) AS n_cells, count(*) FILTER (label = '{CT}') AS n_center FROM cc),
e AS (SELECT motif, n_center_motif, n_center, n_motif, n_cells, n_center * n_motif / n_cells AS expectation,
  coalesce((SELECT sum(exp(lgamma(n_center + 1) - lgamma(i + 1) - lgamma(n_center - i + 1) + lgamma(n_cells - n_center + 1) - lgamma(n_motif - i + 1) - lgamma(n_cells - n_center - n_motif + i + 1) - lgamma(n_cells + 1) + lgamma(n_motif + 1) + lgamma(n_cells - n_motif + 1)))
    FROM range(n_center_motif + 1, least(n_center, n_motif) + 1) AS t(i) WHERE n_motif - i <= n_cells - n_center), 0) AS p FROM cnt, tt),
rk AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS raw FROM e)
SELECT array_to_string(motif, '+') AS motif, n_center_motif, n_center, n_motif, n_cells, round(expectation, 6) AS expectation, round(p, 6) AS p_value, round(least(1, min(raw) OVER (ORDER BY p DESC)), 6) AS adj_p_value FROM rk"""


def _enriched(df: DataFrame) -> DataFrame:
    return _r(df.withColumn("motif", _joined("motif")).drop("center", "if_significant"), "expectation", "p_value", "adj_p_value")


@_q("t1_enrichment_fov", f"+ ss AS (SELECT * FROM sets WHERE fov = '{FOV}'), cc AS (SELECT * FROM cells WHERE fov = '{FOV}'), " + ENRICHED)
def t1(spark, d):
    return _enriched(enr.enrichment(cells(spark, d).where(F.col("fov") == FOV), CT, MOTIFS, R))


@_q("t1_enrichment_cells", f"+ q AS ({QUALIFY}), i AS (SELECT fov, string_agg(CAST(center_id AS VARCHAR), ',' ORDER BY center_id) AS center_ids FROM q GROUP BY fov), n AS (SELECT fov, string_agg(CAST(neighbor_id AS VARCHAR), ',' ORDER BY neighbor_id) AS neighbor_ids FROM (SELECT DISTINCT p.fov, neighbor_id FROM pairs p JOIN q ON p.fov = q.fov AND p.center_id = q.center_id WHERE list_contains({MOTIF_SQL}, neighbor_label)) GROUP BY fov) SELECT f.fov, coalesce(center_ids, '') AS center_ids, coalesce(neighbor_ids, '') AS neighbor_ids FROM (SELECT DISTINCT fov FROM cells) f LEFT JOIN i ON i.fov = f.fov LEFT JOIN n ON n.fov = f.fov")
def t1_cells(spark, d):
    out = enr.enrichment_cells(cells(spark, d), CT, MOTIF, R)
    return out.select("fov", *[_joined(F.col(c).cast("array<string>"), ",").alias(c) for c in ("center_ids", "neighbor_ids")])


@_q("t2_enrichment_dist", "+ ss AS (SELECT * FROM sets), cc AS (SELECT * FROM cells), " + ENRICHED)
def t2(spark, d):
    return _enriched(enr.enrichment(cells(spark, d), CT, MOTIFS, R))


@_q("t2_enrichment_knn", "+ ss AS (SELECT fov, center_id, center_label, list(DISTINCT neighbor_label) AS labels FROM knn GROUP BY ALL), cc AS (SELECT * FROM cells), " + ENRICHED)
def t2_knn(spark, d):
    return _enriched(enr.enrichment(cells(spark, d), CT, MOTIFS, 5.0, k=5))


DIFFERENTIAL = SUPPORT_SQL + """, own AS (SELECT * FROM sup WHERE dataset IN ('ASIA', 'EUROPE')),
rk AS (SELECT *, rank() OVER (PARTITION BY motif ORDER BY support) + (count(*) OVER (PARTITION BY motif, support) - 1) / 2 AS r FROM own)
SELECT array_to_string(motif, '+') AS itemset, round(avg(support) FILTER (dataset = 'ASIA'), 6) AS mean_1, round(avg(support) FILTER (dataset = 'EUROPE'), 6) AS mean_2,
  median(r) FILTER (dataset = 'ASIA') AS median_rank_1, median(r) FILTER (dataset = 'EUROPE') AS median_rank_2,
  CASE WHEN median(r) FILTER (dataset = 'ASIA') > median(r) FILTER (dataset = 'EUROPE') THEN 'ASIA' ELSE 'EUROPE' END AS higher FROM rk GROUP BY motif"""


def _differential(spark, d):
    return _r(enr.differential(cells(spark, d), CT, ["ASIA", "EUROPE"], MOTIFS, R).withColumn("itemset", _joined("itemset")), "mean_1", "mean_2", "p_value", "adj_p_value")


@_q("t4_differential_supports", DIFFERENTIAL)
def t4(spark, d):
    return _differential(spark, d).drop("p_value", "adj_p_value", "if_significant")


def _whitney_sql(own: str) -> str:
    """The Mann-Whitney test over two datasets of five fields of view each: by enumeration of the 252 ways to rank them,
    or where supports tie by the normal approximation."""
    z = "(u - 13) / nullif(sqrt(25.0 / 12 * (11 - ties / 90)), 0)"
    return own + """,
mw AS (SELECT motif, avg(support) FILTER (dataset = 'ASIA') AS a1, avg(support) FILTER (dataset = 'EUROPE') AS a2, median(r) FILTER (dataset = 'ASIA') AS k1, median(r) FILTER (dataset = 'EUROPE') AS k2,
  greatest(sum(r) FILTER (dataset = 'ASIA') - 15, 40 - sum(r) FILTER (dataset = 'ASIA')) AS u, sum(m * m - 1) AS ties FROM (SELECT *, count(*) OVER (PARTITION BY motif, support) AS m FROM rk) GROUP BY motif),
us AS (SELECT list_sum(list_filter(range(1, 11), lambda i: (n >> (i - 1)) & 1 = 1)) - 15 AS u FROM range(1024) AS t(n) WHERE bit_count(n) = 5),
mz AS (SELECT *, coalesce(""" + z + """, 0) AS z FROM mw),
mp4 AS (SELECT *, CASE WHEN ties = 0 THEN least(1, 2 * (SELECT count(*) FROM us WHERE us.u >= mz.u) / 252) WHEN ties = 990 THEN 1 ELSE least(1, 2 * (1 - (""" + PHI.format(z="z") + """))) END AS p FROM mz),
rw AS (SELECT *, round(p, 12) AS rp, p * count(*) OVER () / count(*) OVER (ORDER BY round(p, 12)) AS raw FROM mp4)
SELECT array_to_string(motif, '+') AS itemset, round(a1, 6) AS mean_1, round(a2, 6) AS mean_2, k1 AS median_rank_1, k2 AS median_rank_2, round(p, 6) AS p_value, CASE WHEN k1 > k2 THEN 'ASIA' ELSE 'EUROPE' END AS higher,
  round(least(1, min(raw) OVER (ORDER BY rp DESC)), 6) AS adj_p_value, least(1, min(raw) OVER (ORDER BY rp DESC)) < 0.05 AS if_significant FROM rw"""


@_q("t4_differential_tests", _whitney_sql(DIFFERENTIAL.rsplit("\nSELECT", 1)[0]))
def t4_tests(spark, d):
    return _differential(spark, d)


KNN_SETS = f"""ks AS (SELECT fov, center_id, list(DISTINCT neighbor_label) AS labels, list(DISTINCT neighbor_label) FILTER (dist2 < 25) AS inner_labels FROM knn JOIN (SELECT DISTINCT dataset AS own FROM raw WHERE dataset IN ('ASIA', 'EUROPE')) ON own = dataset WHERE center_label = '{CT}' GROUP BY ALL),
kc AS (SELECT dataset, fov, cell_id FROM cells WHERE label = '{CT}' AND dataset IN ('ASIA', 'EUROPE')),
kl AS (SELECT list_filter({LABELS_SQL}, lambda x, i: (n >> (i - 1)) & 1 = 1) AS itemset FROM range(1, 32) AS t(n)),
kf AS (SELECT kc.fov, itemset FROM kc LEFT JOIN ks ON ks.fov = kc.fov AND ks.center_id = kc.cell_id CROSS JOIN kl GROUP BY ALL HAVING count(*) FILTER (len(list_intersect(inner_labels, itemset)) = len(itemset)) / count(*) >= 0.4),
motifs AS (SELECT DISTINCT itemset AS motif FROM kf a WHERE NOT EXISTS (SELECT 1 FROM kf b WHERE b.fov = a.fov AND len(b.itemset) > len(a.itemset) AND len(list_intersect(a.itemset, b.itemset)) = len(a.itemset))),
kn AS (SELECT dataset, fov, count(*) AS n FROM kc GROUP BY ALL),
kh AS (SELECT fov, motif, count(*) AS hits FROM ks, motifs WHERE len(list_intersect(labels, motif)) = len(motif) GROUP BY ALL),
own AS (SELECT dataset, kn.fov, motifs.motif, coalesce(hits, 0) / n AS support FROM kn CROSS JOIN motifs LEFT JOIN kh ON kh.fov = kn.fov AND kh.motif = motifs.motif),
rk AS (SELECT *, rank() OVER (PARTITION BY motif ORDER BY support) + (count(*) OVER (PARTITION BY motif, support) - 1) / 2 AS r FROM own)"""


@_q("t4_differential_knn", "+ " + _whitney_sql(KNN_SETS))
def t4_knn(spark, d):
    return _r(enr.differential(cells(spark, d), CT, ["ASIA", "EUROPE"], None, 5.0, k=5, min_support=0.4).withColumn("itemset", _joined("itemset")), "mean_1", "mean_2", "p_value", "adj_p_value")


# Expression


@_q("a12_label_means", "SELECT e.fov, e.label, gene, round(sum(value) / max(n), 6) AS mean FROM expr e JOIN (SELECT fov, label, count(*) AS n FROM raw GROUP BY ALL) c ON c.fov = e.fov AND c.label = e.label GROUP BY ALL")
def a12(spark, d):
    return _r(exp.label_means(expr(spark, d), tables.orders_as_cells(spark, d), ["fov"]), "mean")


def _groups(spark, d) -> DataFrame:
    return tables.orders_as_cells(spark, d).where(F.col("label").isin("1-URGENT", CT)).select("cell_id", F.when(F.col("label") == CT, 2).otherwise(1).alias("grp"))


GROUPS = f"""+ g AS (SELECT cell_id, CASE WHEN label = '{CT}' THEN 2 ELSE 1 END AS grp FROM raw WHERE label IN ('1-URGENT', '{CT}')),
gs AS (SELECT count(*) FILTER (grp = 1) AS n1, count(*) FILTER (grp = 2) AS n2 FROM g),
ec AS (SELECT gene, count(*) FILTER (grp = 1) AS e1, count(*) FILTER (grp = 2) AS e2, sum(CASE WHEN grp = 1 THEN value ELSE 0 END) AS s1, sum(CASE WHEN grp = 2 THEN value ELSE 0 END) AS s2, sum(CASE WHEN grp = 1 THEN value * value ELSE 0 END) AS q1, sum(CASE WHEN grp = 2 THEN value * value ELSE 0 END) AS q2 FROM expr e JOIN g USING (cell_id) GROUP BY gene),
pr AS (SELECT *, e1 / n1 AS p1, e2 / n2 AS p2 FROM ec, gs)"""


@_q("a13_expressing_counts", GROUPS + " SELECT gene, e1 AS expressed_cells_1, e2 AS expressed_cells_2 FROM ec")
def a13(spark, d):
    return exp.expressing_counts(expr(spark, d), _groups(spark, d))


FISHER = """, lp AS (SELECT *, lgamma(n1 + 1) - lgamma(e1 + 1) - lgamma(n1 - e1 + 1) + lgamma(n2 + 1) - lgamma(e2 + 1) - lgamma(n2 - e2 + 1) AS own FROM pr WHERE p1 >= 0.05 OR p2 >= 0.05),
fp AS (SELECT *, least(1, (SELECT sum(exp(t)) FROM (SELECT lgamma(n1 + 1) - lgamma(i + 1) - lgamma(n1 - i + 1) + lgamma(n2 + 1) - lgamma(e1 + e2 - i + 1) - lgamma(n2 - e1 - e2 + i + 1) - lgamma(n1 + n2 + 1) + lgamma(e1 + e2 + 1) + lgamma(n1 + n2 - e1 - e2 + 1) AS t FROM range(greatest(0, e1 + e2 - n2), least(n1, e1 + e2) + 1) AS r(i)) WHERE t <= own - lgamma(n1 + n2 + 1) + lgamma(e1 + e2 + 1) + lgamma(n1 + n2 - e1 - e2 + 1) + ln(1 + 1e-7))) AS p FROM lp),
bh AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY round(p, 12)) AS rw FROM fp)
SELECT gene, round(p1, 6) AS proportion_1, round(p2, 6) AS proportion_2, round(abs(p1 - p2), 6) AS abs_difference, e1 AS a, n1 - e1 AS b, e2 AS c, n2 - e2 AS d, round(p, 6) AS p_value, round(least(1, min(rw) OVER (ORDER BY round(p, 12) DESC)), 6) AS adj_p_value, CASE WHEN p1 >= p2 THEN 'group1' ELSE 'group2' END AS de_in FROM bh"""


def _fisher(df: DataFrame) -> DataFrame:
    kept = ["gene", "proportion_1", "proportion_2", "abs_difference", "a", "b", "c", "d", "p_value", "adj_p_value", "de_in"]
    return _r(df.select(kept), "proportion_1", "proportion_2", "abs_difference", "p_value", "adj_p_value")


@_q("t6_de_fisher", GROUPS + FISHER)
def t6(spark, d):
    return _fisher(exp.de_fisher(expr(spark, d), _groups(spark, d), alpha=None))


COMMON = GROUPS.replace("FROM expr e JOIN g", "FROM (SELECT * FROM expr WHERE gene IN (SELECT gene FROM expr GROUP BY gene HAVING count(DISTINCT fov) = (SELECT count(DISTINCT fov) FROM expr))) e JOIN g")


@_q("t8_de_fisher_many_fovs", COMMON + FISHER.replace("WHEN p1 >= p2 THEN 'group1' ELSE 'group2' END", "WHEN p1 > p2 THEN 'group1' WHEN p1 < p2 THEN 'group2' END"))
def t8(spark, d):
    return _fisher(exp.de_fisher(exp.common_genes(expr(spark, d)), _groups(spark, d), alpha=None, ties=None))


@_q("t7_de_fisher_index", GROUPS + FISHER + " WHERE least(1, p) <= 1")
def t7(spark, d):
    return _fisher(gi.de_fisher(gi.build(expr(spark, d)), _groups(spark, d), alpha=None))


BH = "least(1, min({raw}) OVER (ORDER BY {p} DESC))"
TWO_SIDED = "greatest(0, 2 * (1 - (" + PHI.format(z="abs({z})") + ")))"
FIGURES = "round(p, 6) AS p_value, round(" + BH.format(raw="raw", p="rp") + ", 6) AS adj_p_value, round(log2((exp(m1) - 1 + 1e-9) / (exp(m2) - 1 + 1e-9)), 6) AS log2fc, round(p1, 6) AS proportion_1, round(p2, 6) AS proportion_2, round(abs(p1 - p2), 6) AS abs_difference, CASE WHEN (exp(m1) - 1 + 1e-9) / (exp(m2) - 1 + 1e-9) >= 1 THEN 'group1' ELSE 'group2' END AS de_in"


@_q("t9_de_welch", GROUPS + """, v AS (SELECT *, s1 / n1 AS m1, s2 / n2 AS m2, (q1 - s1 * s1 / n1) / (n1 - 1) / n1 AS v1, (q2 - s2 * s2 / n2) / (n2 - 1) / n2 AS v2 FROM pr WHERE p1 >= 0.05 OR p2 >= 0.05)
SELECT gene, round((m1 - m2) / sqrt(v1 + v2), 6) AS t, round((v1 + v2) * (v1 + v2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)), 4) AS df, round(log2((exp(m1) - 1 + 1e-9) / (exp(m2) - 1 + 1e-9)), 6) AS log2fc FROM v""")
def t9(spark, d):
    return exp.de_welch(expr(spark, d), _groups(spark, d)).select("gene", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"), F.round("log2fc", 6).alias("log2fc"))


@_q("t9_de_wilcoxon", GROUPS + """, dense AS (SELECT k.gene, grp, coalesce(value, 0) AS v FROM (SELECT gene FROM pr WHERE p1 >= 0.05 OR p2 >= 0.05) k CROSS JOIN g LEFT JOIN expr e ON e.cell_id = g.cell_id AND e.gene = k.gene),
rk AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2 AS r, count(*) OVER (PARTITION BY gene, v) AS m FROM dense),
w AS (SELECT gene, sum(r) FILTER (grp = 1) AS rs, sum((m::DOUBLE * m * m - m) / m) AS ties, count(*)::DOUBLE AS n, count(*) FILTER (grp = 1)::DOUBLE AS a FROM rk GROUP BY gene)
SELECT gene, round(rs, 3) AS rank_sum, round((rs - a * (n + 1) / 2) / sqrt(a * (n - a) * (n + 1) / 12 * (1 - ties / (n * n * n - n))), 6) AS z FROM w""")
def t9_wilcoxon(spark, d):
    return exp.de_wilcoxon(expr(spark, d), _groups(spark, d)).select("gene", F.round("rank_sum", 3).alias("rank_sum"), F.round("z", 6).alias("z"))


WILCOXON = """, dense AS (SELECT k.gene, grp, coalesce(value, 0) AS v FROM (SELECT gene FROM pr WHERE p1 >= 0.05 OR p2 >= 0.05) k CROSS JOIN g LEFT JOIN expr e ON e.cell_id = g.cell_id AND e.gene = k.gene),
rk AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2 AS r, count(*) OVER (PARTITION BY gene, v) AS m FROM dense),
w AS (SELECT gene, sum(r) FILTER (grp = 1) AS rs, sum((m::DOUBLE * m * m - m) / m) AS ties, count(*)::DOUBLE AS n, count(*) FILTER (grp = 1)::DOUBLE AS a FROM rk GROUP BY gene),
wz AS (SELECT gene, (rs - a * (n + 1) / 2) / sqrt(a * (n - a) * (n + 1) / 12 * (1 - ties / (n * n * n - n))) AS z FROM w)"""
WELCH = """, v AS (SELECT *, s1 / n1 AS m1, s2 / n2 AS m2, (q1 - s1 * s1 / n1) / (n1 - 1) / n1 AS v1, (q2 - s2 * s2 / n2) / (n2 - 1) / n2 AS v2 FROM pr WHERE p1 >= 0.05 OR p2 >= 0.05),
tt AS (SELECT *, (m1 - m2) / sqrt(v1 + v2) AS t, (v1 + v2) * (v1 + v2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)) AS df FROM v),
ty AS (SELECT *, greatest(t * t / (df + t * t), 1e-300) AS y FROM tt),
tp AS (SELECT *, 1 - exp(0.5 * ln(y) + df / 2 * ln(1 - y) - ln(0.5) - lgamma(0.5) - lgamma(df / 2) + lgamma((df + 1) / 2)) * list_sum(list_transform(range(400), lambda n: exp(lgamma((df + 1) / 2 + n) - lgamma((df + 1) / 2) - lgamma(1.5 + n) + lgamma(1.5) + n * ln(y)))) AS p FROM ty)"""


@_q("t9_de_tests", GROUPS + WELCH + WILCOXON + ", wp AS (SELECT v.*, " + TWO_SIDED.format(z="z") + """ AS p FROM v JOIN wz USING (gene)),
al AS (SELECT 't-test' AS method, gene, m1, m2, p1, p2, p FROM tp UNION ALL SELECT 'wilcoxon', gene, m1, m2, p1, p2, p FROM wp),
rw AS (SELECT *, round(p, 10) AS rp, p * count(*) OVER (PARTITION BY method) / count(*) OVER (PARTITION BY method ORDER BY round(p, 10)) AS raw FROM al)
SELECT method, gene, """ + FIGURES.replace("OVER (ORDER", "OVER (PARTITION BY method ORDER") + " FROM rw")
def t9_tests(spark, d):
    kept = ["gene", "p_value", "adj_p_value", "log2fc", "proportion_1", "proportion_2", "abs_difference", "de_in"]
    e, g = expr(spark, d), _groups(spark, d)
    out = exp.de_welch(e, g).select(F.lit("t-test").alias("method"), *kept).unionByName(exp.de_wilcoxon(e, g).select(F.lit("wilcoxon").alias("method"), *kept))
    return _r(out, *kept[1:-1])


# Covariation: the SQL goes pair by pair, with zeros

DENSE = J5 + f""", gn AS (SELECT gene FROM expr GROUP BY gene HAVING count(*) >= 10),
mu AS (SELECT c.fov, c.label, gene, coalesce(s, 0) / n AS mean FROM (SELECT fov, label, count(*) AS n FROM cells GROUP BY ALL) c CROSS JOIN gn LEFT JOIN (SELECT fov, label, gene, sum(value) AS s FROM expr GROUP BY ALL) e USING (fov, label, gene)),
dv AS MATERIALIZED (SELECT c.fov, c.cell_id, c.label, mu.gene, coalesce(value, 0) - mean AS v, coalesce(value, 0) AS e FROM cells c JOIN mu ON mu.fov = c.fov AND mu.label = c.label LEFT JOIN expr x ON x.cell_id = c.cell_id AND x.gene = mu.gene)"""


def _paired_sql(name: str, source: str, key: str = "") -> str:
    k = f"p.{key}, " if key else ""
    return f""", {name} AS (SELECT {k}a.gene AS gene_center, b.gene AS gene_motif, sum((a.e - m.mean) * b.v) / (sqrt(sum((a.e - m.mean) * (a.e - m.mean)) * sum(b.v * b.v)) + 1e-10) AS corr FROM {source} p
  JOIN dv a ON a.fov = p.fov AND a.cell_id = p.center_id JOIN mu m ON m.fov = p.fov AND m.label = '{CT}' AND m.gene = a.gene JOIN dv b ON b.fov = p.fov AND b.cell_id = p.neighbor_id GROUP BY ALL)"""


def _distant_sql(name: str, key: str = "") -> str:
    k, ks, on, mk = (f"f.{key}, ", f"{key}, ", f" AND x.{key} = y.{key}", f"mp.{key}, ") if key else ("", "", "", "")
    return f""", {name}_c AS (SELECT {ks}fov, gene, count(*) AS n, sum(v) AS d, sum(v * v) AS ss FROM (SELECT DISTINCT {mk}mp.fov, mp.center_id, dv.gene, dv.v FROM {"(SELECT *, neighbor_label AS cell_type FROM mp) mp" if key else "mp"} JOIN dv ON dv.fov = mp.fov AND dv.cell_id = mp.center_id) GROUP BY ALL),
{name}_f AS (SELECT {k}dv.fov, dv.gene, count(*) AS n, sum(v) AS d, sum((e - mm) * (e - mm)) AS ss FROM (SELECT *, label AS cell_type FROM far) f JOIN dv ON dv.fov = f.fov AND dv.cell_id = f.cell_id JOIN (SELECT {ks}f2.fov, mu.gene, avg(mean) AS mm FROM (SELECT *, label AS cell_type FROM far) f2 JOIN mu ON mu.fov = f2.fov AND mu.label = f2.label GROUP BY ALL) mf ON mf.fov = f.fov AND mf.gene = dv.gene{f" AND mf.{key} = f.{key}" if key else ""} GROUP BY ALL),
{name} AS (SELECT {"x." + key + ", " if key else ""}x.gene AS gene_center, y.gene AS gene_motif, sum(x.d * y.d) / (sqrt(sum(x.ss * y.n) * sum(y.ss * x.n)) + 1e-10) AS corr FROM {name}_c x JOIN {name}_f y ON x.fov = y.fov{on} GROUP BY ALL)"""


EFFECTIVE = """, n1 AS (SELECT {k}sum(n) AS n1 FROM (SELECT {k}fov, least(count(DISTINCT center_id), count(DISTINCT neighbor_id)) AS n FROM (SELECT *, neighbor_label AS cell_type FROM mp) GROUP BY ALL) {g}),
n2 AS (SELECT {k}sum(least(a, b)) AS n2 FROM (SELECT {k}fov, count(DISTINCT center_id) AS a FROM (SELECT *, neighbor_label AS cell_type FROM mp) GROUP BY ALL) x JOIN (SELECT {k}fov, count(*) AS b FROM (SELECT *, label AS cell_type FROM far) GROUP BY ALL) y USING ({k}fov) {g}),
n3 AS (SELECT sum(n) AS n3 FROM (SELECT fov, least(count(DISTINCT center_id), count(DISTINCT neighbor_id)) AS n FROM op GROUP BY fov))"""
Z = "(atanh(greatest(-0.9999, least(0.9999, {a}))) - atanh(greatest(-0.9999, least(0.9999, {b})))) / sqrt(1 / ({n} - 3) + 1 / ({m} - 3))"
COLUMNS = ["gene_center", "gene_motif", "corr_neighbor", "corr_non_neighbor", "corr_center_no_motif", "delta_corr_test1", "delta_corr_test2", "z_test1", "z_test2"]


def _covariation_sql(key: str = "") -> str:
    k, g = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    source = "(SELECT *, neighbor_label AS cell_type FROM mp)" if key else "mp"
    return DENSE + _paired_sql("c1", source, key) + _distant_sql("c2", key) + _paired_sql("c3", "op") + EFFECTIVE.format(k=k, g=g) + f"""
SELECT {"c1." + key + ", " if key else ""}c1.gene_center, c1.gene_motif, round(c1.corr, 6) AS corr_neighbor, round(c2.corr, 6) AS corr_non_neighbor, round(c3.corr, 6) AS corr_center_no_motif, round(c1.corr - c2.corr, 6) AS delta_corr_test1, round(c1.corr - c3.corr, 6) AS delta_corr_test2,
  round({Z.format(a="c1.corr", b="c2.corr", n="n1", m="n2")}, 6) AS z_test1, round({Z.format(a="c1.corr", b="c3.corr", n="n1", m="n3")}, 6) AS z_test2
FROM c1 JOIN c2 USING ({k}gene_center, gene_motif) JOIN c3 ON c3.gene_center = c1.gene_center AND c3.gene_motif = c1.gene_motif {f"JOIN n1 USING ({key}) JOIN n2 USING ({key})" if key else "CROSS JOIN n1 CROSS JOIN n2"} CROSS JOIN n3"""


def _covariation(spark, d, fov: str | None = None, **more) -> DataFrame:
    c, e = cells(spark, d), expr(spark, d)
    if fov:
        c, e = c.where(F.col("fov") == fov), e.where(F.col("fov") == fov)
    return cov.covariation(c, e, CT, MOTIF, None, R, **more)


@_q("t11_cross_correlation_paired", DENSE + _paired_sql("c1", "mp") + " SELECT gene_center, gene_motif, round(corr, 6) AS corr FROM c1")
def t11(spark, d):
    c, e = cells(spark, d), expr(spark, d)
    genes = exp.frequent_genes(e)
    return cov.paired_sums(cov.motif_pairs(c, CT, MOTIF, R), e, cov._means(e, c), genes, CT).select("gene_center", "gene_motif", F.round(cov._correlation(), 6).alias("corr"))


@_q("t12_cross_correlation_distant", DENSE + _distant_sql("c2") + " SELECT gene_center, gene_motif, round(corr, 6) AS corr FROM c2")
def t12(spark, d):
    c, e = cells(spark, d), expr(spark, d)
    genes = exp.frequent_genes(e)
    pairs = cov.motif_pairs(c, CT, MOTIF, R)
    centers = pairs.select("fov", F.col("center_id").alias("cell_id")).distinct()
    return cov.distant_sums(centers, cov.distant_cells(c, CT, MOTIF, pairs), e, cov._means(e, c), genes, CT).select("gene_center", "gene_motif", F.round(cov._correlation(), 6).alias("corr"))


def _tests_sql(key: str = "") -> str:
    """The statistics with p, their joint adjustment where both differences agree in sign, scores and significance."""
    id_ = f"{key}, gene_center, gene_motif" if key else "gene_center, gene_motif"
    stats_ = _covariation_sql(key).replace("round(c1.corr, 6)", "c1.corr").replace("round(c2.corr, 6)", "c2.corr").replace("round(c3.corr, 6)", "c3.corr").replace("round(c1.corr - c2.corr, 6)", "c1.corr - c2.corr").replace("round(c1.corr - c3.corr, 6)", "c1.corr - c3.corr")
    head, tail = stats_.rsplit("\nSELECT ", 1)
    tail = tail.replace("round((atanh", "((atanh").replace(")), 6) AS z_test", "))) AS z_test").replace("), 6) AS z_test", ")) AS z_test")
    return head + f""",
st AS (SELECT {tail}),
ps AS (SELECT *, {TWO_SIDED.format(z="z_test1")} AS p1, {TWO_SIDED.format(z="z_test2")} AS p2 FROM st),
lg AS (SELECT {id_}, 1 AS test, p1 AS p FROM ps WHERE sign(delta_corr_test1) = sign(delta_corr_test2) UNION ALL SELECT {id_}, 2, p2 FROM ps WHERE sign(delta_corr_test1) = sign(delta_corr_test2)),
rw AS (SELECT *, round(p, 12) AS rp, p * count(*) OVER () / count(*) OVER (ORDER BY round(p, 12)) AS raw FROM lg),
ad AS (SELECT *, {BH.format(raw="raw", p="rp")} AS q FROM rw),
aq AS (SELECT {id_}, max(q) FILTER (test = 1) AS q1, max(q) FILTER (test = 2) AS q2 FROM ad GROUP BY ALL)
SELECT {id_}, round(p1, 6) AS p_value_test1, round(p2, 6) AS p_value_test2, round(q1, 6) AS adj_p_value_test1, round(q2, 6) AS adj_p_value_test2,
  round(0.3 * delta_corr_test1 * -log10(p1 + 1e-300) + 0.7 * delta_corr_test2 * -log10(p2 + 1e-300), 5) + 0.0 AS combined_score, coalesce(q1 < 0.05 AND q2 < 0.05, false) AS if_significant FROM ps LEFT JOIN aq USING ({id_})"""


TESTED = ["p_value_test1", "p_value_test2", "adj_p_value_test1", "adj_p_value_test2"]


def _tested(df: DataFrame, *keys: str) -> DataFrame:
    return _r(df.select(*keys, "gene_center", "gene_motif", *TESTED, F.round("combined_score", 5).alias("combined_score"), "if_significant"), *TESTED)


@_q("t15_covariation_fov", _covariation_sql().replace("HAVING count(*) >= 10)", "HAVING count(*) >= 1)"), FOV)
def t15(spark, d):
    return _r(_covariation(spark, d, FOV, min_nonzero=1).select(COLUMNS), *COLUMNS[2:])


@_q("t16_covariation_fov_by_type", _covariation_sql("cell_type").replace("HAVING count(*) >= 10)", "HAVING count(*) >= 1)"), FOV)
def t16(spark, d):
    return _r(_covariation(spark, d, FOV, min_nonzero=1, by_type=True).select("cell_type", *COLUMNS), *COLUMNS[2:])


@_q("t17_covariation", _covariation_sql())
def t17(spark, d):
    return _r(_covariation(spark, d).select(COLUMNS), *COLUMNS[2:])


@_q("t18_covariation_by_type", _covariation_sql("cell_type"))
def t18(spark, d):
    return _r(_covariation(spark, d, by_type=True).select("cell_type", *COLUMNS), *COLUMNS[2:])


@_q("t17_covariation_tests", _tests_sql())
def t17_tests(spark, d):
    return _tested(_covariation(spark, d))


@_q("t18_covariation_tests", _tests_sql("cell_type"))
def t18_tests(spark, d):
    return _tested(_covariation(spark, d, by_type=True), "cell_type")


@_q("t19_score_difference", DENSE + _paired_sql("a", "(SELECT * FROM mp WHERE dataset = 'ASIA')") + _paired_sql("b", "(SELECT * FROM mp WHERE dataset = 'EUROPE')") + """
, df AS (SELECT a.gene_center, a.gene_motif, round(a.corr, 6) AS score_a, round(b.corr, 6) AS score_b, round(round(a.corr, 6) - round(b.corr, 6), 6) AS score_diff FROM a JOIN b USING (gene_center, gene_motif)),
pc AS (SELECT *, (rank() OVER (ORDER BY score_diff) + count(*) OVER (ORDER BY score_diff RANGE UNBOUNDED PRECEDING)) * 50 / count(*) OVER () AS percentile FROM df)
SELECT gene_center, gene_motif, score_diff, round(percentile, 6) AS percentile, CASE WHEN percentile > 95 THEN 'higher_in_A' WHEN percentile < 5 THEN 'lower_in_A' ELSE 'not_outlier' END AS outlier_direction FROM pc""")
def t19(spark, d):
    c, e = cells(spark, d), expr(spark, d)
    genes = exp.frequent_genes(e)
    pairs, means = cov.motif_pairs(c, CT, MOTIF, R), cov._means(e, c)

    def side(dataset: str) -> DataFrame:
        sums = cov.paired_sums(pairs.where(F.col("dataset") == dataset), e, means, genes, CT)
        return sums.select("gene_center", "gene_motif", F.round(cov._correlation(), 6).alias("combined_score"), F.lit(True).alias("if_significant"))

    return cov.score_difference(_r(side("ASIA"), "combined_score"), side("EUROPE"), overlapping=True).select("gene_center", "gene_motif", F.round("score_diff", 6).alias("score_diff"), F.round("percentile", 6).alias("percentile"), "outlier_direction")


# Index


@_q("x1_search_and", "SELECT fov, cell_id FROM expr WHERE gene IN ('Brand#11', 'Brand#12') GROUP BY ALL HAVING count(*) = 2")
def x1(spark, d):
    return gi.search(gi.build(expr(spark, d)), ["brand#11", "BRAND#12"])


@_q("x2_search_boolean", "SELECT fov, cell_id FROM expr GROUP BY ALL HAVING bool_or(gene = 'Brand#11') AND (bool_or(gene = 'Brand#12') OR bool_or(gene = 'Brand#13')) AND NOT (bool_or(gene = 'Brand#21') AND bool_or(gene = 'Brand#22')) AND NOT (bool_or(gene = 'Brand#23') OR bool_or(gene = 'Brand#24'))")
def x2(spark, d):
    return gi.search(gi.build(expr(spark, d)), ["Brand#11", "*Brand#12", "*Brand#13", "-Brand#21", "-Brand#22", "*-Brand#23", "*-Brand#24"])


@_q("x3_query_genes", "SELECT gene, fov, cell_id FROM expr WHERE gene IN ('Brand#11', 'Brand#55')")
def x3(spark, d):
    return gi.any_of(gi.build(expr(spark, d)), ["Brand#11", "Brand#55"])


HITS = "+ h AS (SELECT g.gene, l.label, count(e.cell_id) AS tp, max(l.total) AS total FROM (SELECT DISTINCT gene FROM expr) g CROSS JOIN (SELECT label, count(*) AS total FROM raw GROUP BY label) l LEFT JOIN expr e ON e.gene = g.gene AND e.label = l.label GROUP BY ALL)"


@_q("x4_specificities", HITS + " SELECT gene, count(*) FILTER (tp > greatest(10, total * 0.13)) AS n_labels FROM h GROUP BY gene")
def x4(spark, d):
    return gi.specificities(expr(spark, d), tables.orders_as_cells(spark, d), min_fraction=0.13)


@_q("x5_dataset_specificities", "SELECT gene, count(*) FILTER (n > 10) AS n_datasets FROM (SELECT gene, dataset, count(*) AS n FROM expr GROUP BY ALL) GROUP BY gene")
def x5(spark, d):
    return gi.dataset_specificities(expr(spark, d))


@_q("x6_housekeeping", HITS + " SELECT gene, round(min(tp / total), 6) AS min_recall FROM h GROUP BY gene HAVING min(tp / total) > 0.1")
def x6(spark, d):
    return _r(gi.housekeeping(expr(spark, d), tables.orders_as_cells(spark, d), min_recall=0.1), "min_recall")


SIGNATURES = HITS + """, ra AS (SELECT label AS lab, gene, row_number() OVER (PARTITION BY label ORDER BY tp / total DESC, gene) AS step FROM h),
po AS (SELECT lab, e.cell_id, e.label, step, row_number() OVER (PARTITION BY lab, e.cell_id ORDER BY step) AS nth FROM expr e JOIN ra USING (gene)),
rn AS (SELECT lab, cell_id, label, count(*) FILTER (step = nth) AS run FROM po GROUP BY ALL),
ev AS (SELECT ra.lab, ra.step, t.label, t.total, (SELECT count(*) FROM rn WHERE rn.lab = ra.lab AND rn.label = t.label AND run >= ra.step) AS hits FROM ra CROSS JOIN (SELECT label, count(*) AS total FROM raw GROUP BY label) t),
dr AS (SELECT *, CAST(sum(hits) OVER (PARTITION BY lab, step) AS BIGINT) AS d, (SELECT count(*) FROM raw) AS n FROM ev),
pv AS (SELECT *, CASE WHEN hits = 0 THEN 1 ELSE (SELECT sum(exp(lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1) + lgamma(n - total + 1) - lgamma(d - i + 1) - lgamma(n - total - d + i + 1) - lgamma(n + 1) + lgamma(d + 1) + lgamma(n - d + 1))) FROM range(hits, least(total, d) + 1) AS r(i)) END AS p FROM dr),
hm AS (SELECT *, least(1, max(p * c) OVER (PARTITION BY lab, step ORDER BY round(p, 12))) AS adj FROM (SELECT *, count(*) OVER (PARTITION BY lab, step) - rank() OVER (PARTITION BY lab, step ORDER BY round(p, 12)) + 1 AS c FROM pv)),
ow AS (SELECT *, min(CASE WHEN hits < 5 OR adj > 1 THEN step END) OVER (PARTITION BY lab) AS stop FROM hm WHERE lab = label)
SELECT ow.lab AS label, CAST(ow.step AS INTEGER) AS step, gene, hits AS cell_hits, round(adj, 6) AS p_value FROM ow JOIN ra ON ra.lab = ow.lab AND ra.step = ow.step WHERE stop IS NULL OR ow.step < stop"""


@_q("x7_signatures", SIGNATURES)
def x7(spark, d):
    return _r(gi.signatures(expr(spark, d), tables.orders_as_cells(spark, d), min_cells=5, max_pval=1.0), "p_value")


@_q("x8_similar_genes", "+ q AS (SELECT fov, cell_id FROM expr WHERE gene = 'Brand#11'), n AS (SELECT gene, count(*) AS n, count(*) FILTER (cell_id IN (SELECT cell_id FROM q)) AS overlap FROM expr WHERE gene <> 'Brand#11' GROUP BY gene) SELECT gene, round(overlap / ((SELECT count(*) FROM q) + n - overlap), 6) AS jaccard, overlap, n FROM n ORDER BY overlap / ((SELECT count(*) FROM q) + n - overlap) DESC, gene LIMIT 5")
def x8(spark, d):
    return _r(gi.similar(gi.build(expr(spark, d)), ["Brand#11"]), "jaccard")


@_q("a16_gene_support", "SELECT gene, fov, count(*) AS n_cells FROM expr GROUP BY ALL")
def a16(spark, d):
    return gi.gene_support(gi.build(expr(spark, d)))


ITEMS = f"""+ rd AS (SELECT cell_id, sum(value) AS reads FROM expr GROUP BY cell_id),
tf AS (SELECT gene, avg(value / reads) * (SELECT count(*) FROM raw) / count(*) AS tf_idf FROM expr JOIN rd USING (cell_id) WHERE gene IN ({", ".join(f"'{g}'" for g in ITEMS4)}) GROUP BY gene)"""


@_q("a20_tf_idf", ITEMS + " SELECT gene, round(tf_idf, 6) AS tf_idf FROM tf")
def a20(spark, d):
    return _r(gi.tf_idf(expr(spark, d), ITEMS4, tables.orders_as_cells(spark, d).count()), "tf_idf")


@_q("a19_itemsets", ITEMS + f""", st AS (SELECT cell_id, list_sort(list(gene)) AS g FROM expr WHERE gene IN ({", ".join(f"'{g}'" for g in ITEMS4)}) GROUP BY cell_id),
al AS (SELECT list_filter({_sql_list(ITEMS4)}, lambda x, i: (n >> (i - 1)) & 1 = 1) AS s FROM range(1, 16) AS t(n)),
ct AS (SELECT s, count(*) AS n_cells FROM st, al WHERE len(s) > 1 AND len(list_intersect(g, s)) = len(s) GROUP BY s)
SELECT CAST(len(s) AS INTEGER) AS genes, array_to_string(s, ',') AS query, (SELECT round(min(tf_idf) * sum(tf_idf), 6) FROM tf WHERE list_contains(s, gene)) AS tf_idf, n_cells FROM ct""")
def a19(spark, d):
    return _r(gi.itemsets(expr(spark, d), ITEMS4, tables.orders_as_cells(spark, d).count()), "tf_idf")


MARKERS = "round(tp / (tp + fp), 6) AS precision, round(tp / total, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + total - tp) ELSE 0 END, 6) AS f1"


@_q("a22_markers", HITS + f", m AS (SELECT *, CAST(sum(tp) OVER (PARTITION BY gene) - tp AS BIGINT) AS fp FROM h) SELECT label, gene, tp, fp, total - tp AS fn, {MARKERS} FROM m")
def a22(spark, d):
    return _r(gi.markers(expr(spark, d), tables.orders_as_cells(spark, d)), "precision", "recall", "f1")


BOTH = "+ b AS (SELECT cell_id, label FROM expr WHERE gene IN ('Brand#11', 'Brand#12') GROUP BY ALL HAVING count(*) = 2), h AS (SELECT l.label, count(b.cell_id) AS tp, max(total) AS total FROM (SELECT label, count(*) AS total FROM raw GROUP BY label) l LEFT JOIN b ON b.label = l.label GROUP BY l.label), m AS (SELECT *, CAST(sum(tp) OVER () - tp AS BIGINT) AS fp FROM h)"


@_q("a22_markers_of_all", BOTH + f" SELECT label, tp, fp, total - tp AS fn, {MARKERS} FROM m")
def a22_all(spark, d):
    return _r(gi.markers_of_all(expr(spark, d), tables.orders_as_cells(spark, d), ["Brand#11", "Brand#12"]), "precision", "recall", "f1")


@_q("t20_hypergeometric_query", BOTH + """, k AS (SELECT label, tp AS x, total AS a, tp + fp AS dr, (SELECT count(*) FROM raw) AS n FROM m),
p AS (SELECT *, (SELECT sum(exp(lgamma(a + 1) - lgamma(i + 1) - lgamma(a - i + 1) + lgamma(n - a + 1) - lgamma(dr - i + 1) - lgamma(n - a - dr + i + 1) - lgamma(n + 1) + lgamma(dr + 1) + lgamma(n - dr + 1))) FROM range(x, least(a, dr) + 1) AS t(i)) AS p FROM k)
SELECT label, x AS cell_hits, a AS total_cells, round(least(1, p), 6) AS p_value, round(least(1, max(p * c) OVER (ORDER BY round(p, 12))), 6) AS adj_p_value FROM (SELECT *, count(*) OVER () - rank() OVER (ORDER BY round(p, 12)) + 1 AS c FROM p)""")
def t20(spark, d):
    return _r(gi.hypergeometric_query(expr(spark, d), tables.orders_as_cells(spark, d), ["Brand#11", "Brand#12"], None), "p_value", "adj_p_value")


@_q("a23_cell_meta", "SELECT fov, cell_id, CAST(sum(floor(value)) AS BIGINT) AS reads, count(*) AS features FROM expr GROUP BY ALL")
def a23(spark, d):
    return gi.cell_meta(expr(spark, d))


@_q("a25_effective_size", J5 + " SELECT fov, least(count(DISTINCT center_id), count(DISTINCT neighbor_id)) AS n_eff FROM mp GROUP BY fov")
def a25(spark, d):
    return cov.motif_pairs(cells(spark, d), CT, MOTIF, R).groupBy("fov").agg(F.least(F.count_distinct("center_id"), F.count_distinct("neighbor_id")).alias("n_eff"))


# Tables behind figures


@_q("p12_motif_probes", GRID_SQL + " SELECT fov, center_id AS probe_id, count(*) AS n FROM hits GROUP BY ALL HAVING count(*) FILTER (neighbor_label = '1-URGENT') >= 2 AND count(*) FILTER (neighbor_label = '2-HIGH') >= 1")
def p12(spark, d):
    c = cells(spark, d)
    return summary.motif_probes(c, 5.0, ["1-URGENT", "1-URGENT", "2-HIGH"], 5.0)


@_q("v1_frequent_labels", f"SELECT cell_id, round(x, 6) AS x, round(y, 6) AS y, CASE WHEN count(*) OVER (PARTITION BY label) >= 110 THEN label ELSE 'other' END AS label FROM cells WHERE fov = '{FOV}'")
def v1(spark, d):
    return _r(summary.frequent_labels(cells(spark, d), FOV, 110), "x", "y")


@_q("v2_motif_roles", f"+ q AS ({QUALIFY}), n AS (SELECT DISTINCT p.fov, neighbor_id FROM pairs p JOIN q ON p.fov = q.fov AND p.center_id = q.center_id WHERE list_contains({MOTIF_SQL}, neighbor_label)) SELECT c.fov, cell_id, label, CASE WHEN q.center_id IS NOT NULL THEN 'center' WHEN n.neighbor_id IS NOT NULL THEN 'motif' ELSE 'other' END AS role FROM cells c LEFT JOIN q ON q.fov = c.fov AND q.center_id = cell_id LEFT JOIN n ON n.fov = c.fov AND n.neighbor_id = cell_id")
def v2(spark, d):
    return summary.motif_roles(cells(spark, d), CT, MOTIF, R)


@_q("v3_motif_matrix", "+" + _mine_sql(CENTERS, 0.3).replace("SELECT array_to_string(itemset, '+') AS itemset, freq, round(support, 6) AS support FROM frq a", ", top AS (SELECT itemset, freq FROM frq a") + ") SELECT 'motif_' || row_number() OVER (ORDER BY freq DESC, array_to_string(itemset, '+')) AS motif, freq, unnest(itemset) AS label FROM top")
def v3(spark, d):
    return summary.motif_matrix(enr.mined(cells(spark, d), CT, R, min_support=0.3))


@_q("v4_motif_random_probes", RANDOM_SQL + " SELECT fov, center_id AS probe_id, count(*) AS n FROM hits GROUP BY ALL HAVING count(*) FILTER (neighbor_label = '1-URGENT') >= 1 AND count(*) FILTER (neighbor_label = '2-HIGH') >= 1")
def v4_probes(spark, d):
    c = cells(spark, d)
    return summary.motif_probes(c, nb.random_probes(c), MOTIF, 5.0)


@_q("v4_motif_random_cells", RANDOM_SQL + f", ok AS (SELECT fov, center_id FROM hits GROUP BY ALL HAVING count(*) FILTER (neighbor_label = '1-URGENT') >= 1 AND count(*) FILTER (neighbor_label = '2-HIGH') >= 1) SELECT DISTINCT hits.fov, neighbor_id AS cell_id, neighbor_label AS label FROM hits JOIN ok USING (fov, center_id) WHERE list_contains({MOTIF_SQL}, neighbor_label)")
def v4_cells(spark, d):
    c = cells(spark, d)
    return summary.motif_probe_cells(c, nb.random_probes(c), MOTIF, 5.0)


@_q("v5_covariation_roles", J5 + f""", pt AS (SELECT fov, center_id AS cell_id, 1 AS n FROM mp UNION ALL SELECT fov, center_id, 2 FROM op UNION ALL SELECT fov, neighbor_id, 3 FROM mp UNION ALL SELECT fov, cell_id, 4 FROM far UNION ALL SELECT fov, neighbor_id, 5 FROM op),
ls AS (SELECT fov, cell_id, max(n) AS n FROM pt GROUP BY ALL)
SELECT c.fov, c.cell_id, c.label, CASE n WHEN 1 THEN 'center {CT} with motif' WHEN 2 THEN 'non-motif center {CT}' WHEN 3 THEN 'neighbor motif: ' || c.label WHEN 4 THEN 'non-neighbor motif: ' || c.label WHEN 5 THEN 'non-motif-center neighbors' ELSE 'other' END AS role FROM cells c LEFT JOIN ls ON ls.fov = c.fov AND ls.cell_id = c.cell_id""")
def v5(spark, d):
    c = cells(spark, d)
    pairs = cov.motif_pairs(c, CT, MOTIF, R)
    return summary.covariation_roles(c, CT, pairs, cov.distant_cells(c, CT, MOTIF, pairs), cov.other_pairs(c, CT, pairs, R))


@_q("v7_differential_matrix", "+ tests AS (" + _whitney_sql("WITH " + SUPPORT_SQL.lstrip("+ ") + DIFFERENTIAL.removeprefix(SUPPORT_SQL).rsplit("\nSELECT", 1)[0]) + "), no AS (SELECT *, row_number() OVER (PARTITION BY higher ORDER BY adj_p_value DESC, itemset) AS n FROM tests) SELECT higher AS dataset, higher || '_motif_' || n AS motif_group, unnest(string_split(itemset, '+')) AS label, round(-log10(adj_p_value), 5) AS neg_log10_p FROM no")
def v7(spark, d):
    found = enr.differential(cells(spark, d), CT, ["ASIA", "EUROPE"], MOTIFS, R).withColumn("adj_p_value", F.round("adj_p_value", 6))
    return summary.differential_matrix(found, None).withColumn("neg_log10_p", F.round("neg_log10_p", 5))


@_q("v8_pair_matrix", _tests_sql("cell_type").replace("\nSELECT cell_type, gene_center, gene_motif, round(p1", ",\nts AS (SELECT cell_type, gene_center, gene_motif, round(p1") + """),
sg AS (SELECT cell_type, CASE WHEN combined_score > 0 THEN 'positive' ELSE 'negative' END AS sign, gene_center, gene_motif, abs(combined_score) AS score FROM ts WHERE p_value_test1 < 0.2 AND combined_score <> 0)
SELECT * FROM sg JOIN (SELECT cell_type, sign FROM sg GROUP BY ALL HAVING count(DISTINCT gene_center) > 1 AND count(DISTINCT gene_motif) > 1) USING (cell_type, sign)""")
def v8(spark, d):
    found = _tested(_covariation(spark, d, by_type=True), "cell_type").withColumn("telling", F.col("p_value_test1") < 0.2)
    return summary.pair_matrix(found, "telling")


HOLM = FISHER.rsplit(",\nbh AS", 1)[0] + """, hl AS (SELECT gene, least(1, p) AS p, count(*) OVER () - rank() OVER (ORDER BY round(p, 12)) + 1 AS c FROM fp)
SELECT gene, round(p, 6) AS p_value, round(least(1, max(p * c) OVER (ORDER BY round(p, 12))), 6) AS adj_p_value FROM hl"""


@_q("t10_de_holm", GROUPS + HOLM)
def t10(spark, d):
    own = exp.de_fisher(expr(spark, d), _groups(spark, d), alpha=None).select("gene", "p_value")
    return _r(stats.holm(own), "p_value", "adj_p_value")


@_q("a17_gene_patterns", """+ pr2 AS (SELECT a.cell_id, a.gene AS g1, b.gene AS g2 FROM expr a JOIN expr b ON a.cell_id = b.cell_id AND a.gene < b.gene),
pr3 AS (SELECT p.*, c.gene AS g3 FROM pr2 p JOIN expr c ON c.cell_id = p.cell_id AND c.gene > g2), pr4 AS (SELECT p.*, c.gene AS g4 FROM pr3 p JOIN expr c ON c.cell_id = p.cell_id AND c.gene > g3)
SELECT g1 || ',' || g2 AS genes, count(*) AS freq FROM pr2 GROUP BY ALL HAVING count(*) >= 12 UNION ALL SELECT g1 || ',' || g2 || ',' || g3, count(*) FROM pr3 GROUP BY ALL HAVING count(*) >= 12
UNION ALL SELECT g1 || ',' || g2 || ',' || g3 || ',' || g4, count(*) FROM pr4 GROUP BY ALL HAVING count(*) >= 12""")
def a17(spark, d):
    return gi.gene_patterns(expr(spark, d), min_cells=12).select(F.array_join("itemset", ",").alias("genes"), "freq")


CUTOFF_GENES = [f"Brand#{i}{j}" for i in (1, 2) for j in range(1, 6)]


@_q("a21_support_cutoff", f"""+ oq AS (SELECT gene, cell_id, count(*) OVER (PARTITION BY cell_id) AS k FROM expr WHERE gene IN ({", ".join(f"'{g}'" for g in CUTOFF_GENES)})),
pp AS (SELECT gene, floor(sum(k - 1) / 10 * ((SELECT count(*) FROM oq) / (SELECT count(DISTINCT cell_id) FROM oq) / ln(10))) AS c FROM oq GROUP BY gene)
SELECT CAST(greatest(1, list_sort(list(c))[6]) AS BIGINT) AS cutoff FROM pp""")
def a21(spark, d):
    return spark.createDataFrame([(gi.support_cutoff(expr(spark, d), CUTOFF_GENES),)], "cutoff long")


@_q("a23_label_totals", "SELECT label, count(*) AS total_cells FROM raw GROUP BY label")
def a23_labels(spark, d):
    return gi.label_totals(tables.orders_as_cells(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["t2_enrichment_dist"](spark, d)
