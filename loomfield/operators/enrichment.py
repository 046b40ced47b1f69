"""Motif enrichment round a label, and motifs whose frequency differs between two datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import stats
from loomfield.sources.tables import of_datasets, written

from .neighbors import by_center, check_label, known_labels, knn_join, radius_join
from .patterns import holds, maximal, mine, transactions


def _motifs(spark: SparkSession, motifs: list[list[str]]) -> DataFrame:
    """Given motifs as rows: (itemset)."""
    return spark.createDataFrame([(sorted(m),) for m in motifs], "itemset array<string>")


def flat(motifs: list) -> list[list[str]]:
    """One motif, or a list of motifs, as a list of motifs."""
    return [motifs] if motifs and isinstance(motifs[0], str) else [list(m) for m in motifs]


def motif_counts(cells: DataFrame, pairs: DataFrame, ct: str, motifs: DataFrame) -> DataFrame:
    """(center, motif, n_center_motif, n_center, n_motif, n_cells): over all fields of view, centres of label ct, cells
    of any label whose neighbourhood has the motif, and those that are both. Neighbourhoods are found once for all
    motifs, and each is matched where it is. A field of view without a label of the motif adds to cells and centres
    alone. A label that the motif names m times divides the centres by m, rounded half to even."""
    sets = pairs.groupBy("dataset", *by_center(pairs, "center_label")).agg(F.collect_set("neighbor_label").alias("labels"))
    sets = sets.groupBy("center_label", F.sort_array("labels").alias("labels")).agg(F.count("*").alias("_n"))
    sets = sets.withColumn("_m", motifs.agg(F.collect_list("itemset")).scalar())
    motif = F.explode(F.filter("_m", lambda m: holds(F.col("labels"), m))).alias("motif")
    seen = sets.select("center_label", "_n", motif).groupBy("motif").agg(F.sum("_n").alias("n_motif"), F.sum(F.when(F.col("center_label") == ct, F.col("_n")).otherwise(0)).alias("n_center_motif"))
    total = cells.agg(F.count("*").alias("n_cells"), F.sum(F.when(F.col("label") == ct, 1).otherwise(0)).alias("_ct"))
    every = motifs.select(F.col("itemset").alias("motif")).withColumn("_t", total.select(F.struct("n_cells", "_ct")).scalar()).select("motif", "_t.*")
    times = F.size(F.filter("motif", lambda m: m == ct))
    out = every.join(seen, "motif", "left").fillna(0, ["n_motif", "n_center_motif"])
    return out.select(F.lit(ct).alias("center"), "motif", "n_center_motif", F.bround(F.col("_ct") / F.greatest(times, F.lit(1))).cast("long").alias("n_center"), "n_motif", "n_cells")


def enrichment(cells: DataFrame, ct: str, motifs: list | None = None, max_dist: float = 20.0, k: int | None = None, min_support: float = 0.5, min_size: int = 0, alpha: float = 0.05) -> DataFrame:
    """Counts, expectation, p_value = P(X > n_center_motif), adj_p_value and if_significant for each motif.

    With k, neighbours are the k nearest within max_dist; else all within it. Motifs are given, one or several, or the
    maximal frequent label sets of the centres' neighbourhoods. Unknown labels are dropped from a motif; a motif of
    none but those, like an unknown ct, raises ValueError. No motif found: an empty table. One motif isn't adjusted."""
    check_label(cells, ct)
    if motifs is None:
        wanted = written(mined(cells, ct, max_dist, k, min_support, min_size).select("itemset"), "motifs")
    else:
        wanted = _motifs(cells.sparkSession, [known_labels(cells, m) for m in flat(motifs)])
    pairs = radius_join(cells, max_dist) if k is None else knn_join(cells, k, max_dist)
    counts = motif_counts(cells, pairs, ct, wanted)
    out = counts.withColumn("expectation", F.col("n_center") * F.col("n_motif") / F.col("n_cells"))
    out = out.withColumn("p_value", stats.p_enriched(F.col("n_center_motif"), F.col("n_cells"), F.col("n_center"), F.col("n_motif")))
    out = stats.benjamini_hochberg(out)
    return out.withColumn("if_significant", F.col("adj_p_value") < alpha)


def enrichment_cells(cells: DataFrame, ct: str, motif: list[str], max_dist: float) -> DataFrame:
    """(fov, center_ids, neighbor_ids) behind a motif's count: qualifying centres, and their neighbours with a label of
    the motif, for each field of view; empty arrays where there are none."""
    pairs = radius_join(cells, max_dist, cells.where(F.col("label") == ct))
    sets = transactions(pairs).where(holds(F.col("labels"), F.array(*map(F.lit, motif))))
    own = sets.groupBy("fov").agg(F.sort_array(F.collect_list("center_id")).alias("center_ids"))
    near = pairs.join(sets.select("fov", "center_id"), ["fov", "center_id"], "left_semi").where(F.col("neighbor_label").isin(motif))
    near = near.select("fov", "neighbor_id").distinct().groupBy("fov").agg(F.sort_array(F.collect_list("neighbor_id")).alias("neighbor_ids"))
    none = F.array().cast("array<bigint>")
    return cells.select("fov").distinct().join(own, "fov", "left").join(near, "fov", "left").withColumns({c: F.coalesce(c, none) for c in ("center_ids", "neighbor_ids")})


def center_sets(cells: DataFrame, ct: str, max_dist: float, k: int | None, min_size: int = 0) -> DataFrame:
    """Transactions for mining. By k, neighbours at max_dist itself don't count and empty transactions do; by radius,
    those of size <= min_size don't."""
    centers = cells.where(F.col("label") == ct)
    if k is None:
        return transactions(radius_join(cells, max_dist, centers), min_size)
    return transactions(knn_join(cells, k, max_dist, centers, strict=True), centers=centers)


def mined(cells: DataFrame, ct: str, max_dist: float = 20.0, k: int | None = None, min_support: float = 0.5, min_size: int = 0, by: list[str] | None = None) -> DataFrame:
    """Maximal frequent label sets round ct, over all fields of view pooled, or for each group `by`."""
    return maximal(mine(center_sets(cells, ct, max_dist, k, min_size), min_support, by), by)


def motif_supports(cells: DataFrame, ct: str, motifs: DataFrame, max_dist: float, k: int | None = None, min_size: int = 0) -> DataFrame:
    """(dataset, fov, itemset, support): the share of all centres whose neighbourhood, of size > min_size by radius, has
    the motif; 0 for a field of view without centres, or without the motif."""
    centers = cells.where(F.col("label") == ct)
    pairs = radius_join(cells, max_dist, centers) if k is None else knn_join(cells, k, max_dist, centers)
    sets = transactions(pairs, min_size if k is None else 0)
    every = motifs.select("itemset").distinct().agg(F.collect_list("itemset").alias("_m"))
    hits = sets.withColumn("_m", every.scalar()).select("dataset", "fov", F.explode(F.filter("_m", lambda m: holds(F.col("labels"), m))).alias("itemset")).groupBy("dataset", "fov", "itemset").agg(F.count("*").alias("hits"))
    total = cells.groupBy("dataset", "fov").agg(F.sum(F.when(F.col("label") == ct, 1).otherwise(0)).alias("n"))
    frame = total.withColumn("_m", every.scalar()).select("dataset", "fov", "n", F.explode("_m").alias("itemset"))
    return frame.join(hits, ["dataset", "fov", "itemset"], "left").select("dataset", "fov", "itemset", F.when(F.col("n") > 0, F.coalesce("hits", F.lit(0)) / F.col("n")).otherwise(0.0).alias("support"))


def _average_ranks(values: Column) -> Column:
    """Ranks of an array's values among themselves, ties at their mean."""
    return F.transform(values, lambda v: (F.size(F.filter(values, lambda w: w < v)) + (F.size(F.filter(values, lambda w: w == v)) + 1) / 2).cast("double"))


def _median(values: Column) -> Column:
    s, n = F.sort_array(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def differential(cells: DataFrame, ct: str, datasets: list[str], motifs: list | None = None, max_dist: float = 20.0, k: int | None = None, min_support: float = 0.5, min_size: int = 0) -> DataFrame:
    """(itemset, mean_1, mean_2, median_rank_1, median_rank_2, p_value, higher, adj_p_value, if_significant): motif
    supports over the fields of view of two datasets by the Mann-Whitney test, adjusted over motifs. The dataset with
    the larger median rank is the higher one; the second, where they tie. Motifs are given, or the maximal frequent
    sets of any single field of view."""
    if len(datasets) != 2:
        raise ValueError("give two datasets")
    own = of_datasets(cells, datasets)
    check_label(own, ct)
    if motifs is None:
        wanted = mined(own, ct, max_dist, k, min_support, min_size, ["fov"]).select("itemset").distinct()
    else:
        wanted = _motifs(own.sparkSession, flat(motifs))
    by_fov = motif_supports(own, ct, wanted, max_dist, k, min_size)
    side = lambda d: F.sort_array(F.collect_list(F.when(F.col("dataset") == d, F.col("support"))))
    rows = by_fov.groupBy("itemset").agg(side(datasets[0]).alias("_a"), side(datasets[1]).alias("_b")).withColumn("_r", _average_ranks(F.concat("_a", "_b")))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    out = rows.select(
        "itemset", mean(F.col("_a")).alias("mean_1"), mean(F.col("_b")).alias("mean_2"),
        _median(F.slice("_r", 1, F.size("_a"))).alias("median_rank_1"), _median(F.slice("_r", F.size("_a") + 1, F.size("_b"))).alias("median_rank_2"),
        stats.p_mann_whitney(F.col("_a"), F.col("_b")).alias("p_value"),
    )
    out = out.withColumn("higher", F.when(F.col("median_rank_1") > F.col("median_rank_2"), datasets[0]).otherwise(datasets[1]))
    return stats.benjamini_hochberg(out).withColumn("if_significant", F.col("adj_p_value") < 0.05)
