"""Distributions and compositions, and the tables behind figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.sources.tables import written

from .neighbors import by_center, probe_join, radius_join
from .patterns import holds


def label_distribution(cells: DataFrame, by: str = "dataset") -> DataFrame:
    """(by, label, n, proportion): cells of each label in each dataset or field of view."""
    n = cells.groupBy(by, "label").agg(F.count("*").alias("n"))
    return n.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def label_matrix(cells: DataFrame, by: str = "dataset", values: list | None = None) -> DataFrame:
    """label_distribution() with a column for each group, missing as 0, labels by falling total."""
    wide = cells.groupBy("label").pivot(by, values).count().fillna(0)
    total = sum(F.col(f"`{c}`") for c in wide.columns if c != "label")
    return wide.withColumn("total", total).orderBy(F.desc("total"), "label")


def niche_composition(cells: DataFrame, ct: str, labels: list[str], max_dist: float) -> DataFrame:
    """(fov, center_id, label, proportion): for centres with all the labels round them, the share of each of those
    among all neighbours."""
    pairs = radius_join(cells, max_dist, cells.where(F.col("label") == ct))
    n = pairs.groupBy(*by_center(pairs), "neighbor_label").agg(F.count("*").alias("n"))
    every = Window.partitionBy(*by_center(pairs))
    n = n.withColumns({"_all": F.sum("n").over(every), "_has": F.collect_set("neighbor_label").over(every)})
    out = n.where(holds(F.col("_has"), F.array(*map(F.lit, labels))) & F.col("neighbor_label").isin(labels))
    return out.select("fov", "center_id", F.col("neighbor_label").alias("label"), (F.col("n") / F.col("_all")).alias("proportion"))


def frequent_labels(cells: DataFrame, fov: str, min_cells: int = 0) -> DataFrame:
    """(cell_id, x, y, label) of one field of view, labels of fewer than min_cells cells as 'other'."""
    own = cells.where(F.col("fov") == fov)
    n = F.count("*").over(Window.partitionBy("label"))
    return own.withColumn("label", F.when(n >= min_cells, F.col("label")).otherwise("other")).select("cell_id", "x", "y", "label")


def _probes_with(near: DataFrame, motif: list[str]) -> DataFrame:
    """(fov, center_id, n): probe points with the motif, each label as often as named, from counts of its labels alone."""
    wanted = sorted(set(motif))
    found = near.groupBy("fov", "center_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("neighbor_label") == m).alias(f"_{i}") for i, m in enumerate(wanted)])
    for i, m in enumerate(wanted):
        found = found.where(F.col(f"_{i}") >= motif.count(m))
    return found.select("fov", "center_id", "n")


def motif_probes(cells: DataFrame, probes: DataFrame | float, motif: list[str], max_dist: float) -> DataFrame:
    """Probe points whose neighbourhood has the motif, each label as often as named, with how many cells it holds. Probes
    are rows, or the step of a grid."""
    return _probes_with(probe_join(cells, probes, max_dist), motif).withColumnRenamed("center_id", "probe_id")


def motif_roles(cells: DataFrame, ct: str, motif: list[str], max_dist: float) -> DataFrame:
    """(fov, cell_id, label, role): qualifying centres, the motif's cells round them (no qualifying centre among these),
    and all other cells."""
    pairs = radius_join(cells, max_dist, cells.where(F.col("label") == ct))
    sets = pairs.groupBy(*by_center(pairs)).agg(F.collect_set("neighbor_label").alias("labels")).where(holds(F.col("labels"), F.array(*map(F.lit, motif))))
    centers = sets.select("fov", F.col("center_id").alias("cell_id"), F.lit(1).alias("_center"))
    near = pairs.join(sets.select("fov", "center_id"), ["fov", "center_id"], "left_semi").where(F.col("neighbor_label").isin(motif)).select("fov", F.col("neighbor_id").alias("cell_id"), F.lit(1).alias("_near")).distinct()
    out = cells.select("fov", "cell_id", "label").join(centers, ["fov", "cell_id"], "left").join(near, ["fov", "cell_id"], "left")
    return out.withColumn("role", F.when(F.col("_center") == 1, "center").when(F.col("_near") == 1, "motif").otherwise("other")).drop("_center", "_near")


def motif_matrix(patterns: DataFrame, order: str = "freq") -> DataFrame:
    """(motif, label): labels of numbered motifs, motif_1 the first by falling order, for a heat map."""
    # Patterns of a centre: as few rows as there are maximal label sets.
    no = F.row_number().over(Window.orderBy(F.desc(order), F.array_join("itemset", "+")))
    return patterns.withColumn("motif", F.concat(F.lit("motif_"), no.cast("string"))).select("motif", F.explode("itemset").alias("label"), order)


def motif_probe_cells(cells: DataFrame, probes: DataFrame | float, motif: list[str], max_dist: float) -> DataFrame:
    """(fov, cell_id, label): cells with a label of the motif round the probe points that motif_probes() finds."""
    near = written(probe_join(cells, probes, max_dist), "near")
    sets = _probes_with(near, motif).select("fov", "center_id")
    own = near.where(F.col("neighbor_label").isin(motif)).join(sets, ["fov", "center_id"], "left_semi")
    return own.select("fov", F.col("neighbor_id").alias("cell_id"), F.col("neighbor_label").alias("label")).distinct()


def covariation_roles(cells: DataFrame, ct: str, pairs: DataFrame, distant: DataFrame, others: DataFrame) -> DataFrame:
    """(fov, cell_id, label, role) of every cell in a covariation: centres with the motif and without, neighbours and
    distant cells of the motif by label, and neighbours of centres without it. Where a cell has several parts, the one
    named last here holds."""
    part = lambda df, c, n: df.select("fov", F.col(c).alias("cell_id"), F.lit(n).alias("_part"))
    parts = part(pairs, "center_id", 1).unionByName(part(others, "center_id", 2)).unionByName(part(pairs, "neighbor_id", 3)).unionByName(part(distant, "cell_id", 4)).unionByName(part(others, "neighbor_id", 5))
    last = parts.groupBy("fov", "cell_id").agg(F.max("_part").alias("_part"))
    out = cells.select("fov", "cell_id", "label").join(last, ["fov", "cell_id"], "left")
    is_, label = lambda n: F.col("_part") == n, F.col("label")
    role = F.when(is_(1), f"center {ct} with motif").when(is_(2), f"non-motif center {ct}").when(is_(3), F.concat(F.lit("neighbor motif: "), label)).when(is_(4), F.concat(F.lit("non-neighbor motif: "), label)).when(is_(5), "non-motif-center neighbors").otherwise("other")
    return out.select("fov", "cell_id", "label", role.alias("role"))


def differential_matrix(found: DataFrame, alpha: float | None = 0.05) -> DataFrame:
    """(dataset, motif_group, label, neg_log10_p): labels of the motifs that differential() found, numbered within the
    dataset in which they are more frequent by falling adjusted p. Those under alpha, or all with None."""
    own = found if alpha is None else found.where(F.col("adj_p_value") < alpha)
    no = F.row_number().over(Window.partitionBy("higher").orderBy(F.desc("adj_p_value"), F.array_join("itemset", "+")))
    own = own.withColumn("motif_group", F.concat("higher", F.lit("_motif_"), no.cast("string")))
    return own.select(F.col("higher").alias("dataset"), "motif_group", F.explode("itemset").alias("label"), (-F.log10("adj_p_value")).alias("neg_log10_p"))


def pair_matrix(found: DataFrame, significant: str = "if_significant") -> DataFrame:
    """(cell_type, sign, gene_center, gene_motif, score): the significant gene pairs of covariation() by type, positive
    and negative scores apart and without sign. A matrix of fewer than two rows or columns is left out. Rows are what
    a clustering would order; none is made here."""
    own = found.where(F.col(significant) & (F.col("combined_score") != 0))
    own = own.select("cell_type", F.when(F.col("combined_score") > 0, "positive").otherwise("negative").alias("sign"), "gene_center", "gene_motif", F.abs("combined_score").alias("score"))
    big = own.groupBy("cell_type", "sign").agg(F.count_distinct("gene_center").alias("r"), F.count_distinct("gene_motif").alias("c")).where("r > 1 and c > 1")
    return own.join(big.select("cell_type", "sign"), ["cell_type", "sign"], "left_semi")
