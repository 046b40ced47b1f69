"""Gene statistics of groups of cells: means, prevalences, and tests of difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import stats


def group_sizes(groups: DataFrame) -> DataFrame:
    """One row, n1 and n2: distinct cells of the groups 1 and 2 of groups (cell_id, grp)."""
    own = groups.select("cell_id", "grp").distinct()
    return own.agg(F.sum(F.when(F.col("grp") == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col("grp") == 2, 1).otherwise(0)).alias("n2"))


def lognormalize(expr: DataFrame) -> DataFrame:
    """expr with values scaled to the median of the cells' totals, then ln(1 + value), for each field of view."""
    totals = expr.groupBy("fov", "cell_id").agg(F.sum("value").alias("_t"))
    middle = totals.groupBy("fov").agg(F.percentile("_t", F.lit(0.5)).alias("_m"))
    return expr.join(totals, ["fov", "cell_id"]).join(middle, "fov").withColumn("value", F.log1p(F.col("value") / F.col("_t") * F.col("_m"))).drop("_t", "_m")


def label_means(expr: DataFrame, cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, label, gene, mean): over all cells of the label, those without the gene as 0."""
    by = by or []
    n = cells.groupBy(*by, "label").agg(F.count("*").alias("n"))
    return expr.groupBy(*by, "label", "gene").agg(F.sum("value").alias("s")).join(n, [*by, "label"]).select(*by, "label", "gene", (F.col("s") / F.col("n")).alias("mean"))


def frequent_genes(expr: DataFrame, min_nonzero: int = 10) -> DataFrame:
    """Genes that so many cells express."""
    return expr.groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") >= min_nonzero).select("gene")


def expressing_counts(expr: DataFrame, groups: DataFrame) -> DataFrame:
    """(gene, expressed_cells_1, expressed_cells_2): cells of each group that express the gene. Cells named twice count
    once. The outer merge of both groups' counts is one aggregate: a gene of one group only has 0 in the other."""
    own = groups.select("cell_id", "grp").distinct()
    one = lambda g: F.sum(F.when(F.col("grp") == g, 1).otherwise(0)).cast("long")
    return expr.where("value > 0").join(own, "cell_id").groupBy("gene").agg(one(1).alias("expressed_cells_1"), one(2).alias("expressed_cells_2"))


def _with_proportions(counts: DataFrame, groups: DataFrame) -> DataFrame:
    sizes = group_sizes(groups)
    out = counts.withColumns({"total_cells_1": sizes.select("n1").scalar().cast("long"), "total_cells_2": sizes.select("n2").scalar().cast("long")})
    share = lambda i: F.when(F.col(f"total_cells_{i}") > 0, F.col(f"expressed_cells_{i}") / F.col(f"total_cells_{i}")).otherwise(0.0)
    return out.withColumns({"proportion_1": share(1), "proportion_2": share(2)}).withColumn("abs_difference", F.abs(F.col("proportion_1") - F.col("proportion_2")))


def de_fisher(expr: DataFrame, groups: DataFrame, min_fraction: float = 0.05, alpha: float = 0.05, ties: str | None = "group1") -> DataFrame:
    """Fisher's exact test of each gene that a share min_fraction of either group expresses, adjusted over those, with
    the cells a, b (group 1: expressing, not) and c, d (group 2). Rows with adj_p_value < alpha; all, with alpha None.
    de_in is the group of the larger proportion; `ties` names it where they are equal (None over many fields of view)."""
    out = _with_proportions(expressing_counts(expr, groups), groups).where((F.col("proportion_1") >= min_fraction) | (F.col("proportion_2") >= min_fraction))
    e1, e2, n1, n2 = (F.col(c) for c in ("expressed_cells_1", "expressed_cells_2", "total_cells_1", "total_cells_2"))
    out = out.withColumns({"a": e1, "b": n1 - e1, "c": e2, "d": n2 - e2})
    out = out.withColumn("p_value", stats.p_fisher(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    out = stats.benjamini_hochberg(out)
    first, second = F.col("proportion_1"), F.col("proportion_2")
    out = out.withColumn("de_in", F.when(first > second, "group1").when(first < second, "group2").otherwise(F.lit(ties)))
    return out if alpha is None else out.where(F.col("adj_p_value") < alpha)


def common_genes(expr: DataFrame, fovs: list[str] | None = None) -> DataFrame:
    """expr of the genes that every field of view has."""
    own = expr if fovs is None else expr.where(F.col("fov").isin(fovs))
    n = own.agg(F.count_distinct("fov")).scalar()
    every = own.groupBy("gene").agg(F.count_distinct("fov").alias("_f")).where(F.col("_f") == n).select("gene")
    return own.join(every, "gene", "left_semi")


def de_welch(expr: DataFrame, groups: DataFrame, min_fraction: float = 0.05) -> DataFrame:
    """Welch's t of each gene, group 1 against group 2: t, df, p_value, adj_p_value, log2fc, proportions, de_in.

    Cells without the gene are zeros: sums and squares come from the sparse rows, sizes from the groups. log2fc compares
    exp(mean) - 1, as values are taken to be ln(1 + x)."""
    own = groups.select("cell_id", "grp").distinct()
    when = lambda g, c: F.sum(F.when(F.col("grp") == g, c).otherwise(0.0))
    v = F.col("value")
    sums = expr.where("value > 0").join(own, "cell_id").groupBy("gene").agg(
        *[when(g, F.lit(1)).cast("long").alias(f"expressed_cells_{g}") for g in (1, 2)], *[when(g, v).alias(f"_s{g}") for g in (1, 2)], *[when(g, v * v).alias(f"_q{g}") for g in (1, 2)]
    )
    out = _with_proportions(sums, groups).where((F.col("proportion_1") >= min_fraction) | (F.col("proportion_2") >= min_fraction))
    n = {g: F.col(f"total_cells_{g}").cast("double") for g in (1, 2)}
    out = out.withColumns({f"mean_{g}": F.col(f"_s{g}") / n[g] for g in (1, 2)})
    out = out.withColumns({f"_e{g}": F.greatest(F.lit(0.0), F.col(f"_q{g}") - F.col(f"_s{g}") * F.col(f"_s{g}") / n[g]) / (n[g] - 1) / n[g] for g in (1, 2)})
    e1, e2 = F.col("_e1"), F.col("_e2")
    out = out.withColumn("t", F.when(e1 + e2 > 0, (F.col("mean_1") - F.col("mean_2")) / F.sqrt(e1 + e2))).withColumn("df", F.when(e1 + e2 > 0, (e1 + e2) * (e1 + e2) / (e1 * e1 / (n[1] - 1) + e2 * e2 / (n[2] - 1))))
    return _tested(out.withColumn("p_value", stats.p_student(F.col("t"), F.col("df"))))


def _tested(out: DataFrame) -> DataFrame:
    fold = F.log2((F.expm1("mean_1") + 1e-9) / (F.expm1("mean_2") + 1e-9))
    out = stats.benjamini_hochberg(out).withColumn("log2fc", fold)
    out = out.withColumn("de_in", F.when(F.col("log2fc") >= 0, "group1").otherwise("group2"))
    return out.drop("_s1", "_s2", "_q1", "_q2", "_e1", "_e2")


def de_wilcoxon(expr: DataFrame, groups: DataFrame, min_fraction: float = 0.05) -> DataFrame:
    """Rank-sum test of each gene by the normal approximation with tie correction: z, p_value, adj_p_value and more.

    Cells without the gene tie at the lowest value: their block isn't materialised. A gene's positive values are
    counted by value first, so that its window holds distinct values rather than cells."""
    own = groups.select("cell_id", "grp").distinct()
    is1 = F.when(F.col("grp") == 1, 1).otherwise(0)
    kinds = expr.where("value > 0").join(own, "cell_id").groupBy("gene", "value").agg(F.count("*").alias("m"), F.sum(is1).alias("m1"))
    out = _with_proportions(kinds.groupBy("gene").agg(F.sum("m1").alias("expressed_cells_1"), F.sum(F.col("m") - F.col("m1")).alias("expressed_cells_2"), F.sum(F.col("value") * F.col("m1")).alias("_s1"), F.sum(F.col("value") * (F.col("m") - F.col("m1"))).alias("_s2")), groups)
    out = out.where((F.col("proportion_1") >= min_fraction) | (F.col("proportion_2") >= min_fraction))
    out = out.withColumns({"_n": F.col("total_cells_1") + F.col("total_cells_2"), "_z1": F.col("total_cells_1") - F.col("expressed_cells_1")}).withColumn("_z", F.col("_n") - F.col("expressed_cells_1") - F.col("expressed_cells_2"))
    below = F.sum("m").over(Window.partitionBy("gene").orderBy("value")) - F.col("m")
    ranked = kinds.withColumn("_below", below).join(out.select("gene", "_z"), "gene")
    ranked = ranked.withColumn("_rank", F.col("_z") + F.col("_below") + (F.col("m") + 1) / 2)
    m = F.col("m").cast("double")
    sums = ranked.groupBy("gene").agg(F.sum(F.col("_rank") * F.col("m1")).alias("_r1"), F.sum(m * m * m - m).alias("_ties"))
    n, z, n1, n2 = (F.col(c).cast("double") for c in ("_n", "_z", "total_cells_1", "total_cells_2"))
    out = out.join(sums, "gene").withColumn("rank_sum", F.col("_r1") + F.col("_z1") * (F.col("_z") + 1) / 2).withColumn("_t", (F.col("_ties") + z * z * z - z) / (n * n * n - n))
    spread = F.sqrt(n1 * n2 * (n + 1) / 12 * (1 - F.col("_t")))
    out = out.withColumn("z", F.when(spread > 0, (F.col("rank_sum") - n1 * (n + 1) / 2) / spread)).withColumn("p_value", stats.p_normal(F.col("z")))
    out = out.withColumns({"mean_1": F.col("_s1") / n1, "mean_2": F.col("_s2") / n2})
    return _tested(out).drop("_n", "_z", "_z1", "_r1", "_ties", "_t")
