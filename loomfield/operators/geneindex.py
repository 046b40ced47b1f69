"""An inverted index from gene to cells: building, boolean search, similarity, itemsets, markers."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.functions import stats
from loomfield.sources import tables
from loomfield.sources.tables import written

from . import expression
from .patterns import maximal, mine


#: Bits up to which a quantile is found among literal bounds.
LITERAL_BITS = 8


def _normal() -> NormalDist:
    return NormalDist()


def _bucket(z: Column, bits: int) -> Column:
    """Which of 2**bits equal shares of the normal distribution z falls into, from 0."""
    if not 0 < bits < 32:
        raise ValueError("bits must be from 1 to 31")
    if bits <= LITERAL_BITS:
        bounds = F.array(*[F.lit(_normal().inv_cdf(j / (1 << bits))) for j in range(1, 1 << bits)])
        return F.size(F.filter(bounds, lambda b: b <= z))
    tables.ship(SparkSession.active())

    @F.pandas_udf("int")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series([min((1 << bits) - 1, int(math.erfc(-v / math.sqrt(2)) / 2 * (1 << bits))) for v in x], dtype="int32")

    return of(z)


def _middle(bucket: Column, bits: int) -> Column:
    """The normal quantile in the middle of a share."""
    if bits > 16:
        raise ValueError("values of more than 16 bits are not decoded")
    if bits <= LITERAL_BITS:
        return F.get(F.array(*[F.lit(_normal().inv_cdf((j + 0.5) / (1 << bits))) for j in range(1 << bits)]), bucket)
    tables.ship(SparkSession.active())

    @F.pandas_udf("double")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series([_normal().inv_cdf((v + 0.5) / (1 << bits)) for v in x], dtype="float64")

    return of(bucket)


def build(expr: DataFrame, bits: int = 2) -> DataFrame:
    """(fov, gene, cell_ids, n_cells, mu, sigma, quantiles, bits): ascending ids of the cells that express the gene, with
    the mean and deviation of ln(value), and each cell's quantile() under them. A field of view bounds what is gathered
    in one row."""
    own = quantize(expr.where("value > 0"), bits)
    out = own.groupBy("fov", "gene").agg(F.sort_array(F.collect_list(F.struct("cell_id", "bucket"))).alias("_c"), F.count("*").alias("n_cells"), F.avg("_ln").alias("mu"), F.coalesce(F.stddev_samp("_ln"), F.lit(0.0)).alias("sigma"))
    return out.select("fov", "gene", F.col("_c.cell_id").alias("cell_ids"), "n_cells", "mu", "sigma", F.col("_c.bucket").alias("quantiles"), F.lit(bits).alias("bits"))


def quantize(expr: DataFrame, bits: int = 2) -> DataFrame:
    """expr with a bucket of 0 to 2**bits - 1 and `_ln` in place of the value: which share of the log-normal distribution
    of the gene in its field of view the value falls into. One value, or equal ones, are its middle."""
    w = Window.partitionBy("fov", "gene")
    out = expr.withColumn("_ln", F.log("value"))
    z = F.coalesce((F.col("_ln") - F.avg("_ln").over(w)) / F.nullif(F.stddev_samp("_ln").over(w), F.lit(0.0)), F.lit(0.0))
    return out.withColumn("_z", z).withColumn("bucket", _bucket(F.col("_z"), bits)).drop("value", "_z")


def _one_width(index: DataFrame) -> int:
    widths = [r[0] for r in index.select("bits").distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError("the index has quantiles of different bits")
    return widths[0] if widths else 2


def expression_of(index: DataFrame, fov: str | None = None) -> DataFrame:
    """The expression again: (fov, gene, cell_id, value), each value the one in the middle of its quantile."""
    own = index if fov is None else index.where(F.col("fov") == fov)
    rows = own.select("fov", "gene", "mu", "sigma", F.explode(F.arrays_zip("cell_ids", "quantiles")).alias("c"))
    return rows.select("fov", "gene", F.col("c.cell_ids").alias("cell_id"), F.exp(F.col("mu") + F.col("sigma") * _middle(F.col("c.quantiles"), _one_width(index))).alias("value"))


def cells_of(index: DataFrame, fov: str | None = None) -> DataFrame:
    """The postings as rows again: (fov, gene, cell_id)."""
    own = index if fov is None else index.where(F.col("fov") == fov)
    return own.select("fov", "gene", F.explode("cell_ids").alias("cell_id"))


def posting(index: DataFrame, number: int) -> DataFrame:
    """The cells of one posting, by its number from 0 in the order of gene and field of view."""
    return cells_of(index.orderBy("gene", "fov").offset(number).limit(1))


def genes_by_cell(index: DataFrame, genes: list[str]) -> DataFrame:
    """The genes' postings turned round: (fov, cell_id, genes), the names joined by commas."""
    return any_of(index, genes).groupBy("fov", "cell_id").agg(F.array_join(F.sort_array(F.collect_set("gene")), ",").alias("genes"))


def merge(*indexes: DataFrame) -> DataFrame:
    """Several indexes as one; quantiles of different bits raise ValueError."""
    out = tables.merge(*indexes)
    _one_width(out)
    return out


def resolve(index: DataFrame, genes: list[str]) -> list[str]:
    """The index's names of the genes, found whatever their case; unknown ones are dropped."""
    low = [g.lower() for g in genes]
    return [r[0] for r in index.where(F.lower("gene").isin(low)).select("gene").distinct().orderBy("gene").collect()]


def search(index: DataFrame, genes: list[str], fovs: list[str] | None = None) -> DataFrame:
    """(fov, cell_id) of cells that a boolean query selects. A plain name must be expressed; of those marked * one at
    least; cells that express all those marked - are left out, and so are those with any marked *-. Names match in any
    case. Marked names alone start from all cells that express any gene."""
    plain = [g for g in genes if g[0] not in "*-"]
    some = [g[1:] for g in genes if g[0] == "*" and g[:2] != "*-"]
    none_of_all, none_of_any = [g[1:] for g in genes if g[0] == "-"], [g[2:] for g in genes if g[:2] == "*-"]
    own = index if fovs is None else index.where(F.col("fov").isin(fovs))
    if plain or some:
        own = own.where(F.lower("gene").isin([g.lower() for g in [*plain, *some, *none_of_all, *none_of_any]]))
    has = lambda g: F.max(F.when(F.lower("gene") == g.lower(), 1).otherwise(0)) == 1
    met = cells_of(own).groupBy("fov", "cell_id")
    conditions: list[Column] = [has(g) for g in plain]
    if some:
        conditions.append(reduce(Column.__or__, map(has, some)))
    if none_of_all:
        conditions.append(~reduce(Column.__and__, map(has, none_of_all)))
    if none_of_any:
        conditions.append(~reduce(Column.__or__, map(has, none_of_any)))
    return met.agg(reduce(Column.__and__, conditions).alias("_ok")).where("_ok").select("fov", "cell_id")


def any_of(index: DataFrame, genes: list[str]) -> DataFrame:
    """Postings of the genes, by gene: (gene, fov, cell_id)."""
    return cells_of(index.where(F.lower("gene").isin([g.lower() for g in genes]))).select("gene", "fov", "cell_id")


def similar(index: DataFrame, genes: list[str], top_k: int = 5, fovs: list[str] | None = None) -> DataFrame:
    """The top_k genes whose cells are most like those that express all the genes: (gene, jaccard, overlap, n)."""
    own = index if fovs is None else index.where(F.col("fov").isin(fovs))
    query = search(own, genes)
    n_query = query.agg(F.count("*")).scalar()
    rest = own.where(~F.lower("gene").isin([g.lower() for g in genes]))
    n = rest.groupBy("gene").agg(F.sum("n_cells").alias("n"))
    overlap = cells_of(rest).join(query, ["fov", "cell_id"]).groupBy("gene").agg(F.count("*").alias("overlap"))
    out = n.join(overlap, "gene", "left").fillna(0, ["overlap"]).withColumn("_q", n_query).withColumn("jaccard", F.col("overlap") / (F.col("_q") + F.col("n") - F.col("overlap")))
    return out.drop("_q").orderBy(F.desc("jaccard"), "gene").limit(top_k).select("gene", "jaccard", "overlap", "n")


def gene_support(index: DataFrame, genes: list[str] | None = None) -> DataFrame:
    """(gene, fov, n_cells), and with it totals by any group."""
    own = index if genes is None else index.where(F.col("gene").isin(genes))
    return own.select("gene", "fov", "n_cells")


def cell_meta(expr: DataFrame) -> DataFrame:
    """(fov, cell_id, reads, features): the sum of whole values, and the number of genes, of each cell."""
    return expr.where("value > 0").groupBy("fov", "cell_id").agg(F.sum(F.floor("value")).alias("reads"), F.count("*").alias("features"))


def tf_idf(expr: DataFrame, genes: list[str], n_cells: int) -> DataFrame:
    """(gene, tf_idf): the mean over its cells of value / reads, times n_cells / cells with the gene."""
    reads = expr.groupBy("fov", "cell_id").agg(F.sum("value").alias("reads"))
    own = expr.where(F.col("gene").isin(genes)).join(reads, ["fov", "cell_id"])
    return own.groupBy("gene").agg((F.avg(F.col("value") / F.col("reads")) * n_cells / F.count("*")).alias("tf_idf"))


def support_cutoff(expr: DataFrame, genes: list[str]) -> int:
    """How many cells a set of the genes must be in: 1 for at most seven genes, else the middle one of a proposal a gene.

    A gene's proposal is the number of other genes that its cells express besides, a gene of the list, times the mean
    number of genes in a cell by the logarithm of the list's length."""
    if len(genes) <= 7:
        return 1
    n = len(genes)
    own = expr.where((F.col("value") > 0) & F.col("gene").isin(genes)).withColumn("_k", F.count("*").over(Window.partitionBy("fov", "cell_id")))
    per = own.groupBy("gene").agg(F.sum(F.col("_k") - 1).alias("others"), F.count("*").alias("support")).collect()  # a row a gene of the list
    cells = own.select("fov", "cell_id").distinct().count()
    overlap = sum(r["support"] for r in per) / max(1, cells) / math.log(n)
    proposed = sorted([int(r["others"] / n * overlap) for r in per] + [0] * (n - len(per)))
    return max(1, proposed[min(n - 1, int(n * 0.5 + 0.5))])


def gene_patterns(expr: DataFrame, genes: list[str] | None = None, min_cells: int = 1) -> DataFrame:
    """(itemset, freq): sets of two genes or more that min_cells cells express together. Cells with one gene count for
    no set."""
    own = expr.where("value > 0") if genes is None else expr.where((F.col("value") > 0) & F.col("gene").isin(genes))
    own = written(own.groupBy("fov", "cell_id").agg(F.sort_array(F.collect_set("gene")).alias("labels")).where(F.size("labels") > 1), "sets")
    least = min_cells / max(1, own.count())
    return mine(own.withColumn("_all", F.lit(1)), least * (1 - 1e-12), ["_all"]).where((F.size("itemset") > 1) & (F.col("freq") >= min_cells)).select("itemset", "freq")


def itemsets(expr: DataFrame, genes: list[str], n_cells: int, min_cells: int = 1) -> DataFrame:
    """(genes, query, tf_idf, n_cells): gene_patterns() of the genes. A set's score is its least tf_idf times the sum."""
    found = gene_patterns(expr, genes, min_cells)
    scores = tf_idf(expr, genes, n_cells)
    scored = found.select("itemset", "freq", F.explode("itemset").alias("gene")).join(scores, "gene").groupBy("itemset").agg(F.first("freq").alias("n_cells"), (F.min("tf_idf") * F.sum("tf_idf")).alias("tf_idf"))
    return scored.select(F.size("itemset").alias("genes"), F.array_join("itemset", ",").alias("query"), "tf_idf", "n_cells")


def marker_genes(expr: DataFrame, genes: list[str], n_cells: int, exhaustive: bool = False, min_cells: int = -1) -> DataFrame:
    """itemsets() of the genes that support_cutoff() cells hold together, or min_cells where that isn't -1; all sets that
    any cell holds, if exhaustive. Names are found in any case."""
    names = [r[0] for r in expr.where(F.lower("gene").isin([g.lower() for g in genes])).select("gene").distinct().collect()]
    return itemsets(expr, names, n_cells, 1 if exhaustive else support_cutoff(expr, names) if min_cells == -1 else min_cells)


def maximal_itemsets(expr: DataFrame, genes: list[str], min_support: float) -> DataFrame:
    """Maximal sets of the genes that a share of the cells with any of them express together."""
    own = expr.where(F.col("gene").isin(genes)).groupBy("fov", "cell_id").agg(F.sort_array(F.collect_set("gene")).alias("labels"))
    return maximal(mine(own, min_support))


def label_totals(cells: DataFrame) -> DataFrame:
    """(label, total_cells) of every label."""
    return cells.groupBy("label").agg(F.count("*").alias("total_cells"))


def de_fisher(index: DataFrame, groups: DataFrame, min_fraction: float = 0.05, alpha: float | None = 0.1, ties: str | None = "group1") -> DataFrame:
    """The Fisher test of expression.de_fisher() from an index: its postings say which cells express a gene."""
    return expression.de_fisher(cells_of(index).withColumn("value", F.lit(1.0)), groups, min_fraction, alpha, ties)


def label_hits(expr: DataFrame, cells: DataFrame, genes: list[str] | None = None) -> DataFrame:
    """(gene, label, tp, total): cells of the label with the gene, and all of the label, also where tp is 0."""
    own = expr.where("value > 0") if genes is None else expr.where((F.col("value") > 0) & F.col("gene").isin(genes))
    hits = own.groupBy("gene", "label").agg(F.count("*").alias("tp"))
    totals = cells.groupBy("label").agg(F.count("*").alias("total"))
    every = totals.agg(F.collect_list(F.struct("label", "total")).alias("x"))
    frame = own.select("gene").distinct().withColumn("_x", every.scalar()).select("gene", F.explode("_x").alias("x")).select("gene", "x.label", "x.total")
    return frame.join(hits, ["gene", "label"], "left").fillna(0, ["tp"])


def markers(expr: DataFrame, cells: DataFrame, genes: list[str] | None = None) -> DataFrame:
    """(label, gene, tp, fp, fn, precision, recall, f1) of each gene as a marker of each label."""
    hits = label_hits(expr, cells, genes)
    out = hits.withColumn("fp", F.sum("tp").over(Window.partitionBy("gene")) - F.col("tp")).withColumn("fn", F.col("total") - F.col("tp"))
    out = out.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.col("tp") / F.col("total")})
    f1 = F.when(F.col("tp") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.select("label", "gene", "tp", "fp", "fn", "precision", "recall", f1.alias("f1"))


def markers_of_all(expr: DataFrame, cells: DataFrame, genes: list[str]) -> DataFrame:
    """markers() of the cells that express every one of the genes: (label, tp, fp, fn, precision, recall, f1)."""
    both = expr.where((F.col("value") > 0) & F.col("gene").isin(genes)).groupBy("fov", "cell_id", "label").agg(F.count_distinct("gene").alias("n")).where(F.col("n") == len(set(genes)))
    one = both.select("fov", "cell_id", "label", F.lit("*").alias("gene"), F.lit(1.0).alias("value"))
    return markers(one, cells).drop("gene")


def specificities(expr: DataFrame, cells: DataFrame, genes: list[str] | None = None, min_cells: int = 10, min_fraction: float = 0.25) -> DataFrame:
    """(gene, n_labels): labels where more cells have the gene than min_cells and than a share of the label."""
    hits = label_hits(expr, cells, genes)
    return hits.groupBy("gene").agg(F.sum(F.when(F.col("tp") > F.greatest(F.lit(min_cells), F.col("total") * min_fraction), 1).otherwise(0)).alias("n_labels"))


def dataset_specificities(expr: DataFrame, genes: list[str] | None = None, min_cells: int = 10) -> DataFrame:
    """(gene, n_datasets): datasets where more than min_cells cells have the gene."""
    own = expr.where("value > 0") if genes is None else expr.where((F.col("value") > 0) & F.col("gene").isin(genes))
    per = own.groupBy("gene", "dataset").agg(F.count("*").alias("n"))
    return per.groupBy("gene").agg(F.sum(F.when(F.col("n") > min_cells, 1).otherwise(0)).alias("n_datasets"))


def housekeeping(expr: DataFrame, cells: DataFrame, labels: list[str] | None = None, min_recall: float = 0.5, max_genes: int = 1000) -> DataFrame:
    """(gene, min_recall): genes whose recall is over min_recall in every label, at most max_genes by recall."""
    own = cells if labels is None else cells.where(F.col("label").isin(labels))
    per = label_hits(expr.join(own.select("label").distinct(), "label", "left_semi"), own).withColumn("r", F.col("tp") / F.col("total"))
    out = per.groupBy("gene").agg(F.min("r").alias("min_recall")).where(F.col("min_recall") > min_recall)
    return out.orderBy(F.desc("min_recall"), "gene").limit(max_genes)


def signatures(expr: DataFrame, cells: DataFrame, labels: list[str] | None = None, max_genes: int = 1000, min_cells: int = 10, max_pval: float = 0.05) -> DataFrame:
    """(label, step, gene, cell_hits, p_value): genes whose joint expression marks each label; all labels, if None.

    A label's genes are taken by falling recall, max_genes of them at most. A step asks for the cells that express all
    genes so far; the signature ends before the first step that leaves fewer than min_cells cells of the label, or whose
    enrichment in it has a hypergeometric p, by Holm's steps over all labels, of over max_pval.

    No step is asked for by itself: a cell answers all those of a label up to the length of its run of leading genes, so
    a count by run length holds every step."""
    hits = label_hits(expr, cells)
    ranked = hits if labels is None else hits.where(F.col("label").isin(labels))
    order = Window.partitionBy("label").orderBy(F.desc(F.col("tp") / F.col("total")), "gene")
    ranked = written(ranked.withColumn("step", F.row_number().over(order)).where(F.col("step") <= max_genes).select(F.col("label").alias("of"), "step", "gene"), "ranked")
    runs = expr.where("value > 0").join(ranked, "gene").groupBy("of", "fov", "cell_id", "label").agg(F.sort_array(F.collect_list("step")).alias("_s"))
    runs = runs.withColumn("run", F.size(F.filter("_s", lambda x, i: x == i + 1))).where("run > 0").groupBy("of", "label", "run").agg(F.count("*").alias("n"))
    counts = runs.select("of", "label", "n", F.explode(F.sequence(F.lit(1), "run")).alias("step")).groupBy("of", "label", "step").agg(F.sum("n").alias("hits"))
    totals = cells.groupBy("label").agg(F.count("*").alias("total"))
    every = ranked.select("of", "step").withColumn("_t", totals.agg(F.collect_list(F.struct("label", "total"))).scalar()).select("of", "step", F.explode("_t").alias("t")).select("of", "step", "t.*")
    found = every.join(counts, ["of", "label", "step"], "left").fillna(0, ["hits"]).withColumn("_drawn", F.sum("hits").over(Window.partitionBy("of", "step")))
    found = found.withColumn("_n", cells.agg(F.count("*")).scalar()).withColumn("p_value", stats.p_enriched(F.col("hits") - 1, F.col("_n"), F.col("total"), F.col("_drawn")))
    own = stats.holm(found, "p_value", "adj", ["of", "step"]).where("label = of")
    ends = F.min(F.when((F.col("hits") < min_cells) | (F.col("adj") > max_pval), F.col("step"))).over(Window.partitionBy("of"))
    kept = own.withColumn("_end", ends).where("_end is null or step < _end")
    return kept.join(ranked, ["of", "step"]).select(F.col("of").alias("label"), "step", "gene", F.col("hits").alias("cell_hits"), F.col("adj").alias("p_value"))


def hypergeometric_query(expr: DataFrame, cells: DataFrame, genes: list[str], alpha: float | None = 0.05) -> DataFrame:
    """(label, cell_hits, total_cells, p_value, adj_p_value): labels enriched among the cells with all the genes, by
    P(X >= hits) and Holm's steps; those under alpha, or all with None."""
    found = markers_of_all(expr, cells, genes).select("label", F.col("tp").alias("cell_hits"), (F.col("tp") + F.col("fn")).alias("total_cells"), (F.col("tp") + F.col("fp")).alias("_drawn"))
    n = cells.agg(F.count("*")).scalar()
    out = found.withColumn("_n", n).withColumn("p_value", stats.p_enriched(F.col("cell_hits") - 1, F.col("_n"), F.col("total_cells"), F.col("_drawn")))
    out = stats.holm(out).drop("_drawn", "_n")
    return out if alpha is None else out.where(F.col("adj_p_value") < alpha)
