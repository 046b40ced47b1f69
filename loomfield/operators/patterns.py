"""Frequent label sets of neighbourhoods, their maximal ones, and what stands behind them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.sources.tables import written

from .neighbors import BUCKET, by_center

#: Labels in one transaction up to which all its subsets are counted at once; wider ones are mined level by level.
ENUMERATED = 8


def label_counts(pairs: DataFrame) -> DataFrame:
    """The neighbourhood matrix in long form: (fov, center_id, neighbor_label, n)."""
    return pairs.groupBy("dataset", *by_center(pairs), "neighbor_label").agg(F.count("*").alias("n")).drop(*BUCKET)


def transactions(pairs: DataFrame, min_size: int = 0, centers: DataFrame | None = None) -> DataFrame:
    """(dataset, fov, center_id, labels, size): distinct labels of neighbourhoods with size > min_size. With centers,
    those without neighbours count too, as empty transactions."""
    out = pairs.groupBy("dataset", *by_center(pairs)).agg(F.sort_array(F.collect_set("neighbor_label")).alias("labels"), F.count("*").alias("size")).drop(*BUCKET)
    if centers is not None:
        every = centers.select("dataset", "fov", F.col("cell_id").alias("center_id"))
        out = every.join(out, ["dataset", "fov", "center_id"], "left").withColumns({"labels": F.coalesce("labels", F.array().cast("array<string>")), "size": F.coalesce("size", F.lit(0).cast("long"))})
        return out
    return out.where(F.col("size") > min_size)


def _subsets(labels: Column) -> Column:
    """All non-empty subsets of a sorted array, each sorted."""
    empty = F.array(F.array().cast("array<string>"))
    return F.filter(F.aggregate(labels, empty, lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.array_append(s, x)))), lambda s: F.size(s) > 0)


def mine(sets: DataFrame, min_support: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """(by, itemset, freq, support) with support >= min_support, the share of the group's transactions.

    Equal label sets are counted first, so what is mined is the distinct sets, few however many cells there are. Where
    the widest has at most ENUMERATED labels, all subsets are counted in one pass. Else FP-growth mines all sets
    pooled, and groups are mined level by level."""
    by = by or []
    kinds = written(sets.groupBy(*by, "labels").agg(F.count("*").alias("_n")), "kinds")
    total = kinds.groupBy(*by).agg(F.sum("_n").alias("_total"))
    widest = kinds.agg(F.max(F.size("labels"))).first()[0] or 0
    if widest <= ENUMERATED:
        found = kinds.select(*by, F.explode(_subsets(F.col("labels"))).alias("itemset"), "_n").groupBy(*by, "itemset").agg(F.sum("_n").alias("freq"))
    elif by:
        found = _levels(kinds, total, min_support, by)
    else:
        from pyspark.ml.fpm import FPGrowth

        found = FPGrowth(itemsCol="labels", minSupport=min_support).fit(sets).freqItemsets.select(F.sort_array("items").alias("itemset"), "freq")
    joined = found.join(total, by) if by else found.withColumn("_total", total.scalar())
    return joined.withColumn("support", F.col("freq") / F.col("_total")).where(F.col("support") >= min_support).drop("_total")


def _levels(kinds: DataFrame, total: DataFrame, min_support: float, by: list[str]) -> DataFrame:
    """(by, itemset, freq) of the frequent sets of each group, shorter ones first: a set grows by each of its
    transaction's frequent labels that come after its last, and only frequent sets go on to the next level."""
    kinds = kinds.withColumn("_kind", F.xxhash64("labels"))
    enough = lambda counted: counted.join(total, by).where(F.col("freq") >= min_support * F.col("_total") - 1e-9).drop("_total")
    each = kinds.select(*by, "_kind", "_n", F.explode("labels").alias("_l"))
    one = enough(each.groupBy(*by, "_l").agg(F.sum("_n").alias("freq")))
    kept = each.join(one.select(*by, "_l"), [*by, "_l"], "left_semi").groupBy(*by, "_kind", "_n").agg(F.sort_array(F.collect_list("_l")).alias("_labels"))
    held = kept.select("*", F.explode(F.transform("_labels", lambda x: F.array(x))).alias("itemset"))
    found = one.select(*by, F.array("_l").alias("itemset"), "freq")
    while True:
        longer = F.transform(F.filter("_labels", lambda x: x > F.element_at("itemset", -1)), lambda x: F.array_append("itemset", x))
        wide = held.select(*by, "_kind", "_n", "_labels", F.explode(longer).alias("itemset"))
        level = written(enough(wide.groupBy(*by, "itemset").agg(F.sum("_n").alias("freq"))), "level")
        if not level.take(1):
            return found
        found = found.unionByName(level)
        held = written(wide.join(level.select(*by, "itemset"), [*by, "itemset"], "left_semi"), "held")


def maximal(found: DataFrame, by: list[str] | None = None, key: str = "itemset") -> DataFrame:
    """The patterns that no other contains. Frequent sets are closed downwards, so a set that isn't maximal is another
    one less a single label: an equality join finds it."""
    by = by or []
    less = found.where(F.size(key) > 1).select(*by, F.explode(F.transform(F.col(key), lambda x: F.array_remove(F.col(key), x))).alias(key))
    return found.join(less.distinct(), [*by, key], "left_anti")


def maximal_of_any(found: DataFrame, key: str = "itemset") -> DataFrame:
    """The sets in the column key that no other row strictly contains, for tables that aren't closed downwards: sets
    meet on each label, and a set that another has all labels of is dropped."""
    found = written(found, "sets")  # four parts of the plan read it
    own = found.select(F.sort_array(F.array_distinct(key)).alias("_s")).distinct()
    at = own.select(F.explode("_s").alias("_l"), "_s")
    over = at.join(at.select("_l", F.col("_s").alias("_t")), "_l").where("size(_s) < size(_t)").groupBy("_s", "_t").count().where("count = size(_s)")
    return found.join(over.select("_s").distinct(), F.sort_array(F.array_distinct(key)) == F.col("_s"), "left_anti")


def holds(labels: Column, motif: Column) -> Column:
    """Whether an array has every label of the motif."""
    return F.size(F.array_except(motif, labels)) == 0


def with_motif(pairs: DataFrame, motif: list[str], min_size: int = 0) -> DataFrame:
    """The pairs of centers whose neighbourhood, of min_size or more, has every label of the motif."""
    own = Window.partitionBy(*by_center(pairs))
    has = [F.max(F.col("neighbor_label") == m).over(own) for m in motif]
    ok = {"_has": reduce(Column.__and__, has, F.lit(True)), "_size": F.count("*").over(own)}
    return pairs.withColumns(ok).where(F.col("_has") & (F.col("_size") >= min_size)).drop(*ok)


def has_motif(neighbors: Column, motif: Column) -> Column:
    """Multiset containment: the array has each label at least as often as the motif."""
    return F.forall(motif, lambda m: F.size(F.filter(neighbors, lambda x: x == m)) >= F.size(F.filter(motif, lambda x: x == m)))


def behind(found: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """found and neighbor_ids: the cells with a label of the pattern in the neighbourhoods that have all of it.

    Patterns are few (subsets of the labels), so each transaction is matched with them where it is."""
    patterns = found.select("itemset").distinct().agg(F.collect_list("itemset").alias("_p"))
    matched = sets.withColumn("_p", patterns.scalar()).select("fov", "center_id", F.explode(F.filter("_p", lambda p: holds(F.col("labels"), p))).alias("itemset"))
    cells = matched.join(pairs.select("fov", "center_id", "neighbor_id", "neighbor_label"), ["fov", "center_id"]).where(F.array_contains("itemset", F.col("neighbor_label")))
    ids = cells.select("itemset", "fov", "neighbor_id").distinct().groupBy("itemset").agg(F.sort_array(F.collect_list("neighbor_id")).alias("neighbor_ids"))
    return found.join(ids, "itemset", "left")
