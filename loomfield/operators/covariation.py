"""Covariation of gene pairs between centres and their neighbours, from sums that merge over fields of view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions import stats
from loomfield.sources.tables import ROWS, dealt, shares, stored, written

from .expression import frequent_genes, label_means
from .neighbors import check_label, known_labels, neighbors, parts
from .patterns import with_motif

KEPT = ["dataset", "fov", "center_id", "neighbor_id", "neighbor_label"]


def motif_pairs(cells: DataFrame, ct: str, motif: list[str], max_dist: float | None = None, k: int | None = None, min_size: int = 0) -> DataFrame:
    """Distinct pairs of centres of label ct whose neighbourhood has the motif, and their neighbours with its labels.

    By radius, a neighbourhood of fewer than min_size doesn't qualify. If ct is in the motif, neighbours labelled ct
    stand on the centres' side: each centre and each of its ct-neighbours pairs with its other motif neighbours."""
    own, of_motif = cells.where(F.col("label") == ct), F.col("label").isin(motif)
    if k is None and min_size <= 0:  # the motif's labels alone decide, so no other cell is part of the join
        near = with_motif(neighbors(cells.where(of_motif), own, max_dist, n=parts(cells)), motif).select(KEPT)
    else:
        near = with_motif(neighbors(cells, own, max_dist, k), motif, min_size if k is None else 0)
        near = near.where(F.col("neighbor_label").isin(motif)).select(KEPT)
    if ct not in motif:
        return written(near.distinct(), "pairs")
    other = near.where(F.col("neighbor_label") != ct)
    own = near.where(F.col("neighbor_label") == ct).select("fov", "center_id", F.col("neighbor_id").alias("_own"))
    moved = own.join(other, ["fov", "center_id"]).select("dataset", "fov", F.col("_own").alias("center_id"), "neighbor_id", "neighbor_label")
    return written(other.unionByName(moved).distinct(), "pairs")


def free_cells(cells: DataFrame, ct: str, pairs: DataFrame) -> DataFrame:
    """The cells without part in the pairs: those labelled ct that are no centre, the others that are no neighbour."""
    side = lambda c, own: pairs.select("fov", F.col(c).alias("cell_id"), F.lit(own).alias("_own"))
    used = side("center_id", True).unionByName(side("neighbor_id", False)).distinct()
    return cells.withColumn("_own", F.col("label") == ct).join(used.hint("shuffle_hash"), ["fov", "cell_id", "_own"], "left_anti").drop("_own").select(cells.columns)


def other_pairs(cells: DataFrame, ct: str, without: DataFrame, max_dist: float | None = None, k: int | None = None, min_size: int = 0, free: DataFrame | None = None) -> DataFrame:
    """Distinct pairs of centres of label ct and neighbours of other labels, less the centres and neighbours of the
    pairs `without`; free are the free_cells() of those, if at hand."""
    free = written(free_cells(cells, ct, without), "free") if free is None else free
    own = free.where(F.col("label") == ct)
    if k is None and min_size <= 0:  # what isn't asked for is no part of the join
        return neighbors(free.where(F.col("label") != ct), own, max_dist, n=parts(cells)).select(KEPT).distinct()
    near = neighbors(cells, own, max_dist, k)
    if k is None:
        near = with_motif(near, [], min_size)
    taken = without.select("fov", "neighbor_id").distinct()
    return near.where(F.col("neighbor_label") != ct).join(taken, ["fov", "neighbor_id"], "left_anti").select(KEPT).distinct()


def distant_cells(cells: DataFrame, ct: str, motif: list[str], pairs: DataFrame, free: DataFrame | None = None) -> DataFrame:
    """(fov, cell_id, label): cells with a label of the motif, not ct, that are no neighbour in the pairs; free as in
    other_pairs()."""
    of_motif = F.col("label").isin(motif) & (F.col("label") != ct)
    if free is None:
        free = cells.where(of_motif).join(pairs.select("fov", F.col("neighbor_id").alias("cell_id")).distinct(), ["fov", "cell_id"], "left_anti")
    return free.where(of_motif).select("fov", "cell_id", "label")


def _pair_cells(pairs: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """(set, side, keys, fov, cell_id, l) of the set n: the centre of each pair and its neighbour, as c and n, with the
    neighbour's label."""
    side = lambda c, s: pairs.select(F.lit(n).alias("set"), F.lit(s).alias("side"), *keys, "fov", F.col(c).alias("cell_id"), F.col("neighbor_label").alias("l"))
    return side("center_id", "c").unionByName(side("neighbor_id", "n"))


def _distant_cells(centers: DataFrame, distant: DataFrame, n: int, keys: list[str], ct: str) -> DataFrame:
    """As _pair_cells(), of centres, which may be named more than once, and distant cells, each with its own label."""
    own = centers.select(F.lit(n).alias("set"), F.lit("c").alias("side"), *keys, "fov", "cell_id", F.lit(ct).alias("l"))
    return own.unionByName(distant.select(F.lit(n).alias("set"), F.lit("n").alias("side"), *keys, "fov", "cell_id", F.col("label").alias("l")))


class _Sums:
    """What the covariances are made of, for several sets of pairs at once. Genes are numbered and a cell's expression
    is one row, so that joins have a row for each cell or pair, and not one for each of its genes:

    - cells: (set, side, keys, fov, cell_id, l, k), each cell of a set once for each label, k times among its pairs
    - numbers: (set, side, keys, fov, l, n), the sum of k
    - sums: (set, side, keys, fov, l, gene, s, q), the sums of k * e and k * e * e
    - products: (set, keys, g, h, s), the sum over pairs of e(centre, g) * e(neighbour, h)

    A centre of the set `once` counts once. Both sides of a join are dealt to parts that follow the tables' rows."""

    def __init__(self, cells: DataFrame, pairs: DataFrame | None, expr: DataFrame, genes: DataFrame, keys: list[str], once: int | None = None):
        self.genes = written(genes.select("gene").distinct().withColumn("no", F.monotonically_increasing_id()), "genes")
        n = expr.count()
        self.parts = shares(expr.sparkSession, n, 2 * ROWS)
        one = expr.join(F.broadcast(self.genes), "gene").select("fov", "cell_id", F.struct("no", F.col("value").alias("e")).alias("v"))
        self.vectors = written(one.repartition(shares(expr.sparkSession, n, ROWS), "fov", "cell_id").groupBy("fov", "cell_id").agg(F.collect_list("v").alias("v")), "vectors")
        of = ["set", "side", *keys, "fov", "l"]
        k = F.when((F.col("set") == once) & (F.col("side") == "c"), F.lit(1).cast("long")).otherwise(F.count("*"))
        self.cells = written(cells.repartition(self.parts, "fov", "cell_id").groupBy(*of, "cell_id").agg(k.alias("k")), "cells")
        self.numbers = written(self.cells.groupBy(*of).agg(F.sum("k").alias("n")), "numbers")
        met = self._meet(self.cells, "cell_id").select(*of, "k", F.inline("v"))
        sums = met.groupBy(*of, "no").agg(F.sum(F.col("k") * F.col("e")).alias("s"), F.sum(F.col("k") * F.col("e") * F.col("e")).alias("q"))
        self.sums = written(sums.join(F.broadcast(self.genes), "no").drop("no"), "sums")
        if pairs is not None:
            self.products = written(self._products(pairs, keys), "products")

    def _meet(self, rows: DataFrame, id_: str) -> DataFrame:
        """rows, and v, the expression of the cell that the column id_ names."""
        v = dealt(self.vectors.select("fov", F.col("cell_id").alias(id_), F.col("v").alias("_v")), self.parts, ["fov", id_], {"_v": "v"})
        return rows.repartition(self.parts, "fov", id_).join(v.hint("shuffle_hash"), ["fov", id_])

    def _products(self, pairs: DataFrame, keys: list[str]) -> DataFrame:
        """The neighbours' values are summed for each centre first, so its own meet a row for each gene round it."""
        to = ["set", *keys]
        met = self._meet(pairs.select(*to, "fov", "center_id", "neighbor_id"), "neighbor_id").select(*to, "fov", "center_id", "v")
        round_ = met.repartition(self.parts, "fov", "center_id").select(*to, "fov", "center_id", F.inline("v").alias("h", "e")).groupBy(*to, "fov", "center_id", "h").agg(F.sum("e").alias("s"))
        v = self.vectors.withColumnRenamed("cell_id", "center_id").repartition(self.parts, "fov", "center_id")
        both = round_.join(v.hint("shuffle_hash"), ["fov", "center_id"]).select(*to, "h", "s", F.inline("v").alias("g", "e"))
        out = both.groupBy(*to, "g", "h").agg(F.sum(F.col("s") * F.col("e")).alias("s"))
        name = lambda c: F.broadcast(self.genes.select(F.col("no").alias(c), F.col("gene").alias(f"_{c}")))
        return out.join(name("g"), "g").join(name("h"), "h").select(*to, F.col("_g").alias("g"), F.col("_h").alias("h"), "s")

    def of(self, table: DataFrame, n: int, side: str | None = None) -> DataFrame:
        own = table.where(F.col("set") == n)
        return own.drop("set") if side is None else own.where(F.col("side") == side).drop("set", "side")

    def counts(self, n: int, side: str, keys: list[str], k: bool = False) -> DataFrame:
        """(keys, fov, n): distinct cells of a side, or with k all of its rows."""
        if k:
            return self.of(self.numbers, n, side).groupBy(*keys, "fov").agg(F.sum("n").alias("n"))
        return self.of(self.cells, n, side).groupBy(*keys, "fov").agg(F.count_distinct("cell_id").alias("n"))

    def paired(self, n: int, mu: DataFrame, ct: str, keys: list[str]) -> DataFrame:
        """paired_sums() of the set n, from the label means mu of the genes."""
        on = [*keys, "fov"]
        per_center = self.of(self.sums, n, "c").select(*on, "l", F.col("gene").alias("g"), F.col("s").alias("a"), F.col("q").alias("a2"))
        by_neighbor = self.of(self.sums, n, "n").select(*on, "l", F.col("gene").alias("h"), F.col("s").alias("c"), F.col("q").alias("c2"))
        product = self.of(self.products, n).select(*keys, "g", "h", "s")
        k_label = self.of(self.numbers, n, "n").select(*on, "l", F.col("n").alias("k"))

        places = k_label.groupBy(*on).agg(F.sum("k").alias("n"))
        every = places.withColumn("_g", self.genes.agg(F.collect_list("gene")).scalar()).select(*on, "n", F.explode("_g").alias("gene"))
        mu_ct = mu.where(F.col("label") == ct).select("fov", "gene", F.col("mean").alias("mu"))
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        left = every.join(mu_ct, ["fov", "gene"], "left").join(per_center.groupBy(*on, F.col("g").alias("gene")).agg(F.sum("a").alias("a"), F.sum("a2").alias("a2")), [*on, "gene"], "left")
        m = zero(F.col("mu"))
        left = written(left.select(*on, F.col("gene").alias("g"), m.alias("mu"), (zero(F.col("a2")) - 2 * m * zero(F.col("a")) + F.col("n") * m * m).alias("ss")), "sums")
        shift = k_label.join(mu.select("fov", F.col("label").alias("l"), F.col("gene").alias("h"), "mean"), ["fov", "l"])
        shift = shift.groupBy(*on, "h").agg(F.sum(F.col("k") * F.col("mean")).alias("m"), F.sum(F.col("k") * F.col("mean") * F.col("mean")).alias("m2"))
        cross = by_neighbor.join(mu.select("fov", F.col("label").alias("l"), F.col("gene").alias("h"), "mean"), ["fov", "l", "h"], "left").groupBy(*on, "h").agg(F.sum("c").alias("c"), F.sum("c2").alias("c2"), F.sum(F.col("c") * zero(F.col("mean"))).alias("cm"))
        right = every.withColumnRenamed("gene", "h").join(shift, [*on, "h"], "left").join(cross, [*on, "h"], "left")
        right = written(right.select(*on, "h", (zero(F.col("c")) - zero(F.col("m"))).alias("d"), (zero(F.col("c2")) - 2 * zero(F.col("cm")) + zero(F.col("m2"))).alias("ss")), "sums")

        lhs = per_center.select(*on, "l", "g", F.col("a").alias("u")).unionByName(left.select(*on, F.lit("").alias("l"), "g", F.col("mu").alias("u")))
        labels = mu.select("fov", F.col("label").alias("l"), F.col("gene").alias("h"), F.col("mean").alias("v")).join(k_label.select(*on, "l"), ["fov", "l"])
        rhs = labels.select(*on, "l", "h", "v").unionByName(right.select(*on, F.lit("").alias("l"), "h", F.col("d").alias("v")))
        rest = lhs.join(rhs, [*on, "l"]).groupBy(*keys, "g", "h").agg(F.sum(F.col("u") * F.col("v")).alias("t"))
        out = rest.join(product, [*keys, "g", "h"], "left").withColumn("cov", zero(F.col("s")) - F.col("t"))
        out = out.join(left.groupBy(*keys, "g").agg(F.sum("ss").alias("ss_center")), [*keys, "g"]).join(right.groupBy(*keys, "h").agg(F.sum("ss").alias("ss_motif")), [*keys, "h"])
        return _named(out, keys)

    def distant(self, n: int, mu: DataFrame, keys: list[str], of_center: list[str] | None = None) -> DataFrame:
        """distant_sums() of the set n, whose centres have the keys of_center, all by default."""
        of_center = keys if of_center is None else of_center
        zero = lambda c: F.coalesce(c, F.lit(0.0))

        def side(s: str, on: list[str]) -> DataFrame:
            """(on, gene, n, sum of deviations, sum of squared deviations), each cell from its label's mean."""
            own = self.of(self.numbers, n, s).select(*on, F.col("l").alias("label"), "n")
            sums = self.of(self.sums, n, s).select(*on, F.col("l").alias("label"), "gene", "s", "q")
            frame = own.withColumn("_g", self.genes.agg(F.collect_list("gene")).scalar()).select(*on, "label", "n", F.explode("_g").alias("gene"))
            frame = frame.join(mu, ["fov", "label", "gene"], "left").join(sums, [*on, "label", "gene"], "left")
            total = frame.groupBy(*on, "gene").agg(F.sum("n").alias("n"), F.sum(zero(F.col("s"))).alias("s"), F.sum(zero(F.col("q"))).alias("q"), F.sum(F.col("n") * zero(F.col("mean"))).alias("m"))
            mean = F.col("m") / F.col("n")  # of the cells' label means
            return total.select(*on, "gene", "n", (F.col("s") - F.col("m")).alias("d"), (F.col("q") - 2 * mean * F.col("s") + F.col("n") * mean * mean).alias("ss"))

        a = side("c", ["fov", *of_center]).select("fov", *of_center, F.col("gene").alias("g"), F.col("n").alias("n1"), F.col("d").alias("d1"), F.col("ss").alias("ss1"))
        b = side("n", ["fov", *keys]).select("fov", *keys, F.col("gene").alias("h"), F.col("n").alias("n2"), F.col("d").alias("d2"), F.col("ss").alias("ss2"))
        both = a.join(b, ["fov", *of_center])
        out = both.groupBy(*keys, "g", "h").agg(F.sum(F.col("d1") * F.col("d2")).alias("cov"), F.sum(F.col("ss1") * F.col("n2")).alias("ss_center"), F.sum(F.col("ss2") * F.col("n1")).alias("ss_motif"))
        return _named(out, keys)


def paired_sums(pairs: DataFrame, expr: DataFrame, means: DataFrame, genes: DataFrame, ct: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, gene_center, gene_motif, cov, ss_center, ss_motif) for all pairs of genes, summed over fields of view.

    With e the expression, mu a label's mean in the field of view, the covariance of centre gene g and neighbour gene h
    is the sum over pairs of (e(c,g) - mu_ct(g)) * (e(n,h) - mu_label(n)(h)). Multiplied out, only one term needs a
    product of two cells' values. The other terms are products of sums by gene and label. Zeros never become rows."""
    keys = keys or []
    sums = _Sums(_pair_cells(pairs, 1, keys), pairs.withColumn("set", F.lit(1)), expr, genes, keys)
    return sums.paired(1, written(means.join(sums.genes, "gene", "left_semi"), "means"), ct, keys)


def distant_sums(centers: DataFrame, distant: DataFrame, expr: DataFrame, means: DataFrame, genes: DataFrame, ct: str, keys: list[str] | None = None) -> DataFrame:
    """As paired_sums(), over all pairs of a centre and a distant cell of its field of view. The sum over pairs of a
    product is the product of two sums, so no pair is made: two aggregates by gene."""
    keys = keys or []
    of_center = [c for c in keys if c in centers.columns]
    every = centers.withColumns({c: F.lit(None).cast(distant.schema[c].dataType) for c in keys if c not in of_center})
    sums = _Sums(_distant_cells(every, distant, 1, keys, ct), None, expr, genes, keys)
    return sums.distant(1, written(means.join(sums.genes, "gene", "left_semi"), "means"), keys, of_center)


def _effective(keys: list[str], a: DataFrame, b: DataFrame, to: str) -> DataFrame:
    """Per key, the lesser of two counts by field of view, summed."""
    per = a.withColumnRenamed("n", "a").join(b.withColumnRenamed("n", "b"), [*keys, "fov"])
    total = F.sum(F.least("a", "b")).alias(to)
    return per.groupBy(*keys).agg(total) if keys else per.agg(total)


def _named(out: DataFrame, keys: list[str]) -> DataFrame:
    return out.select(*keys, F.col("g").alias("gene_center"), F.col("h").alias("gene_motif"), "cov", F.greatest("ss_center", F.lit(0.0)).alias("ss_center"), F.greatest("ss_motif", F.lit(0.0)).alias("ss_motif"))


def _correlation() -> Column:
    return F.col("cov") / (F.sqrt(F.col("ss_center") * F.col("ss_motif")) + 1e-10)


def _means(expr: DataFrame, cells: DataFrame) -> DataFrame:
    return label_means(expr, cells, ["fov"])


def covariation(cells: DataFrame, expr: DataFrame, ct: str, motif: list[str], genes: list[str] | None = None, max_dist: float | None = None, k: int | None = None, min_size: int = 0, min_nonzero: int = 10, alpha: float | None = 0.05, by_type: bool = False) -> DataFrame:
    """Gene pairs that covary between centres of label ct with the motif round them and the motif's cells there.

    Three correlations of each pair of genes: with neighbours (corr_neighbor), with motif cells that are no neighbours
    (corr_non_neighbor), and of centres without the motif with their neighbours (corr_center_no_motif). Test 1 compares
    the first two, test 2 the first and third, by Fisher's z. Rows whose two differences disagree in sign have no
    adjusted p; of the others both p are adjusted together. if_significant wants both under alpha.

    by_type tells the motif's labels apart, in the column cell_type. Sums merge over fields of view; those without pairs
    add nothing. Fewer than ten distant cells or pairs of the third kind in all leave the test out, as nulls. Genes are
    given or those that min_nonzero cells express. No pair at all raises ValueError."""
    check_label(cells, ct)
    motif = known_labels(cells, motif)
    keys = ["cell_type"] if by_type else []
    expr = stored(expr, "expression")
    wanted = frequent_genes(expr, min_nonzero)
    if genes is not None:
        wanted = wanted.where(F.col("gene").isin(genes))
    pairs = motif_pairs(cells, ct, motif, max_dist, k, min_size)
    if not pairs.take(1):
        raise ValueError("no centre has the motif round it")
    free = written(free_cells(cells, ct, pairs), "free")
    far = distant_cells(cells, ct, motif, pairs, free)
    third = written(other_pairs(cells, ct, pairs, max_dist, k, min_size, free), "pairs")
    no_key = third
    if by_type:
        pairs, far = pairs.withColumn("cell_type", F.col("neighbor_label")), far.withColumn("cell_type", F.col("label"))
        no_key = third.withColumn("cell_type", F.lit(None).cast("string"))
    centers = pairs.select(*keys, "fov", F.col("center_id").alias("cell_id"))
    own = _pair_cells(pairs, 1, keys).unionByName(_distant_cells(centers, far, 2, keys, ct)).unionByName(_pair_cells(no_key, 3, keys))
    both = pairs.withColumn("set", F.lit(1)).unionByName(no_key.withColumn("set", F.lit(3)))
    sums = _Sums(own, both, expr, wanted, keys, once=2)
    mu = written(_means(expr, cells).join(sums.genes, "gene", "left_semi"), "means")
    distant = sums.of(sums.numbers, 2, "n")
    enough = distant.groupBy(*keys).agg(F.sum("n").alias("count")).where("count >= 10") if keys else distant.agg(F.sum("n").alias("count")).where("count >= 10")
    n_centers = sums.counts(2, "c", keys, k=True)
    n1 = _effective(keys, n_centers, sums.counts(1, "n", keys), "n1")
    n2 = _effective(keys, n_centers, sums.counts(2, "n", keys, k=True), "n2")
    n3 = _effective([], sums.counts(3, "c", []), sums.counts(3, "n", []), "n3")
    few = sums.of(sums.numbers, 3, "n").agg(F.sum("n").alias("c")).where("c >= 10")
    id_ = [*keys, "gene_center", "gene_motif"]
    one = sums.paired(1, mu, ct, keys).select(*id_, _correlation().alias("corr_neighbor"))
    two = sums.distant(2, mu, keys).select(*id_, _correlation().alias("corr_non_neighbor"))
    three = sums.paired(3, mu, ct, []).select("gene_center", "gene_motif", _correlation().alias("corr_center_no_motif"))
    two = two.join(enough.select(*keys), keys, "left_semi") if keys else two.where(enough.agg(F.count("*")).scalar() > 0)
    three = three.where(few.agg(F.count("*")).scalar() > 0)
    out = one.join(two, id_, "left").join(three, ["gene_center", "gene_motif"], "left")
    out = out.join(n1, keys).join(n2, keys, "left") if keys else out.withColumns({"n1": n1.scalar(), "n2": n2.scalar()})
    out = written(out.withColumn("n3", n3.scalar()), "correlations")
    return scored(out, keys, alpha)


def scored(out: DataFrame, keys: list[str], alpha: float | None = 0.05) -> DataFrame:
    """The tests on (corr_neighbor, corr_non_neighbor, corr_center_no_motif, n1, n2, n3)."""
    r1, r2, r3 = (F.col(c) for c in ("corr_neighbor", "corr_non_neighbor", "corr_center_no_motif"))
    out = out.withColumns({"z_test1": stats.fisher_z(r1, F.col("n1"), r2, F.col("n2")), "z_test2": stats.fisher_z(r1, F.col("n1"), r3, F.col("n3")), "delta_corr_test1": r1 - r2, "delta_corr_test2": r1 - r3})
    out = out.withColumns({"p_value_test1": stats.p_normal(F.col("z_test1")), "p_value_test2": stats.p_normal(F.col("z_test2"))})
    weight = lambda i: F.col(f"delta_corr_test{i}") * -F.log10(F.col(f"p_value_test{i}") + 1e-300)
    out = out.withColumn("combined_score", 0.3 * weight(1) + 0.7 * weight(2))
    out = written(out, "tests")  # before the p-values are used twice
    same = F.signum("delta_corr_test1") == F.signum("delta_corr_test2")
    id_ = [*keys, "gene_center", "gene_motif"]
    tests = out.where(same).select(*id_, F.explode(F.array(*[F.struct(F.lit(i).alias("test"), F.col(f"p_value_test{i}").alias("p")) for i in (1, 2)])).alias("x")).select(*id_, "x.test", "x.p")
    adjusted = stats.benjamini_hochberg(tests, "p", "q").groupBy(*id_).agg(*[F.max(F.when(F.col("test") == i, F.col("q"))).alias(f"adj_p_value_test{i}") for i in (1, 2)])
    out = out.join(adjusted, id_, "left")
    level = 0.05 if alpha is None else alpha
    return out.withColumn("if_significant", F.coalesce((F.col("adj_p_value_test1") < level) & (F.col("adj_p_value_test2") < level), F.lit(False)))


def score_difference(a: DataFrame, b: DataFrame, score: str = "combined_score", significant: str = "if_significant", threshold: float = 95.0, overlapping: bool = False) -> DataFrame:
    """Rows of two result sets that both have, with the difference of their scores and its percentile.

    Without overlapping, only rows significant in one of them at least. Rows meet on the genes, and on cell_type where
    both have it. The percentile of d is (below + at most + 1 where any equals) * 50 / n; over the threshold or under
    100 - threshold is an outlier. """
    keys = [c for c in ("cell_type", "gene_center", "gene_motif") if c in a.columns and c in b.columns]
    pick = lambda df, s: df.select(*keys, F.col(score).alias(f"score_{s}"), F.col(significant).alias(f"significant_in_{s}"))
    both = pick(a, "A").join(pick(b, "B"), keys)
    if not overlapping:
        both = both.where(F.col("significant_in_A") | F.col("significant_in_B"))
    both = both.withColumn("score_diff", F.col("score_A") - F.col("score_B"))
    out = stats.percentile_ranks(both, "score_diff")
    high, low = F.col("percentile") > threshold, F.col("percentile") < 100 - threshold
    return out.withColumns({"is_outlier": high | low, "outlier_direction": F.when(high, "higher_in_A").when(low, "lower_in_A").otherwise("not_outlier")})
