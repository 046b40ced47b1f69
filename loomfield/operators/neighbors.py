"""Distance joins: radius, k nearest, nearest, and probe points, by buckets on a grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.sources.tables import dealt, shares, stored, written


#: Radii that a bucket is wide.
WIDE = 4

#: Cells in one part of a join over all of them.
ROWS = 120_000

#: A center's bucket. Each center lies in one, so groups of these and the center are those of the center, and the rows
#: are already parted by them.
BUCKET = ["_gx", "_gy"]


def _dist2(px: str = "px", py: str = "py") -> Column:
    return (F.col("x") - F.col(px)) * (F.col("x") - F.col(px)) + (F.col("y") - F.col(py)) * (F.col("y") - F.col(py))


def parts(cells: DataFrame) -> int:
    """Into how many parts a join over the cells goes: ROWS cells each, so that a task's share doesn't grow with them."""
    return shares(cells.sparkSession, cells.count(), ROWS)


def grid_join(probes: DataFrame, points: DataFrame, radius: Column | float, n: int | None = None) -> DataFrame:
    """Probes (fov, probe_id, x, y, ...) and points (fov, point_id, px, py, ...) at most radius apart, with dist2 and the
    probe's BUCKET.

    Both sides go to buckets of WIDE radii: a probe to its own, a point to all that its square touches, (1 + 2 / WIDE)**2
    on the mean, so the join is on equal keys and a pair comes up once. All pairs of a probe are in one bucket, so what
    is asked of them by probe needs no further exchange. A radius that differs by field of view is the column `_at` of
    both sides. n is the number of parts; the planner's, if None."""
    size = radius if isinstance(radius, Column) else F.lit(float(radius))
    wide = size * WIDE
    asks = probes.withColumns({"_gx": F.floor(F.col("x") / wide), "_gy": F.floor(F.col("y") / wide)})

    def reach(c: str) -> Column:
        slack = size * 1.000001 + F.abs(c) * 1e-15  # dist2 decides, not a rounded quotient
        return F.explode(F.sequence(F.floor((F.col(c) - slack) / wide), F.floor((F.col(c) + slack) / wide)))

    kept = points.withColumn("_gx", reach("px")).withColumn("_gy", reach("py"))
    if isinstance(radius, Column):
        kept = kept.drop("_at")
    own = {"px": "_px", "py": "_py"}
    if n:
        asks, kept = asks.repartition(n, "fov", *BUCKET), dealt(kept, n, ["fov", *BUCKET], own)
    else:
        kept = kept.withColumnsRenamed(own)
    return asks.join(kept, ["fov", *BUCKET]).withColumn("dist2", _dist2("_px", "_py")).where(F.col("dist2") <= size * size).drop(*own.values())


def _points(cells: DataFrame) -> DataFrame:
    return cells.select("fov", F.col("cell_id").alias("neighbor_id"), F.col("label").alias("neighbor_label"), F.col("x").alias("px"), F.col("y").alias("py"))


def _centers(cells: DataFrame) -> DataFrame:
    return cells.select("dataset", "fov", F.col("cell_id").alias("center_id"), F.col("label").alias("center_label"), "x", "y")


PAIRS = ["dataset", "fov", "center_id", "center_label", "neighbor_id", "neighbor_label", "dist2"]


def by_center(pairs: DataFrame, *more: str) -> list[str]:
    """The columns that tell centers apart: with their buckets, where the pairs have them."""
    return ["fov", *[c for c in BUCKET if c in pairs.columns], "center_id", *more]


def radius_join(cells: DataFrame, radius: float, centers: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """All (center, neighbor) pairs within the radius, boundary included, with the center's BUCKET; a cell is no
    neighbour of its own."""
    found = grid_join(_centers(cells if centers is None else centers), _points(cells), radius, n or parts(cells))
    return found.where("center_id <> neighbor_id").select(*PAIRS, *BUCKET)


def knn_join(cells: DataFrame, k: int, max_dist: float, centers: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """The k nearest neighbours within max_dist (below it, if strict), ties by neighbor_id.

    A first round at the radius where some 3k neighbours are expected settles the centres that find k there; only the
    others ask again, at twice the radius each time, up to max_dist. A round is exact, as a centre with k neighbours
    within a radius needs none from beyond. What a round settled and what it left are written tables, so a round's plan
    doesn't hold those before it."""
    centers = cells if centers is None else centers
    radius = math.sqrt(3 * k / (math.pi * 0.25))  # mean nearest distance 1: a density of about a quarter
    own = Window.partitionBy("fov", *BUCKET, "center_id")
    done, n = None, parts(cells)
    while True:
        last = radius * 1.5 >= max_dist
        near = radius_join(cells, max_dist if last else radius, centers, n)
        if strict and last:
            near = near.where(F.col("dist2") < max_dist * max_dist)
        near = near.withColumn("nth", F.row_number().over(own.orderBy("dist2", "neighbor_id"))).where(F.col("nth") <= k)
        if not last:
            near = written(near.withColumn("_full", F.count("*").over(own) == k), "near").where("_full").drop("_full")
            full = near.where(F.col("nth") == k).select("fov", F.col("center_id").alias("cell_id"))
            centers = written(centers.join(full, ["fov", "cell_id"], "left_anti"), "centers")
            last = not centers.take(1)
            if done is not None or not last:
                near = near.drop(*BUCKET)  # of this round's radius
        elif done is not None:
            near = near.drop(*BUCKET)
        done = near if done is None else done.unionByName(near)
        if last:
            return done.select(*PAIRS, *[c for c in BUCKET if c in done.columns], "nth")
        radius *= 2


#: Cells that a bucket may hold as its cells see it on the mean, before the buckets are made smaller.
CROWDED = 16


def _first_radius(cells: DataFrame) -> DataFrame:
    """(fov, _r, _end): a radius at which a cell meets few others, and one that spans the field of view.

    Twice the mean spacing of the box, or of its longer side where the cells lie along a line. Where cells are clustered
    that is far too wide: while the cells of a field of view see over CROWDED in their bucket on the mean, its radius is
    divided by 16. Each check is a count by bucket."""
    w, h = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    sides = cells.groupBy("fov").agg(F.count("*").alias("n"), w.alias("w"), h.alias("h"))
    if sides.where("n < 2").take(1):
        raise ValueError("a field of view of one cell has no nearest distance")
    end = F.greatest(F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h")), F.lit(1e-9)) * 1.001
    spacing = F.greatest(F.sqrt(F.col("w") * F.col("h") / F.col("n")), F.greatest("w", "h") / F.col("n"))
    radii = written(sides.select("fov", F.greatest(2 * spacing, end * 1e-9).alias("_r"), end.alias("_end")), "radii")
    for _ in range(8):
        size = F.col("_r")
        seen = cells.join(radii, "fov").groupBy("fov", F.floor(F.col("x") / size), F.floor(F.col("y") / size)).agg(F.count("*").alias("c"))
        seen = seen.groupBy("fov").agg((F.sum(F.col("c") * F.col("c")) / F.sum("c")).alias("_seen"))
        full = written(seen.where(F.col("_seen") > CROWDED).select("fov", F.lit(1 / 16).alias("_times")), "crowded")
        if not full.take(1):
            break
        narrower = F.greatest(F.col("_r") * F.coalesce("_times", F.lit(1.0)), F.col("_end") * 1e-9)
        radii = written(radii.join(full, "fov", "left").select("fov", narrower.alias("_r"), "_end"), "radii")
    return radii


def nearest_distance(cells: DataFrame) -> DataFrame:
    """(fov, cell_id, dist2) of each cell's nearest other cell. Cells that find none within three quarters of a first radius ask again at
    4, then 64, then 4096 times the radius and so on, until it spans the field of view; a field of view of one cell raises ValueError. Rounds are
    written tables: a cell meets itself in the join, so those that find no other are rows of the round too."""
    cells = stored(cells, "points").select("fov", "cell_id", "x", "y")
    rest, done, scale, step = cells.join(F.broadcast(_first_radius(cells)), "fov"), None, 0.75, 4.0
    every, n = ["fov", "cell_id", "x", "y", "_r", "_end"], parts(cells)
    points = rest.select("fov", F.col("cell_id").alias("neighbor_id"), F.col("x").alias("px"), F.col("y").alias("py"), "_r", "_end")
    while True:
        own = F.least(F.col("_r") * scale, F.col("_end"))
        met = grid_join(rest.select(*every, own.alias("_at")), points.withColumn("_at", own).drop("_r", "_end"), F.col("_at"), n)
        other = F.when(F.col("cell_id") != F.col("neighbor_id"), F.col("dist2"))
        met = met.groupBy("fov", *BUCKET, "cell_id").agg(F.min(other).alias("dist2"), *[F.first(c).alias(c) for c in every[2:]])
        met = written(met.drop(*BUCKET), "nearest")
        found = met.where("dist2 is not null").select("fov", "cell_id", "dist2")
        done = found if done is None else done.unionByName(found)
        rest = written(met.where("dist2 is null").select(every), "rest")
        if not (left := rest.count()):
            return done
        scale, step, n = scale * step, step * 4, n if left > ROWS else None  # few go to all tasks


def normalize(cells: DataFrame) -> DataFrame:
    """cells with coordinates in units of the field of view's mean nearest distance, as a written table: everything
    else starts from it."""
    cells = stored(cells, "points")
    scale = nearest_distance(cells).groupBy("fov").agg((1 / F.avg(F.sqrt("dist2"))).alias("_s"))
    out = cells.join(F.broadcast(scale), "fov").withColumns({"x": F.col("x") * F.col("_s"), "y": F.col("y") * F.col("_s")})
    return written(out.select("dataset", "fov", "cell_id", "label", "x", "y"), "cells")


def _grid_boxes(cells: DataFrame, step: float) -> DataFrame:
    """(dataset, fov, low_x, low_y, nx, ny): where each field of view's grid begins, and its columns and rows."""
    box = cells.groupBy("dataset", "fov").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)])
    box = box.withColumns({f"low_{c}": F.col(f"min_{c}") - step for c in ("x", "y")})
    return box.select("dataset", "fov", "low_x", "low_y", *[F.ceil((F.col(f"max_{c}") + step - F.col(f"low_{c}")) / step).alias(f"n{c}") for c in ("x", "y")])


def grid_probes(cells: DataFrame, step: float) -> DataFrame:
    """(fov, probe_id, x, y): points step apart from min - step on, below max + step, over each field of view."""
    out = _grid_boxes(cells, step)
    for c, i in (("x", "i"), ("y", "j")):
        out = out.withColumn(i, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{c}") - 1)))
    return out.select("dataset", "fov", (F.col("i") * F.col("ny") + F.col("j")).alias("probe_id"), (F.col("low_x") + F.col("i") * step).alias("x"), (F.col("low_y") + F.col("j") * step).alias("y"))


def grid_probe_join(cells: DataFrame, step: float, radius: float) -> DataFrame:
    """probe_join() with grid_probes(). No probe is made that no cell is near: a cell's place gives the numbers of the
    grid points within its square, so the work follows the cells, however large the box, and nothing is joined but a
    row for each field of view."""
    own = _points(cells).join(F.broadcast(_grid_boxes(cells, step)), "fov")

    def reach(c: str) -> Column:
        at, last = F.col(f"p{c}") - F.col(f"low_{c}"), F.col(f"n{c}") - 1
        slack = radius * 1.000001 + F.abs(F.col(f"p{c}")) * 1e-15  # dist2 decides, not a rounded quotient
        first = F.greatest(F.floor((at - slack) / step), F.lit(0).cast("long"))
        return F.explode(F.sequence(F.least(first, last), F.least(F.ceil((at + slack) / step), last)))

    own = own.withColumn("i", reach("x")).withColumn("j", reach("y")).withColumns({"x": F.col("low_x") + F.col("i") * step, "y": F.col("low_y") + F.col("j") * step})
    own = own.withColumn("dist2", _dist2()).where(F.col("dist2") <= F.lit(float(radius)) * radius)
    return own.select("dataset", "fov", (F.col("i") * F.col("ny") + F.col("j")).alias("center_id"), "neighbor_id", "neighbor_label", "dist2")


def random_probes(cells: DataFrame, n: int = 1000, seed: int = 2023) -> DataFrame:
    """n points in each field of view's box from numpy's RandomState(seed): all x, then all y. The unit numbers are
    drawn once, n of them, and stretched to each box."""
    import numpy as np

    state = np.random.RandomState(seed)
    units = list(zip(range(n), state.random_sample(n).tolist(), state.random_sample(n).tolist(), strict=True))
    unit = cells.sparkSession.createDataFrame(units, "probe_id long, ux double, uy double")
    box = cells.groupBy("dataset", "fov").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    every = unit.agg(F.collect_list(F.struct("probe_id", "ux", "uy")).alias("u"))
    drawn = box.withColumn("u", every.scalar()).withColumn("u", F.explode("u"))
    return drawn.select("dataset", "fov", F.col("u.probe_id").alias("probe_id"), (F.col("x0") + F.col("u.ux") * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + F.col("u.uy") * (F.col("y1") - F.col("y0"))).alias("y"))


def probe_join(cells: DataFrame, probes: DataFrame | float, radius: float) -> DataFrame:
    """Probe points and the cells within the radius; a probe is no cell, so none is left out. A number in place of the
    probes is a grid of that step."""
    if isinstance(probes, float):
        return grid_probe_join(cells, probes, radius)
    found = grid_join(probes, _points(cells), radius)
    return found.select("dataset", "fov", F.col("probe_id").alias("center_id"), "neighbor_id", "neighbor_label", "dist2")


def neighbors(cells: DataFrame, centers: DataFrame, max_dist: float | None = None, k: int | None = None, cutoff: float = 100.0, n: int | None = None) -> DataFrame:
    """Pairs by radius or by k, one of which must be given; n as in grid_join()."""
    if (max_dist is None) == (k is None):
        raise ValueError("give either max_dist or k")
    return radius_join(cells, max_dist, centers, n) if k is None else knn_join(cells, k, cutoff, centers).drop("nth")


def check_label(cells: DataFrame, label: str) -> None:
    if not cells.where(F.col("label") == label).take(1):
        raise ValueError(f"no cell is labelled {label}")


def known_labels(cells: DataFrame, motif: list[str]) -> list[str]:
    """The motif without labels that no cell has; none left raises ValueError."""
    found = {r[0] for r in cells.where(F.col("label").isin(motif)).select("label").distinct().collect()}
    if not (kept := [m for m in motif if m in found]):
        raise ValueError("no label of the motif is known")
    return kept
