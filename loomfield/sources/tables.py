"""Points, expression and groups from tables: the engine's schemas, and the mapping of order data onto them."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 1

#: Rows in one part of what is summed by cell.
ROWS = 250_000


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of every executor, once per application."""
    context = spark.sparkContext
    if getattr(context, "_loomfield_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="loomfield-")) / "loomfield.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(path))
    context._loomfield_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local master, which has
    one disk, gets a temporary folder; a cluster raises RuntimeError."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("loomfield.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="loomfield-")
        spark.conf.set("loomfield.shared.dir", folder)
    return f"{folder.rstrip('/')}/loomfield/{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: what several parts of a plan need is computed once, and outlives executors.
    discard() removes what an application wrote."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df itself if it is a table as it lies in its files, else written()."""
    plan = df._jdf.queryExecution().analyzed().getClass().getSimpleName()
    return df if plan == "LogicalRelation" else written(df, label)


def shares(spark: SparkSession, rows: int, most: int) -> int:
    """Into how many parts rows go: of `most` rows, but as many as there are cores."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / most))


def dealt(df: DataFrame, n: int, on: list[str], renamed: dict[str, str]) -> DataFrame:
    """df in n parts by the columns `on`, with others renamed. Right below a join Spark would raise n to the session's
    shuffle partitions, many tasks of a few rows; with new names between, n holds for both sides."""
    return df.repartition(n, *on).withColumnsRenamed(renamed)


def _hadoop_path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _hadoop_path(spark, path)
    return files.exists(where)


def discard(spark: SparkSession) -> None:
    """Removes all tables that written() made in this application. Frames that still read them fail afterwards."""
    where, files = _hadoop_path(spark, shared_folder(spark))
    files.delete(where, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(points: DataFrame, x: str, y: str, label: str, cell_id: str = "cell_id", fov: str = "fov", dataset: str = "dataset") -> DataFrame:
    """points as (dataset, fov, cell_id, label, x, y); a missing column raises ValueError."""
    wanted = {"dataset": dataset, "fov": fov, "cell_id": cell_id, "label": label, "x": x, "y": y}
    if missing := [c for c in wanted.values() if c not in points.columns]:
        raise ValueError(f"no such column: {', '.join(missing)}")
    kinds = {"x": "double", "y": "double", "cell_id": "bigint"}
    return points.select(*[F.col(c).cast(kinds.get(to, "string")).alias(to) for to, c in wanted.items()])


def of_datasets(cells: DataFrame, datasets: str | list[str]) -> DataFrame:
    """The cells of the datasets; a name that no cell has raises ValueError."""
    names = [datasets] if isinstance(datasets, str) else list(datasets)
    own = cells.where(F.col("dataset").isin(names))
    known = {r[0] for r in own.select("dataset").distinct().collect()}
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"no such dataset: {', '.join(missing)}")
    return own


def number_fovs(fovs: DataFrame, dataset: str = "dataset", order: str = "fov") -> DataFrame:
    """fovs with fov_no, from 0 within each dataset, and fov renamed to dataset_number; '_' in a dataset becomes '-'."""
    from pyspark.sql import Window

    no = F.row_number().over(Window.partitionBy(dataset).orderBy(order)) - 1
    clean = F.replace(F.col(dataset), F.lit("_"), F.lit("-"))
    return fovs.withColumn("fov_no", no.cast("int")).withColumn("fov_name", F.concat_ws("_", clean, F.col("fov_no").cast("string")))


def orders_as_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order is a cell, its nation the field of view, its region the dataset; not yet normalised."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    places = (
        read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        .join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    points = orders.join(places, F.col("o_custkey") == F.col("c_custkey")).withColumns({"x": F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")), "y": F.col("o_totalprice") / 200})
    return cells(points, "x", "y", "o_orderpriority", "o_orderkey", "n_name", "r_name")


def orders_as_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, gene, value): the quantity of each brand in an order. Lines are parted by order before they are summed,
    ROWS in a part, so that no task's sums grow with the table, and what follows by cell needs no further exchange."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    n = max(1, math.ceil(lines.count() / ROWS))
    own = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand", "l_quantity").repartition(n, "l_orderkey")
    return own.groupBy(F.col("l_orderkey").alias("cell_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def expression(long: DataFrame, cells: DataFrame, repeated: bool = True) -> DataFrame:
    """(dataset, fov, cell_id, label, gene, value) for value > 0 and genes with a name; a repeated gene keeps its first
    value by size. Cells that aren't in `cells` are dropped. Where none is repeated, nothing is grouped."""
    own = long.where("gene is not null and value > 0")
    if repeated:
        own = own.groupBy("cell_id", "gene").agg(F.max("value").alias("value"))
    return own.join(cells.select("dataset", "fov", "cell_id", "label"), "cell_id").select("dataset", "fov", "cell_id", "label", "gene", "value")


def concat(parts: list[DataFrame], outer: bool = False) -> DataFrame:
    """Expression tables of several sources as one: the genes that all have, or with outer all genes, those that a
    source lacks being zeros, which are no rows."""
    out, *rest = parts
    for other in rest:
        out = out.unionByName(other)
    if not outer:
        for part in parts:
            out = out.join(part.select("gene").distinct(), "gene", "left_semi")
    return out


def save(df: DataFrame, path: str) -> None:
    """Writes a table and, beside it, the version of the format."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(FORMAT_VERSION,)], "version int").write.mode("overwrite").json(f"{path}/version")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Reads what save() wrote; another version raises ValueError."""
    found = spark.read.schema("version int").json(f"{path}/version").first()[0]
    if found != FORMAT_VERSION:
        raise ValueError(f"format version {found}, not {FORMAT_VERSION}")
    return spark.read.parquet(f"{path}/data")


def merge(*indexes: DataFrame) -> DataFrame:
    """Several tables of one schema as one."""
    first, *rest = indexes
    for other in rest:
        if sorted(other.columns) != sorted(first.columns):
            raise ValueError("the tables' columns differ")
        first = first.unionByName(other)
    return first
