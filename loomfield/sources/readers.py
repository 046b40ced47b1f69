"""Cells and expression from files: CSV, and annotated matrices in HDF5 by a Python data source."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tables import cells


def read_cells(spark: SparkSession, path: str, x: str = "x", y: str = "y", label: str = "label", cell_id: str = "cell_id", fov: str = "fov", dataset: str = "dataset", sep: str = ",") -> DataFrame:
    """Cells from CSV files with a header. Columns are read as text and cast, so files aren't read twice for a schema;
    a missing column raises ValueError, and a cell without coordinates or label is dropped."""
    rows = spark.read.csv(path, header=True, sep=sep)
    return cells(rows, x, y, label, cell_id, fov, dataset).dropna(subset=["cell_id", "label", "x", "y"])


def read_expression(spark: SparkSession, path: str, cell_id: str = "cell_id", gene: str | None = "gene", value: str = "value", sep: str = ",") -> DataFrame:
    """(cell_id, gene, value) from CSV files with a header: a row for each cell and gene, or with gene=None a column for
    each gene. Zeros and empty values are no rows."""
    rows = spark.read.csv(path, header=True, sep=sep)
    if gene is None:
        genes = [c for c in rows.columns if c != cell_id]
        rows = rows.unpivot([cell_id], genes, "gene", value)
    else:
        rows = rows.withColumnRenamed(gene, "gene")
    out = rows.select(F.col(cell_id).cast("bigint").alias("cell_id"), "gene", F.col(value).cast("double").alias("value"))
    return out.where("value <> 0 and gene is not null")


class AnnotatedMatrix(DataSource):
    """spark.read.format("annotated_matrix"): cells (table=cells) or expression (table=expression) of one HDF5 file.

    Options: path, table, spatial_key, label_key, feature_name, fov, dataset, rows (cells of a partition). A partition
    reads its own range of cells from the file, which every executor must reach. Needs h5py on the executors."""

    @classmethod
    def name(cls) -> str:
        return "annotated_matrix"

    def schema(self) -> str:
        if self.options.get("table", "cells") == "cells":
            return "dataset string, fov string, cell_id bigint, label string, x double, y double"
        return "cell_id bigint, gene string, value double"

    def reader(self, schema) -> DataSourceReader:
        return _MatrixReader(self.options)


class _MatrixReader(DataSourceReader):
    def __init__(self, options):
        self.options = {k.lower(): v for k, v in options.items()}

    def _open(self):
        try:
            import h5py
        except ModuleNotFoundError as e:
            raise RuntimeError("reading annotated matrices needs h5py") from e
        return h5py.File(self.options["path"], "r")

    def partitions(self) -> list[InputPartition]:
        size = int(self.options.get("rows", 100_000))
        with self._open() as f:
            n = f["obsm"][self.options.get("spatial_key", "X_spatial")].shape[0]
        return [InputPartition((at, min(n, at + size))) for at in range(0, n, size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        first, last = partition.value
        text = lambda v: v.decode() if isinstance(v, bytes) else str(v)
        with self._open() as f:
            if self.options.get("table", "cells") == "cells":
                own = f["obs"][self.options.get("label_key", "predicted_label")]
                place = f["obsm"][self.options.get("spatial_key", "X_spatial")][first:last]
                if "categories" in own:
                    names = [text(v) for v in own["categories"][:]]
                    labels = [names[c] if c >= 0 else None for c in own["codes"][first:last]]
                else:
                    labels = [text(v) for v in own[first:last]]
                for i, (label, at) in enumerate(zip(labels, place, strict=True)):
                    yield self.options.get("dataset", "ST"), self.options.get("fov", "ST_0"), first + i, label, float(at[0]), float(at[1])
                return
            genes = [text(v) for v in f["var"][self.options.get("feature_name", "gene_ids")][:]]
            kept = {g: i for i, g in reversed(list(enumerate(genes)))}  # the first of a repeated gene
            matrix = f["X"]
            if hasattr(matrix, "shape"):
                for i, row in enumerate(matrix[first:last]):
                    for j in row.nonzero()[0].tolist():
                        if kept[genes[j]] == j:
                            yield first + i, genes[j], float(row[j])
                return
            ends = matrix["indptr"][first : last + 1]
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                for j, v in zip(matrix["indices"][a:b].tolist(), matrix["data"][a:b].tolist(), strict=True):
                    if v and kept[genes[j]] == j:
                        yield first + i, genes[j], float(v)
