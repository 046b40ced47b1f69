"""What the training-data operators share: inputs, the shared folder, bindings inside expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.sources.tables import ship
from loomfield.sources.tables import written as materialize

__all__ = ["SPACE", "fresh", "let", "materialize", "scan", "ship", "table"]

#: ASCII white space, as the contracts define words. Written for Java regular expressions.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have: name, or name with underscores after it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row. An alias doesn't do: inside a lambda the optimizer may put the
    expression back in its place, where it would run again for each element."""
    return F.transform(F.array(value), body)[0]


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running results of an associative op over an array, the first element's own first.

    In chunks of the root of the length: each chunk's own running results, and those of the chunks' last ones before it.
    So an element is copied as often as a chunk is long, not as often as the array is."""

    def fold(v: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.when(F.size(acc) == 0, F.array(x)).otherwise(F.array_append(acc, op(F.element_at(acc, -1), x)))

        return F.aggregate(v, F.slice(v, 1, 0), step)

    def chunked(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
        starts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda i: i * size + 1)
        return let(F.transform(starts, lambda at: fold(F.slice(v, at, size))), joined)

    def joined(chunks: Column) -> Column:
        def shifted(ends: Column) -> Column:
            return F.flatten(F.transform(chunks, lambda c, i: F.when(i == 0, c).otherwise(F.transform(c, lambda x: op(F.get(ends, i - 1), x)))))

        return let(fold(F.transform(chunks, lambda c: F.element_at(c, -1))), shifted)

    return let(values, lambda v: F.when(F.size(v) < 2, v).otherwise(chunked(v)))
