"""Shards by extendible hashing: only buckets over the byte limit are split on another bit of the hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Bits that one round looks at, and bits that there are: of the doc_id, of the text, of the row.
ROUND, ALL = 12, 192
#: Bytes of a shard.
LIMIT = 1 << 20


def _bits() -> Column:
    return F.concat(F.lpad(F.conv("_h1", 16, 2), 64, "0"), F.lpad(F.bin("_h2"), 64, "0"), F.lpad(F.bin("_h3"), 64, "0"))


def _hashed(docs: DataFrame, text: str, doc_id: str, carried: dict[str, str]) -> DataFrame:
    """Sizes and hashes, written once, so that the row's own bits stay what they are."""
    own = docs.select(*[F.col(c).alias(to) for c, to in carried.items()], F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"),
                      F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 16).alias("_h1"), F.xxhash64(F.lit(1), F.col(text)).alias("_h2"))
    return materialize(own.withColumn("_h3", F.xxhash64(F.monotonically_increasing_id())), "hashed")


def directory(docs: DataFrame, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_bytes, shard_id, depth, shard_docs, shard_bytes) for each row of docs, and the columns `carry` as _c0, _c1 and so on.

    A shard is a bucket of the directory, named by the hash bits that its documents share: the MD5 of doc_id, then a
    hash of the text for rows that have one doc_id, then one of the row itself for rows alike in both. A bucket has as
    few bits as its bytes allow. Bits are taken in rounds: the bytes of each cell of ROUND more bits are summed, a
    cell's bucket is the shortest prefix whose sum is within the limit, and what is over it even then goes on to the
    next round. Sums meet by cell, never by shard.

    Null texts count 0 bytes; null doc_ids hash as empty ones. A document over the limit gets a shard of its own; every
    other shard is within it. Other columns are not looked at; an empty table gives an empty table."""
    rest = _hashed(docs, text, doc_id, {c: f"_c{i}" for i, c in enumerate(carry or [])})
    kept = [f"_c{i}" for i in range(len(carry or []))]
    found = None
    for base in range(0, ALL, ROUND):
        rest = rest.withColumn("_cell", F.substring(_bits(), 1, base + ROUND))
        cells = materialize(rest.groupBy("_cell").agg(F.sum("n_bytes").alias("_sum"), F.count("*").alias("_n")), "cells")
        # The cell under each of its prefixes that are longer than the last round's.
        under = cells.select("_cell", "_sum", "_n", F.explode(F.sequence(F.lit(base), F.lit(base + ROUND))).alias("depth")).withColumn("shard_id", F.expr("substring(_cell, 1, depth)"))
        sums = under.groupBy("shard_id", "depth").agg(F.sum("_sum").alias("shard_bytes"), F.sum("_n").alias("shard_docs"))
        fit = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == ALL))
        best = under.select("_cell", "shard_id", "depth").join(fit, ["shard_id", "depth"])
        best = best.withColumn("_nth", F.row_number().over(Window.partitionBy("_cell").orderBy("depth"))).where("_nth = 1").drop("_nth")
        best = materialize(best, "directory")
        done = rest.join(best, "_cell").select(*kept, "doc_id", "n_bytes", "shard_id", "depth", "shard_docs", "shard_bytes")
        found = done if found is None else found.unionByName(done)
        open_cells = cells.join(best, "_cell", "left_anti")
        if not open_cells.take(1):
            return found
        rest = materialize(rest.join(open_cells.select("_cell"), "_cell", "left_semi").drop("_cell"), "open")
    return found


def slots(assigned: DataFrame) -> DataFrame:
    """(first_slot, last_slot, shard_id, depth, global_depth, shard_docs, shard_bytes): the directory of what directory() gave.

    It has 2 ** global_depth slots, as many bits as the deepest bucket's; a shallower bucket owns all slots that start
    with its bits, which are neighbours: a row for each bucket says from which to which. Slots are written as bits.
    Buckets that no document falls into have no row; an empty table gives an empty directory."""
    each = materialize(assigned.select("shard_id", "depth", "shard_docs", "shard_bytes").distinct(), "buckets")
    deepest = each.withColumn("global_depth", each.agg(F.max("depth")).scalar())
    ends = [F.expr(f"rpad(shard_id, global_depth, '{bit}')").alias(name) for bit, name in (("0", "first_slot"), ("1", "last_slot"))]
    return deepest.select(*ends, "shard_id", "depth", "global_depth", "shard_docs", "shard_bytes")


def write(docs: DataFrame, limit: int, path: str, text: str = "text", doc_id: str = "doc_id", shard: str = "shard") -> None:
    """Writes docs as Parquet under path, a folder `shard`=b<bits> for each shard. Rows meet by shard, which the limit
    bounds. A column of docs that is named as the folders are gives way."""
    names = [c for c in docs.columns if c != shard]
    found = directory(docs, limit, text, doc_id, names)
    out = found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], F.concat(F.lit("b"), "shard_id").alias(shard))
    out.repartition(shard).write.partitionBy(shard).parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str, limit: int = LIMIT) -> DataFrame:
    """Shard of every document. Null texts have no bytes; rows that repeat are told apart; other columns are dropped; an
    empty table gives an empty table."""
    return directory(table(spark, sf_dir, "documents"), limit)


#: Forty bits of the doc_id's MD5: far more than the tables that SQL is run on need, where no doc_id repeats.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, lpad(bin(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT), 64, '0') AS bits FROM documents),
p AS (SELECT doc_id, n_bytes, depth, substr(bits, 1, depth) AS shard_id FROM d, range(0, 41) AS t(depth)),
s AS (SELECT depth, shard_id, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY ALL),
f AS (SELECT p.*, shard_bytes, shard_docs, row_number() OVER (PARTITION BY doc_id ORDER BY p.depth) AS nth FROM p JOIN s ON s.depth = p.depth AND s.shard_id = p.shard_id WHERE shard_bytes <= {LIMIT} OR shard_docs = 1)
SELECT doc_id, n_bytes, shard_id, CAST(depth AS INTEGER) AS depth, shard_docs, shard_bytes FROM f WHERE nth = 1"""
