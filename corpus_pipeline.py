"""The documents' way into training: quality rules, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs; the next one reads that back from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import packing, quality, secrets, simhash
from loomfield.llm.bpe import tokenizer_path
from loomfield.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the certified verdict keep.

    Null and empty texts have no words and go; repeated rows are judged alike; a null language is a stratum of its own;
    an empty table stays empty. Columns other than those of documents are dropped, here and in each stage, so that no
    name can clash."""
    return quality.judge(docs.select(COLUMNS), table(spark, sf_dir, "labels"), keep=COLUMNS).where("_kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least doc_id.

    Texts are near duplicates if their sets of five-word shingles have a Jaccard index of 0.8 or more, and what links to
    these. SimHash fingerprints at four differing bits or fewer and shared MinHash bands give candidates; each link is
    verified. Null and empty texts are one group; of rows alike in doc_id and text one stays; an empty table stays
    empty."""
    return simhash.one_of_each(docs.select(COLUMNS), width=5, within=4, least=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets masked and n_chars anew where there were any. A null text becomes an empty one;
    repeated rows stay; an empty table stays empty."""
    found = secrets.scan(docs.select(COLUMNS)).withColumn("_masked", secrets.masked(F.coalesce("text", F.lit("")), F.col("_spans")))
    n_chars = F.when(F.size("_spans") > 0, F.length("_masked").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("_masked").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of at most 1024 tokens and 64 pieces. A null or empty text is its
    end id; repeated rows are packed each; an empty table stays empty."""
    return packing.pack(docs.select(COLUMNS), tokenizer_path("byte_bpe_50k.json"), packing.Capacities(documents=64))


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_duplicates), ("secret scans", secret_scan), ("best-fit packing", best_fit)]

#: XXH64, whole-text fingerprints and tokenizers aren't expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
