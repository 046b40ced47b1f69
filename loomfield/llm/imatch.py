"""I-Match fingerprints from randomised subsets of a lexicon. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, let, materialize, table

#: Shares of the documents between which a term's document frequency must lie: the band of inverse frequencies.
BAND = (0.001, 0.1)
#: Terms up to which the lexicon goes to every task as one row; a larger one is joined.
LEXICON = 1_000_000
#: Lookup buckets of the lexicon.
BUCKETS = 1 << 14
#: Lexicon subsets at each of a fingerprint's two densities, and seeded draws that each put a term in one of them or none.
SUBSETS, SEEDS = 24, (101, 202, 303)
#: Terms with the least hashes that always stand beside those in the band.
FEWEST = 48
#: Rows of one ordering block: at least, and at most once there are BLOCKS of them.
BLOCK, LARGEST, BLOCKS = 4000, 200_000, 4096


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text: lower-cased runs of letters and digits."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """(term): hashes of the terms in the band, over all distinct texts, so that copies don't move a term out of it.

    A term in the band is in a share `low` of the documents at least, so there are at most (mean distinct terms a
    document) / low of them however many documents there are. Null texts count as one empty text; repeated rows don't
    count; other columns aren't looked at; an empty table gives an empty lexicon."""
    low, high = band
    own = F.coalesce(F.col(text), F.lit(""))
    n = docs.select(F.xxhash64(own)).distinct().count()
    each = docs.select(F.xxhash64(own).alias("h"), terms(own).alias("terms")).groupBy("h").agg(F.first("terms").alias("terms"))
    found = each.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return materialize(found.where((F.col("df") >= low * n) & (F.col("df") <= high * n)).select("term"), "lexicon")


def lookup(words: DataFrame) -> Column:
    """The lexicon as one array of buckets, a subquery of one row."""
    spark = words.sparkSession
    rows = words.groupBy(F.col("term").bitwiseAND(F.lit(BUCKETS - 1)).alias("id")).agg(F.collect_list("term").alias("terms"))
    rows = spark.range(BUCKETS).join(rows, "id", "left").select(F.struct("id", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms")).alias("x"))
    return rows.agg(F.sort_array(F.collect_list("x")).getField("terms")).scalar()


def with_fingerprint(df: DataFrame, text: str, words: DataFrame, to: str = "fingerprint", limit: int = LEXICON) -> DataFrame:
    """df and the fingerprint of a text column, from the lexicon `words`. Null texts count as empty; rows that repeat
    get the same fingerprint; a column already named `to` is replaced; an empty table stays empty.

    A lexicon of up to `limit` terms is a subquery of one row: the two projections become one, in which it is evaluated
    where it is used, so that no row carries it. For that it must be named just once. A larger one is joined with the
    terms of the distinct texts. Both give the same fingerprints."""
    own = F.coalesce(F.col(text), F.lit(""))
    if words.count() <= limit:
        mask = F.lit(BUCKETS - 1)

        def of(buckets: Column) -> Column:
            return let(terms(own), lambda t: fingerprint(t, F.filter(t, lambda x: F.array_contains(F.get(buckets, x.bitwiseAND(mask).cast("int")), x))))

        held = fresh(df, "_lexicon")
        return df.withColumn(held, lookup(words)).withColumn(to, F.transform(F.array(held), of)[0]).drop(held)
    key = F.md5(own.cast("binary"))
    each = df.select(key.alias("_of"), terms(own).alias("_t")).groupBy("_of").agg(F.first("_t").alias("_t"))
    inside = each.select("_of", F.explode("_t").alias("term")).join(words, "term", "left_semi").groupBy("_of").agg(F.collect_list("term").alias("_band"))
    inside, of, band = materialize(inside, "band"), fresh(df, "_of"), fresh(df, "_band")
    made = let(terms(own), lambda t: fingerprint(t, F.coalesce(band, F.array().cast("array<bigint>"))))
    return df.join(inside.toDF(of, band), key == F.col(of), "left").withColumn(to, made).drop(of, band)


def fingerprint(t: Column, band: Column) -> Column:
    """A level in two hexadecimal digits, then 2 * SUBSETS hashes of eight digits; zeros for an empty subset.

    t holds a text's terms, band those of them that the lexicon has. The FEWEST terms with the least hashes stand
    beside the band's: a text without terms in the band has a fingerprint too, and as they stand there whatever else the
    text holds, an edited text keeps most of them. Each seed draws for each term a subset or none: at level l one in
    2**l terms is in one of the subsets by some draw, on the mean, and a term may be in several. A document's level is such that its subsets
    have one or two of its terms on the mean; the level above stands beside it, so that texts of up to twice the terms
    still share one. Each hash folds a subset's distinct terms in the text in the order of their own hashes; one pass
    over the drawn terms, sorted by subset, makes all of them."""
    kept = F.array_distinct(F.concat(F.slice(F.sort_array(t), 1, FEWEST), band))

    def of_kept(u: Column) -> Column:
        level = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.size(u), F.lit(1)) / SUBSETS)).cast("int"))
        return let(F.struct(level.alias("level"), (F.lit(SUBSETS * len(SEEDS)) * F.pow(F.lit(2.0), level).cast("long")).alias("cells")), lambda v: of_level(u, v))

    def of_level(u: Column, v: Column) -> Column:
        head = F.lower(F.lpad(F.hex(v["level"].cast("long")), 2, "0"))
        return let(drawn(u, v["cells"]), lambda d: F.concat(head, hashes(d), hashes(F.filter(d, lambda x: x["deep"]))))

    def drawn(u: Column, cells: Column) -> Column:
        """(slot, term, whether the level above has it too) of each draw that puts a term in a subset, sorted. Most draws
        put it in none, so they are sifted before anything is built."""

        def draws(seed: int) -> Column:
            h = lambda x: F.xxhash64(x, F.lit(seed))
            sifted = F.filter(u, lambda x: F.pmod(h(x), cells) < SUBSETS)
            return F.transform(sifted, lambda x: F.struct(F.pmod(h(x), cells).cast("int").alias("slot"), x.alias("term"), (F.pmod(h(x), cells * 2) < SUBSETS).alias("deep")))

        return F.sort_array(F.concat(*map(draws, SEEDS)))

    def hashes(d: Column) -> Column:
        kind = "array<struct<slot: int, hash: bigint>>"
        start = F.struct(F.array().cast(kind).alias("out"), F.lit(-1).alias("slot"), F.lit(0).cast("long").alias("term"), F.lit(0).cast("long").alias("hash"))
        run = lambda acc: F.struct(acc["slot"].alias("slot"), acc["hash"].alias("hash"))

        def step(acc: Column, x: Column) -> Column:
            def state(out: Column, h: Column) -> Column:
                return F.struct(out.alias("out"), x["slot"].alias("slot"), x["term"].alias("term"), h.alias("hash"))

            longer = state(acc["out"], F.when(acc["term"] == x["term"], acc["hash"]).otherwise(F.xxhash64(acc["hash"], x["term"])))
            begun = state(F.array_append(acc["out"], run(acc)), F.xxhash64(x["term"]))
            return F.when(acc["slot"] == x["slot"], longer).otherwise(begun)  # the first run is that of the start, slot -1

        def written_out(found: Column) -> Column:
            one = lambda i: F.coalesce(F.element_at(found, i), F.lit("0" * 8))
            return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), one), "")

        runs = let(F.aggregate(d, start, step), lambda a: F.array_append(a["out"], run(a)))
        digits = F.transform(runs, lambda r: F.struct(r["slot"], F.substring(F.lower(F.lpad(F.hex(r["hash"]), 16, "0")), 1, 8)))
        return let(F.map_from_entries(F.filter(digits, lambda r: r["slot"] >= 0)), written_out)

    return let(kept, of_kept)


def likeness(a: Column, b: Column) -> Column:
    """The share of the subsets filled in either of two fingerprints that hash alike, over the levels that they share:
    0 to 1. Equal fingerprints: 1; none shared: 0."""
    width = 8 * SUBSETS

    def counts(x: Column, y: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            p, q = F.substr(x, 1 + 8 * i, F.lit(8)), F.substr(y, 1 + 8 * i, F.lit(8))
            filled = (p != "0" * 8) | (q != "0" * 8)
            return F.struct((acc["alike"] + F.when(filled & (p == q), 1).otherwise(0)).alias("alike"), (acc["filled"] + F.when(filled, 1).otherwise(0)).alias("filled"))

        start = F.struct(F.lit(0).alias("alike"), F.lit(0).alias("filled"))
        return let(F.aggregate(F.sequence(F.lit(0), (F.length(x) / 8).cast("int") - 1), start, add), lambda n: F.when(n["filled"] > 0, n["alike"] / n["filled"]).otherwise(0.0))

    level = lambda x: F.conv(F.substring(x, 1, 2), 16, 10).cast("int")
    first, second = lambda x: F.substring(x, 3, width), lambda x: F.substring(x, 3 + width, width)
    return (
        F.when(a == b, 1.0)
        .when(level(a) == level(b), counts(F.substring(a, 3, 2 * width), F.substring(b, 3, 2 * width)))
        .when(level(a) + 1 == level(b), counts(second(a), first(b)))
        .when(level(b) + 1 == level(a), counts(first(a), second(b)))
        .otherwise(0.0)
    )


def _bounds(keyed: DataFrame, block: int | None) -> DataFrame | None:
    """One row, `b`: ascending values of _key between blocks, in groups of about the root of their number. None if one block will do.

    Blocks hold `block` rows, else at least BLOCK, and LARGEST once there are BLOCKS: their number grows with the rows, and a
    bound is 8 bytes for each block."""
    n = keyed.count()
    count = math.ceil(n / (block or min(LARGEST, max(BLOCK, n // BLOCKS))))
    if count <= 1:
        return None
    shares = F.array(*[F.lit(i / count) for i in range(1, count)]) if count <= BLOCKS else F.transform(F.sequence(F.lit(1), F.lit(count - 1)), lambda i: i / count)
    flat = keyed.agg(F.array_sort(F.array_distinct(F.percentile_approx("_key", shares, max(10_000, 10 * count)))).alias("b"))
    side = math.ceil(math.sqrt(count))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("b") - 1) / side).cast("int")), lambda i: F.slice("b", i * side + 1, side))
    return materialize(flat.select(groups.alias("b"), F.lit(side).alias("side")), "bounds")


def _with_block(keyed: DataFrame, bounds: DataFrame | None) -> DataFrame:
    """keyed with `_block`: how many bounds are at most _key, by a search among the groups and one in a group."""
    if bounds is None:
        return keyed.withColumn("_block", F.lit(0))
    upto = lambda array: F.size(F.filter(array, lambda b: b <= F.col("_key")))
    i = upto(F.transform("_bounds.b", lambda g: F.get(g, F.lit(0))))
    found = let(i, lambda i: F.when(i == 0, 0).otherwise((i - 1) * F.col("_bounds.side") + upto(F.get("_bounds.b", i - 1))))
    return keyed.withColumn("_bounds", bounds.select(F.struct("b", "side")).scalar()).withColumn("_block", found.cast("int")).drop("_bounds")


def with_next(docs: DataFrame, add: Callable[[DataFrame], DataFrame], carried: list[str], block: int | None = None) -> DataFrame:
    """docs (doc_id, text) with the columns `carried`, which `add` adds, and `_next`, a struct of text and carried of the next row in
    descending doc_id; after the last row comes the first. Rows of one doc_id, or without, follow by their texts' hash.
    An empty table stays empty; one row is its own next.

    Rows are ordered inside blocks of like numbers of doc_ids, so each text is shuffled once and nothing is ordered in
    one task but the blocks' ends, two short rows a block."""
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("_key"))
    keyed = _with_block(keyed, _bounds(keyed, block)).withColumn("_tie", F.xxhash64("text"))
    rows = add(keyed)
    order = Window.partitionBy("_block").orderBy(F.desc("_key"), F.desc("_tie"))
    following = F.struct("text", *carried)
    inside = rows.withColumn("_next", F.lead(following).over(order)).where("_next is not null")
    # The last row of each block, and the first of the block below.
    ends = materialize(keyed.groupBy("_block").agg(F.max(F.struct("_key", "_tie")).alias("top"), F.min(F.struct("_key", "_tie")).alias("low")), "ends")
    below = Window.orderBy(F.desc("_block"))
    ends = ends.select("_block", "low", F.coalesce(F.lead("top").over(below), F.first("top").over(below)).alias("top"))
    ends = materialize(ends, "ends")

    def one(which: str) -> DataFrame:
        at = F.broadcast(ends.select(F.col("_block").alias("_end"), F.col(f"{which}._key").alias("_key"), F.col(f"{which}._tie").alias("_tie")))
        found = keyed.join(at, ["_key", "_tie"])
        return add(found.withColumn("_nth", F.row_number().over(Window.partitionBy("_end").orderBy("_tie"))).where("_nth = 1"))

    last = one("low").join(one("top").select("_end", following.alias("_next")), "_end")
    names = ["doc_id", "text", *carried, "_next"]
    return inside.select(names).unionByName(last.select(names))


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts. Null texts are empty; rows that repeat, or lack a doc_id,
    have a row each; other columns are dropped; an empty table gives an empty table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = lexicon(docs)
    rows = with_next(docs, lambda df: with_fingerprint(df, "text", words), ["fingerprint"])
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), F.length("text") - third), F.substr(F.col("_next.text"), F.lit(1), third))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint", F.col("_next.fingerprint").alias("_after"), edited.alias("_edited"))
    rows = with_fingerprint(rows, "_edited", words, "edited_fingerprint").withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_after")).alias("near_next"))
