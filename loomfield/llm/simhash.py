"""SimHash fingerprints, and links between near ones by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components

#: Rows of a segment table that one task holds at most; the rows of a fuller key are dealt to more blocks.
BLOCK = 4096
#: Distances that are computed in one go.
CHUNK = 2_000_000
#: Distances that cost as much as a row that is shuffled.
ROW = 30
#: MinHash bands and values in each: a pair with a Jaccard index of 0.8 shares none with probability 7e-5.
BANDS, ROWS = 24, 5
#: Shingles whose MinHash values are computed in one go.
PART = 8192


def simhash(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text.

    A-Z are lower-cased, words are runs of anything but ASCII white space, and each run of `width` words (all words, if
    there are fewer) joined by spaces is hashed with XXH64, repeats included. A bit is set if it is set in over half
    the hashes. A text without words, or null: 0."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[min(width, len(found)) - 1 :].tolist(), strict=False)]
    n, ones = len(hashes), np.zeros(64, np.int64)
    packed = np.array(hashes, "<u8").view(np.uint8).reshape(n, 8)
    for at in range(0, n, 65536):
        ones += np.unpackbits(packed[at : at + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(text: Column, width: int = 4, seed: int = 42) -> Column:
    """simhash() of a text column, as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([simhash(x, width, seed) for x in texts], np.uint64).view(np.int64))

    return of(text)


def segments(count: int) -> list[tuple[int, int]]:
    """(shift, bits) of `count` segments that together cover 64 bits."""
    base, more = divmod(64, count)
    out, shift = [], 0
    for i in range(count):
        out.append((shift, base + (i < more)))
        shift += out[-1][1]
    return out


def work(n: float, within: int, count: int) -> float:
    """What a row costs with `count` segments among n: rows that ask, each as dear as ROW distances, and the distances."""
    out = 0.0
    for _, bits in segments(count):
        asks = (1 + sum(comb(bits, r) for r in range(within // count + 1))) / 2
        out += asks * (ROW + n / 2**bits)
    return out


def fitting(n: int, within: int) -> int:
    """The number of segments that is cheapest among n values: narrow ones with single keys while the tables are small,
    few wide ones with balls as they fill up, so that the work of a row hardly grows. The links found are the same."""
    return min(range(2, within + 2), key=lambda count: work(n, within, count))


def _ball(bits: int, radius: int) -> list[int]:
    """Masks of at most `radius` of `bits` bits."""
    return [sum(1 << b for b in picked) for r in range(radius + 1) for picked in combinations(range(bits), r)]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each value to the least one of its component among the pairs (a, b): fewer than there are values."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(values))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(values))
    return values[moved], values[label[moved]]


def _matches(kept: np.ndarray, start: np.ndarray, count: np.ndarray, probes: np.ndarray, within: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Star links of probes to kept[start : start + count] at `within` bits or fewer, some CHUNK distances at a time."""
    upto = np.cumsum(count)
    first = 0
    while first < len(probes):
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + CHUNK, "right")))
        n = count[first:last]
        own = np.repeat(np.arange(first, last), n)
        other = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + start[own]
        x, y = probes[own], kept[other]
        near = (np.bitwise_count(x ^ y) <= within) & (x != y)
        if near.any():
            yield _stars(x[near], y[near])
        first = last


def _segment(prints: DataFrame, s: int, shift: int, bits: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The table rows of segment s, and the rows that ask in it: (k, probe, f)."""
    key = F.shiftrightunsigned("f", shift).bitwiseAND(F.lit((1 << bits) - 1))
    tag = F.lit(s << 60).cast("long")
    masks = F.filter(F.array(*[F.lit(m).cast("long") for m in _ball(bits, radius)]), lambda m: (m == 0) | (key.bitwiseAND(m) < m.bitwiseXOR(key.bitwiseAND(m))))
    kept = prints.select(key.bitwiseOR(tag).alias("k"), F.lit(False).alias("probe"), "f")
    asks = prints.select(F.explode(F.transform(masks, lambda m: key.bitwiseXOR(m).bitwiseOR(tag))).alias("k"), F.lit(True).alias("probe"), "f")
    return kept, asks


def near_links(prints: DataFrame, within: int = 4, count: int | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all values of the long column `f` at `within` differing bits or fewer.

    Multi-index hashing: with `count` segments, two values within reach differ by at most within // count bits in one
    segment. Each value stands in a table under each segment, and asks for the keys in the small Hamming ball round
    its own; of the two directions only the one in which the highest changed bit is gained is asked: the pair is the same.
    Whole distances are then verified. The pairs of a crowded key aren't emitted: a task sends on only the links of a
    spanning star for each chunk of distances, so a group of m values gives about m links. A key with over `block`
    values is dealt to several blocks of its table, each of which gets all that ask for it. Without `count` it is
    fitting() for the number of values."""
    prints = materialize(prints.select("f").distinct(), "prints")
    count = count or fitting(prints.count(), within)
    parts = [_segment(prints, s, shift, bits, within // count) for s, (shift, bits) in enumerate(segments(count))]
    tables = reduce(DataFrame.unionByName, [kept for kept, _ in parts])
    rows = reduce(DataFrame.unionByName, [x for part in parts for x in part])
    crowded = tables.groupBy("k").count().where(F.col("count") > block).select("k", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    rows = rows.join(crowded, "k", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    place = F.when(F.col("probe"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("f"), F.col("blocks").cast("long")).cast("int")))
    rows = rows.select("k", F.explode(place).alias("block"), "probe", "f")
    rows = rows.repartition("k", "block").sortWithinPartitions("k", "block", "probe")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, np.zeros(0, np.uint64)  # the table rows of the last key seen
        for batch in batches:
            if not batch.num_rows:
                continue
            k, blk, probe, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            f = f.astype(np.int64).view(np.uint64)
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (blk[1:] != blk[:-1])
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            own = np.bincount(group[~probe], minlength=len(starts))
            kept, offset = f[~probe], np.cumsum(own) - own
            if held_key == (k[0], blk[0]):
                kept = np.concatenate([held, kept])
                own[0] += len(held)
                offset[1:] += len(held)
            asks = np.flatnonzero(probe)
            asks = asks[own[group[asks]] > 0]
            for a, b in _matches(kept, offset[group[asks]], own[group[asks]], f[asks], within):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
            held_key, held = (k[-1], blk[-1]), kept[offset[-1] : offset[-1] + own[-1]]

    return rows.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, within: int = 4, count: int | None = None) -> DataFrame:
    """(doc_id, text_hash, f, root, component_id) for each row of docs; other columns of docs are not looked at.

    f is the fingerprint, root the least fingerprint of the component. Null or empty texts, or those without words,
    have fingerprint 0 and link like any other. Rows that repeat stay, each with the same component. component_id is
    the least doc_id of the component, null if it has none. An empty table gives an empty table.

    Fingerprints are joined back from a written table, so that one which very many rows have is a skewed key that the
    skew join can split, or the table is small and goes to all."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), fingerprint(F.col(text), width).alias("f"))
    own = materialize(own, "simhash")
    least = materialize(own.groupBy("f").agg(F.min("doc_id").alias("first")), "prints")
    found = components(near_links(least, within, count))
    root = materialize(least.join(found.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f")), "roots")
    names = materialize(root.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    root = materialize(root.join(names, "root").select("f", "root", "component_id"), "roots")
    return own.join(root, "f").select("doc_id", "text_hash", "f", "root", "component_id")


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes, ascending, that simhash() takes of a text. A text without words, or null: the hash of nothing."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    hashes = {digest(b" ".join(found[i : i + width]), seed) for i in range(max(1, len(found) - width + 1))}
    return np.sort(np.fromiter(hashes, np.uint64, len(hashes)))


def bands(hashes: np.ndarray, count: int = BANDS, rows: int = ROWS) -> list[int]:
    """A signed hash for each of `count` bands of `rows` MinHash values: two sets with Jaccard index j share a band
    with probability 1 - (1 - j**rows)**count."""
    rng = np.random.default_rng(20)
    salts, odds = (rng.integers(0, 1 << 63, (2, count * rows, 1), np.uint64) << np.uint64(1)) | np.uint64(1)
    least = np.full(count * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), PART):
        mixed = (hashes[None, at : at + PART] ^ salts) * odds
        mixed ^= mixed >> np.uint64(32)
        mixed *= odds
        least = np.minimum(least, mixed.min(axis=1))
    return [xxhash.xxh64_intdigest(x.tobytes(), i) - (1 << 63) for i, x in enumerate(least.astype("<u8").reshape(count, rows))]


def alike(sets: list[np.ndarray], least: float = 0.8, classes: list[int] | None = None) -> list[int]:
    """For each set of distinct values the place of the first set of its component, where sets with a Jaccard index of
    `least` or more are linked, and sets of one class are. Each set is held against all that are not yet in its
    component: no pair is left out."""
    sizes = np.array([len(x) for x in sets], np.int64)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    root, open_ = np.full(len(sets), -1), np.arange(len(sets))
    kind = np.arange(len(sets)) if classes is None else np.unique(classes, return_inverse=True)[1]
    mark = np.zeros(len(values), np.int64)
    while len(open_):
        first = open_[0]
        joined = kind[open_] == kind[first]
        todo, open_ = open_[joined].tolist(), open_[~joined]
        root[todo] = first
        own = None  # the open sets' values, laid end to end
        while todo and len(open_):
            if own is None:
                n = sizes[open_]
                starts = np.cumsum(n) - n
                own = flat[np.arange(n.sum()) + np.repeat(ends[open_] - n - starts, n)]
            x = todo.pop()
            at = flat[ends[x] - sizes[x] : ends[x]]
            mark[at] = 1
            both = np.add.reduceat(mark[own], starts)
            mark[at] = 0
            near = both >= least * (sizes[x] + n - both) - 1e-9
            if near.any():
                near = np.isin(kind[open_], kind[open_[near]])
                root[open_[near]] = first
                todo.extend(open_[near].tolist())
                open_, own = open_[~near], None
    return root.tolist()


def star_links(sets: DataFrame, keys: DataFrame, least: float = 0.8) -> DataFrame:
    """Links (a, b) of those u that are alike to the least u of a key that they share. A row for each two that meet,
    once however many keys they share; the sets are compared in the JVM."""
    lead = materialize(keys.groupBy("k").agg(F.min("u").alias("lead")), "leads")
    pairs = materialize(keys.join(lead, "k").where("u <> lead").select("u", "lead").distinct(), "stars")
    leads = materialize(sets.join(pairs.select(F.col("lead").alias("u")).distinct(), "u", "left_semi").select(F.col("u").alias("lead"), F.col("shingles").alias("_t")), "leads")
    both = materialize(pairs.join(sets, "u"), "stars").join(leads, "lead")
    same = F.size(F.array_intersect("shingles", "_t"))
    near = same >= least * (F.size("shingles") + F.size("_t") - same) - 1e-9
    return both.where(near).select(F.col("u").alias("a"), F.col("lead").alias("b"))


def alike_links(sets: DataFrame, keys: DataFrame, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that, with those of star_links(), connect the u of sets (u, shingles) that share a key of keys (u, k)
    and are alike to `least`.

    Most near copies are alike to the least of a key, so stars come first. A key all of whose members are then in one
    component is done. Of the others, those with the same members are one; a key's members meet in one task, which
    compares the sets of different components by exact Jaccard index. The members of a key with over `block` are dealt
    to blocks, and each two blocks meet."""
    keys = keys.distinct()
    stars = materialize(star_links(sets, keys, least), "links")
    classes = materialize(components(stars).withColumnRenamed("node", "u"), "classes")
    keys = keys.join(classes, "u", "left").select("u", "k", F.coalesce("root", "u").alias("c"))
    keys = materialize(keys, "keys")
    members = keys.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u").cast("decimal(38,0)")).alias("sum"), F.min("u").alias("low"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2")
    crowds = materialize(members.groupBy("n", "sum", "low").agg(F.min("k").alias("k")).select("k", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "crowds")
    own = F.pmod(F.xxhash64("u"), F.col("blocks").cast("long")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != own)
    place = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(others, lambda i: F.least(i, own).cast("long") * F.col("blocks") + F.greatest(i, own)))
    rows = keys.join(crowds, "k").select("u", "k", "c", F.explode(place).alias("block")).join(sets, "u")
    rows = rows.repartition("k", "block").sortWithinPartitions("k", "block")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> Iterator[pa.RecordBatch]:
            if len(set(kinds)) > 1:
                roots = alike(held, least, kinds)
                found = [(u, us[r]) for u, r in zip(us, roots, strict=True) if u != us[r]]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

        last, us, kinds, held = None, [], [], []
        for batch in batches:
            lists = batch.column(4)
            for i, (u, c, *key) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True)):
                if key != last:
                    yield from close()
                    last, us, kinds, held = key, [], [], []
                us.append(u)
                kinds.append(c)
                held.append(np.array(lists[i].values.to_numpy(zero_copy_only=False)))
        yield from close()

    return rows.select("u", "c", "k", "block", "shingles").mapInArrow(link, "a long, b long").unionByName(stars)


def sketches(docs: DataFrame, text: str, width: int) -> DataFrame:
    """docs with `u`, a hash of the text's set of shingles, and `bands`."""

    @F.pandas_udf("u long, bands array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [shingles(x, width) for x in texts]
            yield pd.DataFrame({"u": [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in found], "bands": [bands(x) for x in found]})

    return docs.withColumn("_s", of(F.col(text))).select("*", "_s.u", "_s.bands").drop("_s")


def verified(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, within: int = 4, count: int | None = None, least: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, root) for each row of docs: texts whose sets of shingles have a Jaccard index of `least` or
    more are linked, and root names the component.

    Candidates are the texts that share a component of fingerprints at `within` bits or fewer, or a band of MinHash
    values; no candidate becomes a link before its sets of shingles are compared whole. Only candidates' sets are
    shuffled, and equal sets are one."""
    prints = near_duplicates(docs, text, doc_id, width, within, count).select("text_hash", "root").distinct()
    own = sketches(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text")), "_text", width).drop("_text")
    own = materialize(own, "sketches")
    each = own.groupBy("u").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"), F.first("bands").alias("bands")).select("u", "x.*", "bands")
    each = materialize(each.join(prints, "text_hash"), "sets")
    keys = each.select("u", F.explode("bands").alias("k")).unionByName(each.select("u", F.xxhash64(F.lit("f"), "root").alias("k")))
    shared = keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    keys = materialize(keys.join(shared, "k", "left_semi"), "keys")

    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(x, width).view(np.int64) for x in texts])

    wanted = each.join(keys.select("u").distinct(), "u", "left_semi").select("u", F.col("doc_id").alias("_id"), "text_hash")
    same = docs[doc_id].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text]) == F.col("text_hash"))
    texts = docs.select(doc_id, text).join(wanted, same).select("u", F.col(text).alias("_text"))
    texts = materialize(texts.groupBy("u").agg(F.first("_text").alias("_text")).select("u", sets("_text").alias("shingles")), "shingles")
    found = components(alike_links(texts, keys, least))
    out = own.select("doc_id", "text_hash", "u").join(found.withColumnRenamed("node", "u"), "u", "left")
    return out.select("doc_id", "text_hash", F.coalesce("root", "u").alias("root"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, within: int = 4, count: int | None = None, least: float = 0.8) -> DataFrame:
    """docs without all but one row of each group of near duplicates, as verified() finds them: that with the least
    doc_id, or, of rows with the same doc_id or none, with the least hash of its text; of rows alike in both, any.
    Columns come back as they are."""
    found = materialize(verified(docs, text, doc_id, width, within, count, least), "groups")
    lead = materialize(found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("x")).select("x.doc_id", "x.text_hash"), "leads")
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    kept = rows.join(lead, same, "left_semi")
    twice = found.groupBy("doc_id", "text_hash").count().where("count > 1").drop("count")
    if not twice.take(1):
        return kept.select("row.*")
    twice = materialize(twice.join(lead.withColumnsRenamed({"doc_id": "id", "text_hash": "hash"}), same, "left_semi"), "twice")
    several = kept.join(twice, same, "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(1)))).where("nth = 1")
    return kept.join(twice, same, "left_anti").select("row.*").unionByName(several.select("row.*"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null and empty texts have fingerprint zero; repeated rows have a row
    each; other columns are dropped; an empty table gives an empty table."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
