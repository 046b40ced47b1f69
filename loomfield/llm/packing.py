"""Vector best-fit packing of token sequences into bins with several capacities."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .bpe import WHITE, tokenizer_path, vocabulary
from .common import materialize, table

#: Pieces that one task ranks, about.
RANKED = 50_000


@dataclass(frozen=True)
class Capacities:
    """What a bin holds at most: tokens, documents, and attention cost, the sum of squared lengths. `weights` say how
    much each counts in the choice of a bin; rule is 'norm' (least weighted residual after the piece is in) or 'dot'
    (largest weighted product of the piece and the residual before).

    The limits of documents and attention follow from that of tokens unless they are set lower; then they bind, and
    more bins may be needed."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[tiktoken.Encoding, re.Pattern, dict[str, int]]:
    """The tokenizer of a byte-level file: the merges give each token's rank, which must be its id."""
    v = vocabulary(path)
    back = {letter: b for b, letter in enumerate(v.letters)}
    ranks = {bytes(back[c] for c in token): i for token, i in v.ids.items()}
    made = [v.ids[a + b] for a, b in v.merges]
    if v.end or made != sorted(made):
        raise ValueError(f"the ids of {path} don't follow its merges")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), re.compile("(" + "|".join(map(re.escape, v.specials)) + ")"), v.specials


#: White space runs from this length on are cut out before the pattern sees them: its lookahead backtracks over them.
RUN = 1000
_RUNS = re.compile(f"[{WHITE}]{{{RUN},}}")


def encode_plain(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a text without special strings, with white space runs of any length.

    No word takes white space at its end, and of a run before a word only the last character can go with the word. So
    the pattern makes one piece of the run before that (of all of it at the text's end), and starts anew after it."""
    if len(text) < RUN:
        return encoding.encode_to_numpy(text, disallowed_special=())
    parts, at = [], 0
    for m in _RUNS.finditer(text):
        end = m.end() - (m.end() < len(text))
        parts += [encoding.encode_to_numpy(text[at : m.start()], disallowed_special=()), np.array(encoding._core_bpe.encode_single_piece(text[m.start() : end].encode()), np.uint32)]
        at = end
    parts.append(encoding.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(parts)


def encode(text: str | None, path: str) -> np.ndarray:
    """Ids of a whole text as the tokenizers library gives them without added special tokens. Null: none."""
    encoding, special, ids = encoder(path)
    parts = [np.array([ids[x]], np.uint32) if i % 2 else encode_plain(encoding, x) for i, x in enumerate(special.split(text or ""))]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def piece_lengths(n: int, size: int) -> list[int]:
    """A document of n ids in pieces of `size`; the first may be shorter."""
    return ([n % size] if n % size else []) + [size] * (n // size)


def pieces(docs: DataFrame, path: str, size: int = 1024, end: int | None = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids, closed by `end`. A null or empty text is the
    end id alone, or no piece without one."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"]
    schema = StructType([kind, StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closing = np.array([] if end is None else [end], np.uint32)
        for batch in batches:
            own, rest = [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.concatenate([encode(text.as_py(), path), closing]).astype("<u4")
                at = 0
                for i, n in enumerate(piece_lengths(len(ids), size)):
                    own.append(row)
                    rest.append((i, at, n, zlib.crc32(ids[at : at + n].tobytes())))
                    at += n
            columns = list(zip(*rest, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=schema.names)

    return docs.mapInArrow(cut, schema)


def plan(histogram: dict[int, int], limits: Capacities) -> tuple[np.ndarray, int]:
    """Packs histogram[length] pieces of each length, longest first, each into the best bin that it fits under every
    capacity, or else a new one.

    All that the choice looks at follows from a piece's length, so bins with the same contents are kept as one group
    and the work grows with the number of lengths, not of pieces. A bin that a piece was best for is best for the next
    piece of that length while it fits, so bins are filled with as many as fit at once.

    Gives runs of (length, first rank, count, first bin, pieces in each bin, offset of the first), and the number of
    bins: the pieces of a length with ranks from `first rank` on go, so many a bin, to the bins from `first bin` on."""
    capacity = np.array([limits.tokens, limits.documents, limits.attention], np.int64)
    weights = np.array(limits.weights)
    # Groups: what is left in each of `many` bins, and the (length, pieces a bin) put in so far.
    left, many, inside = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), []
    closed: list[tuple[int, tuple]] = []
    for length in sorted(histogram, reverse=True):
        count, piece = histogram[length], np.array([length, 1, length * length], np.int64)
        if (piece > capacity).any():
            raise ValueError(f"a piece of {length} tokens is over a bin's capacity")
        while count:
            fits = np.flatnonzero((left >= piece).all(axis=1) & (many > 0))
            if len(fits):
                if limits.rule == "dot":
                    score = -((left[fits] / capacity) * (piece / capacity) * weights).sum(axis=1)
                else:
                    score = (((left[fits] - piece) / capacity) ** 2 * weights).sum(axis=1)
                g = int(fits[np.argmin(score)])
                room, bins = left[g], int(many[g])
            else:
                g, room, bins = -1, capacity, count
            each = int((room // piece).min())
            filled = min(bins, count // each) if count >= each else 0
            if not filled:
                each, filled = count, 1
            contents = ((length, each), *(inside[g] if g >= 0 else ()))
            if g >= 0:
                many[g] -= filled
            left = np.vstack([left, room - each * piece])
            many = np.append(many, filled)
            inside.append(contents)
            count -= filled * each
        least = min((x for x in histogram if x < length), default=None)
        done = (many == 0) | (left[:, 0] < (least if least is not None else limits.tokens + 1)) | (left[:, 1] == 0)
        closed += [(int(many[i]), inside[i]) for i in np.flatnonzero(done & (many > 0))]
        inside = [inside[i] for i in np.flatnonzero(~done)]
        left, many = left[~done], many[~done]
    runs, ranks, first = [], dict.fromkeys(histogram, 0), 0
    for bins, contents in closed:
        offset = 0
        for length, each in reversed(contents):
            runs.append((length, ranks[length], bins * each, first, each, offset))
            ranks[length] += bins * each
            offset += length * each
        first += bins
    return np.array(sorted(runs), np.int64).reshape(-1, 6), first


def place(cut: DataFrame, limits: Capacities) -> DataFrame:
    """cut (doc_id, piece, length and any columns without an underscore first) and sequence_id and offset.

    The lengths' counts are the whole instance, at most as many as a bin has tokens, so the driver plans on them. Each
    piece then needs its rank among the pieces of its length: blocks by hash number their own, and the blocks' counts
    are summed up, so that a length that most pieces have is still dealt to many tasks."""
    blocks = max(16, cut.count() // RANKED)
    cut = cut.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("long"))
    counts = materialize(cut.groupBy("length", "_block").agg(F.count("*").alias("_n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    runs, _ = plan(histogram, limits)
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_block")) - F.col("_n")
    counts = counts.select("length", "_block", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "piece")) - 1
    ranked = cut.withColumn("_rank", own.cast("long")).join(counts, ["length", "_block"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_block", "_before")
    schema = StructType([f for f in ranked.schema.fields if f.name != "_rank"] + [StructField("sequence_id", LongType()), StructField("offset", LongType())])
    at = [ranked.columns.index("length"), ranked.columns.index("_rank")]
    keys = runs[:, 0] << 44 | runs[:, 1]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in at)
            run = runs[np.searchsorted(keys, length << 44 | rank, "right") - 1] if len(length) else runs[:0]
            nth = rank - run[:, 1]
            columns = [c for i, c in enumerate(batch.columns) if i != at[1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(run[:, 3] + nth // np.maximum(run[:, 4], 1)), pa.array(run[:, 5] + nth % np.maximum(run[:, 4], 1) * length)], names=schema.names)

    return ranked.mapInArrow(seat, schema)


def pack(docs: DataFrame, path: str, limits: Capacities = Capacities(), end: int | None = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of docs.

    Documents of over limits.tokens ids are cut, others stay whole. Rows that repeat, or lack a doc_id, are packed like
    any other. Other columns are dropped. An empty table gives an empty table."""
    cut = materialize(pieces(docs, path, limits.tokens, end, text, doc_id), "pieces")
    return place(cut, limits).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Pieces of every document and their places in sequences. A null or empty text is its end id; repeated rows are
    packed each; other columns are dropped; an empty table gives an empty table."""
    return pack(table(spark, sf_dir, "documents"), path or tokenizer_path("byte_bpe_50k.json"))
