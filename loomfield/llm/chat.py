"""Chat formatting by token-level assembly: segments are encoded on their own and reserved ids put between them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .bpe import tokenizer_path, vocabulary
from .common import table
from .packing import encode_plain, encoder

#: Control strings; their ids follow the vocabulary's, in this order.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
#: Role: (before the text, after it). Other roles are written out: [ROLE]name[/ROLE]text</s>.
TURNS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}

_PLAIN = re.compile(r"(\[)(\\*)(/?(?:INST|ROLE)\])|(<)(\\*)(/?s>|</?SYS>>)")
_ESCAPED = re.compile(r"(\[)(\\+)(/?(?:INST|ROLE)\])|(<)(\\+)(/?s>|</?SYS>>)")


def escape(text: str) -> str:
    """Puts one backslash more after the first letter of each control string, with backslashes there already or not."""
    return _PLAIN.sub(lambda m: f"{m[1] or m[4]}\\{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def unescape(text: str) -> str:
    """The inverse of escape()."""
    return _ESCAPED.sub(lambda m: f"{m[1] or m[4]}{(m[2] or m[5])[1:]}{m[3] or m[6]}", text)


class Template:
    """Assembles and reads back turns with one tokenizer file."""

    def __init__(self, path: str):
        self.encoding = encoder(path)[0]
        v = vocabulary(path)
        first = max([*v.ids.values(), *v.specials.values()]) + 1
        self.ids = {c: first + i for i, c in enumerate(CONTROLS)}
        self.first = first

    def _encode(self, text: str) -> np.ndarray:
        return encode_plain(self.encoding, escape(text))

    def turn(self, role: str | None, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a turn and its loss mask: 1 on the text of an assistant. The mask is the prefix sum of +1 where a
        text under the loss begins and -1 where it ends."""
        role = role or ""
        before, after = TURNS.get(role, ("[ROLE]", "</s>"))
        parts = [np.array([self.ids[before]])]
        if role not in TURNS:
            parts += [self._encode(role), np.array([self.ids["[/ROLE]"]])]
        start = sum(map(len, parts))
        parts += [self._encode(text or ""), np.array([self.ids[after]])]
        ids = np.concatenate(parts).astype(np.int32)
        steps = np.zeros(len(ids) + 1, np.int32)
        if role == "assistant":
            steps[start] += 1
            steps[len(ids) - 1] -= 1
        return ids, np.cumsum(steps[:-1]) > 0

    def decode(self, ids: np.ndarray) -> str:
        """The formatted text of ids."""
        return "".join(CONTROLS[x - self.first] if isinstance(x, int) else x for x in self._segments(ids))

    def _segments(self, ids: np.ndarray) -> Iterator[int | str]:
        """Reserved ids, and the texts between them."""
        at = 0
        for i in [*np.flatnonzero(ids >= self.first).tolist(), len(ids)]:
            if i > at:
                yield self.encoding.decode_bytes(ids[at:i].tolist()).decode("utf-8", "replace")
            if i < len(ids):
                yield int(ids[i])
            at = i + 1

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of the ids of one turn."""
        found = [CONTROLS[x - self.first] if isinstance(x, int) else unescape(x) for x in self._segments(ids)]
        kinds = [isinstance(x, int) for x in self._segments(ids)]
        roles = {before: role for role, (before, _) in TURNS.items()}
        if found[0] in roles and kinds[0]:
            return roles[found[0]], "".join(x for x, control in zip(found, kinds, strict=True) if not control)
        end = next(i for i, (x, control) in enumerate(zip(found, kinds, strict=True)) if control and x == "[/ROLE]")
        return "".join(found[1:end]), "".join(found[end + 1 : -1])

    def under_loss(self, ids: np.ndarray, mask: np.ndarray) -> str:
        return unescape(self.encoding.decode_bytes(ids[mask].tolist()).decode("utf-8", "replace"))


def _template(path: str, held: dict = {}) -> Template:  # noqa: B006  one a worker
    if path not in held:
        held[path] = Template(path)
    return held[path]


def format_turns(conversations: DataFrame, path: str) -> DataFrame:
    """(conv_id, turn, _tie, ids, mask, n_tokens) for each row of conversations (conv_id, turn, role, text).

    Null texts are empty, null roles are the empty role; other columns are dropped. _tie orders rows of one turn number:
    none is dropped. Each row is encoded by itself, so a conversation of any length is spread over tasks."""
    rows = conversations.select("conv_id", "turn", F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("_tie"), "role", "text")
    schema = StructType([*rows.schema.fields[:3], StructField("ids", ArrayType(IntegerType())), StructField("mask", ArrayType(BooleanType())), StructField("n_tokens", LongType())])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = _template(path)
        for batch in batches:
            turns = [template.turn(r, t) for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            sizes = np.array([len(ids) for ids, _ in turns], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *(x for x, _ in turns)]).astype(np.int32)))
            mask = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, bool), *(x for _, x in turns)]).astype(bool)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ids, mask, pa.array(sizes)], names=schema.names)

    return rows.mapInArrow(assemble, schema)


def with_offsets(turns: DataFrame) -> DataFrame:
    """turns and the place of each one's first token in its conversation, a prefix sum over the turns before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("token_offset", F.coalesce(F.sum("n_tokens").over(order), F.lit(0).cast("long")))


def read_back(turns: DataFrame, path: str) -> DataFrame:
    """Digests of each conversation, from the ids and masks alone. A conversation's turns pass one after another, and
    only sums and hash states are held, so a conversation of any length takes the memory of one batch."""
    rows = turns.select("conv_id", "turn", "_tie", "ids", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "_tie")
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = StructType([turns.schema["conv_id"]] + [StructField(n, StringType() if n.endswith("256") else LongType()) for n in names])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = _template(path)
        kind = None
        now, state, out = None, None, []

        def flush(final: bool = False) -> Iterator[pa.RecordBatch]:
            if state is not None and final:
                out.append((now, *_closed(state)))
            if out and (final or len(out) >= 5000):
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c) for c in columns[1:])], names=schema.names)
                out.clear()

        for batch in batches:
            kind = batch.column(0).type
            for conv, ids, mask in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, *_closed(state)))
                    now, state = conv, [0, sha256(), 0, sha256(), 0]
                own, under = ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False)
                role, text = template.read(own)
                loss = template.under_loss(own, under)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(template.decode(own))
            yield from flush()
        yield from flush(True)

    return rows.mapInArrow(digest, schema)


def _closed(state: list) -> list:
    return [x.hexdigest() if hasattr(x, "hexdigest") else x for x in state]


def op3_chat(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of every conversation and of conversation -1, read back from the formatted ids. Null texts and roles are
    empty; rows of one turn number, repeated ones too, are turns each, in the order of a hash; other columns are
    dropped; an empty table gives conversation -1 alone."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(rows.unionByName(probe), path), path)


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (SELECT *, regexp_replace(text, '(\[)(\\*/?(?:INST|ROLE)\])|(<)(\\*(?:/?s>|</?SYS>>))', '\1\3\\\2\4', 'g') AS escaped FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  CAST(sum(length(escaped) + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 7 ELSE 17 + length(role) END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""
