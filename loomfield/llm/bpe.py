"""Byte-pair vocabularies: reading, counting with a heap and a linked list, and encoding with an automaton."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Entries that a worker's word memory holds before it starts anew: about 100 MB.
MEMORY = 400_000


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [chr(b) if b in plain else "" for b in range(256)]
    spare = iter(range(256, 512))
    return [x or chr(next(spare)) for x in out]


#: White space as the tokenizers' pattern language has it.
WHITE = r"\t-\r \x85\xA0  -     　"


#: Letters and numbers of Unicode 16, which the tokenizers library knows and unicodedata doesn't; lower case new with Unicode 16 and 17.
_SIXTEEN = regex.compile("[\u1c89\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d40-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4\U00011380-\U000113b7\U000113d1\U000113d3\U000116d0-\U000116e3\U00011bc0-\U00011be0\U00011bf0-\U00011bf9\U00013460-\U000143fa\U00016100-\U0001611d\U00016130-\U00016139\U00016d40-\U00016d6c\U00016d70-\U00016d79\U00018cff\U0001ccf0-\U0001ccf9\U0001e5d0-\U0001e5ed\U0001e5f0-\U0001e5fa]")
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}


def _ranges(letters: str) -> str:
    """Ascending letters as the inside of a character class."""
    out: list[list[str]] = []
    for c in letters:
        if out and ord(c) == ord(out[-1][1]) + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(a if a == b else f"{a}-{b}" for a, b in out)


class Vocabulary:
    """A vocabulary file of the tokenizers library: BPE over bytes, with or without a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.specials.items()}
        self.letters = byte_letters()
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.normalized = spec["normalizer"] is not None
        # Letters and numbers that the regex module knows and the tokenizers library doesn't yet.
        newer = "".join(regex.findall(r"[\p{L}\p{N}]", "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and not _SIXTEEN.match(c))))
        newer = _ranges(newer)
        self.newer = regex.compile(f"[{newer}]") if newer else None
        self.maybe = re.compile(f"[{newer[0]}-\U0010ffff]") if newer else None
        self.split = self._pattern(r"\p{L}", r"\p{N}", "")
        self.exact = self._pattern(f"[\\p{{L}}--[{newer}]]", f"[\\p{{N}}--[{newer}]]", newer) if newer else self.split

    def _pattern(self, letter: str, number: str, newer: str) -> regex.Pattern:
        other = rf"(?:[^{WHITE}\p{{L}}\p{{N}}]|[{newer}])+" if newer else rf"[^{WHITE}\p{{L}}\p{{N}}]+"
        if self.end:
            return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|{other}")
        return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

    def pieces(self, text: str) -> list[str]:
        """text cut at special strings, which stand at the odd places."""
        return self.special_pattern.split(text) if self.special_pattern else [text]

    def words(self, piece: str) -> list[str]:
        """The words of a piece without special strings, normalized where the file says so."""
        if self.normalized:
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
            if self.maybe and not piece.isascii() and self.maybe.search(piece):
                piece = piece.translate(_LOWER)
        if self.newer and not piece.isascii() and self.maybe.search(piece) and self.newer.search(piece):
            return self.exact.findall(piece)
        return self.split.findall(piece)


class HeapCounter:
    """Counts tokens of a word: the lowest-rank adjacent pair is merged until none is left; no ids are made."""

    def __init__(self, vocabulary: Vocabulary):
        ids = vocabulary.ids
        self.rank: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(vocabulary.merges):
            self.rank.setdefault(ids[a] << 20 | ids[b], (rank, ids[a + b] if not vocabulary.end or (a + b) in ids else -1))
        self.first = [ids[x] for x in vocabulary.letters]
        self.last = [ids[x + vocabulary.end] for x in vocabulary.letters]

    def count(self, word: bytes) -> int:
        n = len(word)
        if n < 2:
            return n
        rank = self.rank
        ids = [self.first[b] for b in word[:-1]]
        ids.append(self.last[word[-1]])
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r[0], i, r[1]) for i in range(n - 1) if (r := rank.get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or (now := rank.get(ids[i] << 20 | ids[j])) is None or now[0] != r:
                continue  # one of the two has been merged since
            merges += 1
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if now := rank.get(new << 20 | ids[k]):
                    heapq.heappush(heap, (now[0], i, now[1]))
            h = before[i]
            if h >= 0 and (now := rank.get(ids[h] << 20 | new)):
                heapq.heappush(heap, (now[0], h, now[1]))
        return n - merges


class Automaton:
    """The deterministic automaton over tokens that accepts just the tokenizations that the merges make.

    At first one state takes any symbol and stays. Each merge (u, v) -> w then puts in a gadget: the state after u,
    which takes v, is copied without its v-arc for those that come by u; w leads from wherever u leads to where v led.
    Where u = v the copy doesn't take w either, as merging goes from left to right. All arcs of a label lead to the
    same state, so state[t] says where t leads, and a state is its parent, the label taken from it, and its time. That
    a state takes t then follows along t's left parts, for labels younger than the state, and along the parents."""

    def __init__(self, vocabulary: Vocabulary):
        ids, merges, end = vocabulary.ids, vocabulary.merges, vocabulary.end
        base = [*vocabulary.letters, *(x + end for x in vocabulary.letters if end)]
        size = max(ids.values()) + 1
        self.born, self.left, self.twin = [-1] * size, [-1] * size, [False] * size
        self.state = [0] * size
        self.created, self.parent, self.taken = [-2], [0], [-1]
        known = {ids[x] for x in base}
        for time, (a, b) in enumerate(merges):
            u, v, w = ids[a], ids[b], ids[a + b]
            q = self.state[u]
            if u not in known or v not in known or w in known or not self.takes(q, v):
                continue  # a dead rule
            known.add(w)
            self.born[w], self.left[w], self.twin[w] = time, u, u == v
            self.state[w] = self.state[v]
            self.created.append(time)
            self.parent.append(q)
            self.taken.append(v)
            self.state[u] = len(self.created) - 1
        # The arcs' labels, letter by letter: (node << 10 | symbol) -> node, and node -> token.
        symbol = {x: i for i, x in enumerate(base)}
        self.last = 256 if end else 0
        self.step: dict[int, int] = {}
        self.token = [-1]
        for t in known:
            name = vocabulary.tokens[t]
            ending = end and name.endswith(end)
            name = name.removesuffix(end) if ending else name
            node = 0
            for i, x in enumerate(name):
                key = node << 10 | symbol[x + end if ending and i == len(name) - 1 else x]
                node = self.step.setdefault(key, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = t
        self.arcs: dict[int, bool] = {}

    def takes(self, state: int, token: int) -> bool:
        """Whether an arc labelled token leaves the state."""
        born, left, created = self.born, self.left, self.created
        while True:
            while born[token] > created[state] and left[token] >= 0 or born[token] == created[state]:
                if born[token] == created[state] and self.twin[token]:
                    return False
                token = left[token]
            if not state:
                return True
            if token == self.taken[state]:
                return False
            state = self.parent[state]

    def encode(self, word: bytes) -> list[int]:
        """The labels of the one accepted path that spells the word.

        At each place the arcs are tried from the longest label on. Each prefix of a word has one accepted path, so a
        place from which no path leads on is never entered again: the steps grow with the word's length."""
        n = len(word)
        codes = list(word)
        codes[-1] += self.last
        step, token, arcs, state_of = self.step.get, self.token, self.arcs, self.state
        path: list[int] = []  # labels so far
        places = [0]
        open_arcs: list[list[tuple[int, int]]] = []  # at each place, the arcs not tried yet
        dead: set[int] = set()
        while True:
            i = places[-1]
            if i == n:
                return path
            if len(open_arcs) < len(places):
                node, found = 0, []
                for j in range(i, n):
                    node = step(node << 10 | codes[j], 0)
                    if not node:
                        break
                    if (t := token[node]) >= 0:
                        found.append((t, j + 1))
                open_arcs.append(found)
            state, found = state_of[path[-1]] if path else 0, open_arcs[-1]
            while found:
                t, j = found.pop()
                if j in dead:
                    continue
                key = state << 17 | t
                if (taken := arcs.get(key)) is None:
                    if len(arcs) >= MEMORY:
                        arcs.clear()
                    taken = arcs[key] = self.takes(state, t)
                if taken:
                    path.append(t)
                    places.append(j)
                    break
            else:
                dead.add(i)
                open_arcs.pop()
                places.pop()
                path.pop()


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def counter(path: str) -> HeapCounter:
    return HeapCounter(vocabulary(path))


@lru_cache(maxsize=4)
def automaton(path: str) -> Automaton:
    return Automaton(vocabulary(path))


class _Memory(dict):
    """What has been worked out for words. When full, all but the words used of late is forgotten."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word):
        if len(self) >= MEMORY // 2:
            self.old = dict(self)
            self.clear()
        value = self.old.get(word)
        self[word] = value = self.make(word) if value is None else value
        return value


@lru_cache(maxsize=4)
def count_memory(path: str) -> _Memory:
    count = counter(path).count
    return _Memory(lambda word: count(word.encode("utf-8", "replace")))


@lru_cache(maxsize=4)
def encode_memory(path: str) -> _Memory:
    v, a = vocabulary(path), automaton(path)

    def make(word: str) -> tuple[int, str, str]:
        found = a.encode(word.encode("utf-8", "replace"))
        return len(found), " ".join(map(str, found)), " ".join(v.tokens[t] for t in found)

    return _Memory(make)


def count_tokens(text: str | None, path: str) -> int:
    """Tokens of a whole text; a special string counts one. Null: 0."""
    v, memory, n = vocabulary(path), count_memory(path), 0
    for i, piece in enumerate(v.pieces(text or "")):
        n += 1 if i % 2 else sum(map(memory.__getitem__, v.words(piece)))
    return n


def encode_text(text: str | None, path: str) -> tuple[int, str, str]:
    """(number of ids, ids in decimal joined by spaces, labels joined by spaces) of a whole text. Null: none."""
    v, memory = vocabulary(path), encode_memory(path)
    n, ids, labels = 0, [], []
    for i, piece in enumerate(v.pieces(text or "")):
        found = [(1, str(v.specials[piece]), piece)] if i % 2 else map(memory.__getitem__, v.words(piece))
        for k, x, y in found:
            n += k
            ids.append(x)
            labels.append(y)
    return n, " ".join(ids), " ".join(labels)


def decode(ids: list[int], path: str) -> str:
    """The labels of the arcs, joined by spaces as the library does where the file names no decoder."""
    v = vocabulary(path)
    return " ".join(v.tokens[i] for i in ids)


def with_token_counts(docs: DataFrame, path: str, text: str = "text", to: str = "n_tokens") -> DataFrame:
    """docs and the number of tokens of each whole text. Null or empty: 0. Rows that repeat count alike; a column of
    docs already named `to` is replaced."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([count_tokens(x, path) for x in texts], dtype="int64")

    return docs.withColumn(to, of(F.col(text)))


def op9_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None, limit: int = 512) -> DataFrame:
    """Bytes and tokens of every document. Null texts are empty; repeated rows have a row each;
    other columns are dropped; an empty table gives an empty table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = with_token_counts(docs, path or tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with `_bpe`: struct(n_tokens, ids, decoded), ids in decimal joined by spaces. Null or empty text: 0 and
    two empty strings. Rows that repeat are encoded alike; a column of docs already named _bpe is replaced, the others
    stay; an empty table stays empty."""

    @F.pandas_udf("struct<n_tokens long, ids string, decoded string>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([encode_text(x, path) for x in texts], columns=["n_tokens", "ids", "decoded"])

    return docs.withColumn("_bpe", of(F.col(text)))


def digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) without the ids leaving the worker. A null or empty text has no
    tokens and the digests of nothing; repeated rows have a row each; other columns are dropped; an empty table gives
    an empty table."""
    from hashlib import sha256

    @F.pandas_udf("struct<n_tokens long, ids_sha256 string, decoded_sha256 string>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for x in texts:
                n, ids, labels = encode_text(x, path)
                rows.append((n, sha256(ids.encode()).hexdigest(), sha256(labels.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), of(F.col(text)).alias("_bpe")).select("doc_id", "_bpe.*")


def op5_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of ids and decoded text of every document. Null texts are empty; repeated rows have a row each;
    other columns are dropped; an empty table gives an empty table."""
    return digests(table(spark, sf_dir, "documents"), path or tokenizer_path("word_bpe_49k.json"))
