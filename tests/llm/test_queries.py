"""Each query over whole tables against brute force in plain Python, on the smallest tables."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from pathlib import Path

import duckdb
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

from loomfield.llm import chat, packing, secrets
from loomfield.llm.registry import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(text):
    return sha256(text.encode()).hexdigest()


@pytest.fixture(scope="session")
def docs(small):
    return pq.read_table(f"{small}/documents.parquet").to_pylist()


@pytest.fixture(scope="session")
def got(spark, small):
    """Rows of a query by doc_id, run once."""
    held = {}

    def of(name):
        if name not in held:
            held[name] = [r.asDict() for r in QUERIES[name](spark, small).collect()]
        return held[name]

    return of


def test_fingerprints(got, docs):
    rows = got("op1_imatch")
    order = sorted(docs, key=lambda r: -r["doc_id"])
    assert len(rows) == len(docs)
    by = {r["doc_id"]: r for r in rows}
    prints = {}
    for own, after in zip(order, [*order[1:], order[0]], strict=True):
        text, other = own["text"] or "", after["text"] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + other[:n]
        row = by[own["doc_id"]]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), digest(edited))
        assert prints.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        assert prints.setdefault(edited, row["edited_fingerprint"]) == row["edited_fingerprint"]
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        assert (row["near_next"] == 1) or text != other
    edited = sorted(r["near_edited"] for r in rows if r["n_chars"] > 300)
    following = sorted(r["near_next"] for r in rows if r["n_chars"] > 300)
    assert edited[len(edited) // 2] > following[len(following) // 2]


def test_sharding(got, docs):
    rows = got("op2_sharding")
    size = {r["doc_id"]: len((r["text"] or "").encode()) for r in docs}
    assert {r["doc_id"]: r["n_bytes"] for r in rows} == size and len(rows) == len(docs)
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard_id"]].append(r)
        assert len(r["shard_id"]) == r["depth"]
    for name, members in shards.items():
        total = sum(r["n_bytes"] for r in members)
        assert {(r["shard_bytes"], r["shard_docs"]) for r in members} == {(total, len(members))}
        assert total <= 1 << 20 or len(members) == 1
        assert not any(other != name and other.startswith(name) for other in shards)
        if name:  # only a bucket over the limit was split
            assert sum(r["n_bytes"] for r in rows if r["shard_id"].startswith(name[:-1])) > 1 << 20


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(got, small, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "labels"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    key = lambda r: tuple(r[c] for c in sorted(want.columns))
    assert sorted(map(key, got(name))) == sorted(map(key, want.to_dict("records")))


def test_chat_hand_made(got):
    row = next(r for r in got("op3_chat") if r["conv_id"] == -1)
    own = "</s>[INST] ok [/INST]"
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (2, len(own), digest(own))
    assert row["turns_sha256"] == digest(f"user\n{own}\nassistant\n{own}\n")


def python_spans(text):
    found = []
    for nth, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), nth, m.end()))
    return sorted(found)


def test_secrets(got, docs):
    by = {r["doc_id"]: r for r in got("op4_secrets")}
    assert len(by) == len(docs)
    kinds = [r.kind for r in secrets.RULES]
    some = 0
    for r in docs:
        spans = python_spans(r["text"] or "")
        text = lambda s: ",".join(f"{kinds[n]}:{a}:{b}" for a, n, b in s)
        row, count = by[r["doc_id"]], Counter(n for _, n, _ in spans)
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == (count[0], count[1], count[2])
        assert row["base_sha256"] == digest(text([s for s in spans if s[1] < 3])) and row["spans"] == text(spans)
        some += len(spans)
    assert some


@pytest.mark.parametrize(("name", "file"), [("op5_bpe", "word_bpe_49k.json"), ("op9_token_counts", "byte_bpe_50k.json")])
def test_tokenizers(got, docs, name, file):
    library = Tokenizer.from_file(public_tokenizers.path(file))
    by = {r["doc_id"]: r for r in got(name)}
    assert len(by) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        row = by[r["doc_id"]]
        assert row["n_tokens"] == len(ids)
        if name == "op5_bpe":
            assert row["ids_sha256"] == digest(" ".join(map(str, ids)))
            assert row["decoded_sha256"] == digest(library.decode(ids, skip_special_tokens=False))
        else:
            assert row["n_bytes"] == len((r["text"] or "").encode()) and row["over_limit"] == (len(ids) > 512)


def test_packing(got, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = got("op6_packing")
    by = {(r["doc_id"], r["piece"]): r for r in rows}
    want = {}
    for r in docs:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        at = 0
        for i, n in enumerate(packing.piece_lengths(len(ids), 1024)):
            want[r["doc_id"], i] = (at, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + n])))
            at += n
    assert {k: (r["start"], r["length"], r["ids_crc32"]) for k, r in by.items()} == want and len(rows) == len(by)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(n for _, n, _ in want.values())
    assert len(bins) <= 1.02 * total / 1024 + 2


def test_simhash(got, docs):
    prints = {}
    for r in docs:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = got("op7_simhash")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_quality_base(got, docs):
    by = {r["doc_id"]: r for r in got("op8_quality")}
    assert len(by) == len(docs)
    for r in docs:
        text = r["text"] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        many = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
        row = by[r["doc_id"]]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert row["base_failed"] == failed and not (failed and row["kept"])


def test_html_pages(got, small):
    pages = {r["page_id"]: r for r in pq.read_table(f"{small}/pages.parquet").to_pylist()}
    rows = got("op10_html")
    assert {(r["page_id"], r["url"]) for r in rows} == {(i, r["url"]) for i, r in pages.items()}
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and r["text"] == " ".join(r["text"].split())
        assert not re.search(r"</?(?:p|div|script|style|nav)\b", r["text"])
    assert sum(r["n_chars"] > 0 for r in rows) > 0.9 * len(rows)


def test_chat_escapes_round_trip():
    for text in ("", "</s>", r"<\/s>", r"[\\INST]", "[INST][/INST]<<SYS>>", "[\\", "plain", "<s", r"<<\SYS>>"):
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_registered():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == 10
    assert Path(chat.__file__).parent.name == "llm"
