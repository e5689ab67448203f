"""Packing and byte BPE against the tokenizers library."""

import collections
import hashlib
import random
import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegauge.llm import best_fit, bpe_reuse, words

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["  ", "e\u0301", "\n", " a", "b", "é", "é", "日本", "<|endoftext|>", "<|startoftext|>", "'s", "12", ".", ",", " ", "Word ", " THE", "\t", "İ", "Σ", "ς", " ", " ", "😀", "ﬁ"]


def odd_texts(n):
    rng = random.Random(4)
    return ["".join(rng.choices(ODD, k=rng.randrange(120))) for _ in range(n)]


def test_words_are_the_library_s():
    own, library = words.WordEncoder(WORD, most=50), Tokenizer.from_file(WORD)
    for t in odd_texts(300):
        ids = library.encode(t, add_special_tokens=False).ids
        assert own(t) == struct.pack(f"<{len(ids)}I", *ids)


def test_bytes_are_the_library_s_whole_and_joined():
    own, library, rng = bpe_reuse.encoder(BYTE, public_tokenizers.path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(BYTE), random.Random(5)
    for t in odd_texts(200):
        want = library.encode(t, add_special_tokens=False).ids
        assert own(t) == want
        data, parts, a = t.encode(), [], 0
        while a < len(data):
            b = min(len(data), a + rng.randint(1, 60))
            while b < len(data) and data[b] & 0xC0 == 0x80:
                b += 1
            parts.append((data[a:b], own(data[a:b].decode()) if rng.random() < 0.6 else None))
            a = b
        assert own.joined(parts) == want


def test_chunks_cover_the_text_and_follow_content():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdé ") for _ in range(60_000)).encode()
    parts = bpe_reuse.chunks(text)
    assert b"".join(parts) == text and all(p.decode() is not None and len(p) <= bpe_reuse.MOST for p in parts)
    assert len(set(parts) & set(bpe_reuse.chunks(b"some other words " + text))) > len(parts) * 0.8


def digests(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_bpe_reuse(spark, sf):
    library = Tokenizer.from_file(BYTE)
    shared = "A passage of some length that several of the texts hold. " * 60
    runs = [" " * 1_000_000, "\n" * 1_000_000, "a" + "\t " * 60_000 + "b", "word" * 50_000, "x" * 300_000]
    texts = [*odd_texts(20), *runs, *[f"{'x ' * i}{shared}{i} end" for i in range(6)], shared, shared, "", None]
    df = spark.createDataFrame([(i if i else None, t, "n", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, row int")
    got = {r.doc_id: tuple(r[1:]) for r in bpe_reuse.encode_documents(df).collect()}
    assert got == {i if i else None: digests(library, t or "") for i, t in enumerate(texts)}
    assert bpe_reuse.encode_documents(df.limit(0)).count() == 0
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert {r.doc_id: tuple(r[1:]) for r in bpe_reuse.query(spark, sf).collect()} == {r.doc_id: digests(library, r.text) for r in rows}


@pytest.mark.parametrize("capacity", [10, 64, 500])
def test_plans_hold_every_piece_once(capacity):
    rng = random.Random(capacity)
    counts = collections.Counter(rng.randint(1, capacity) if rng.random() < 0.3 else rng.randint(1, max(1, capacity // 5)) for _ in range(2000))
    sequences, got = collections.defaultdict(list), collections.defaultdict(list)
    for length, rank, times, first, offset in best_fit.plan(dict(counts), capacity):
        for i in range(times):
            got[length].append(rank + i)
            sequences[first + i].append((offset, length))
    assert {n: sorted(r) for n, r in got.items()} == {n: list(range(k)) for n, k in counts.items()}
    for slots in sequences.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(sequences) <= 1.02 * sum(n * k for n, k in counts.items()) / capacity + 1
    assert best_fit.plan({}, capacity) == []


def test_packing(spark, sf):
    library = Tokenizer.from_file(WORD)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {}
    for i, t in texts.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            own = ids[k : k + 4096]
            want[i, k // 4096] = (k, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own)))
    rows = best_fit.query(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for slots in sequences.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) == -(-sum(r.length for r in rows) // 4096)  # the lower bound


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "word " * 9000, 0), (2, "a", 0), (2, "a", 0)], "doc_id long, text string, piece int")
    rows = best_fit.pack_documents(df, with_ids=True).collect()
    assert len(rows) == 7 and sorted(r.length for r in rows) == [1, 1, 2, 2, 809, 4096, 4096] and all(len(r.ids) == 4 * r.length for r in rows)
    assert best_fit.pack_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["decimal(9,2)", "date", "short", "string", "boolean", "array<int>"])
def test_packing_takes_any_id_and_name(spark, kind):
    value = {"date": "date '2020-02-03'", "array<int>": "array(1, 2)", "boolean": "true"}.get(kind, f"cast(7 as {kind})")
    df = spark.sql(f"select {value} as length, 'some words' as text, 1 as piece union all select null, null, 2")
    got = best_fit.pack_documents(df, id_col="length")
    assert got.columns == ["length", "piece", "start", "length_", "ids_crc32", "sequence_id", "offset"] and got.schema["length"].dataType.simpleString() == df.schema["length"].dataType.simpleString()
    assert sorted(r.length_ for r in got.collect())[0] == 1 and got.count() == 2
