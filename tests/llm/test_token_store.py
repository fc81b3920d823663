import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from sievework.llm import token_store
from sievework.llm.common import byte_slices
from sievework.llm.perfect_hash import PerfectHash, keys_of, occurrences
from sievework.llm.token_store import LibraryEncoder, open_token_store, write_token_store

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "Hello, World's <|endoftext|> x", "héllo ß ½ İ 日本 ́a", "don't!'s 'S ''", "a" * 3000, "x\x1cy\x85z　w", "The the THE\nthe,"]


def test_perfect_hash():
    for n in (0, 1, 2, 3, 50, 5000):
        rnd = random.Random(n)
        ids = np.sort(np.array([rnd.randrange(-(2**63), 2**63) for _ in range(n)], np.int64))
        keys = keys_of(ids, occurrences(ids))
        index, slot = PerfectHash.build(keys)
        assert sorted(slot.tolist()) == list(range(n))
        assert (index.slots(keys) == slot).all()
        other = keys_of(ids, occurrences(ids) + 1)
        assert (index.slots(other) == -1).all()


def test_encoder_equals_library():
    encoder = LibraryEncoder(PATH, 4)
    got = encoder.texts([t.encode() for t in TEXTS * 2], b"")
    for t, ids in zip(TEXTS * 2, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.library.encode(t, add_special_tokens=False).ids, t


def test_encoder_on_random_texts(monkeypatch):
    """Every plain Latin-1 character beside letters, numbers and marks, and random texts, with a memory that is always full."""
    monkeypatch.setattr(token_store, "PIECES_KEPT", 40)
    rnd = random.Random(4)
    parts = [*map(chr, range(0x20, 0x180)), *"\t\n\x0b\x0c\r\x1c\x85\u0301\u3000İςΣ日😀ﬁ", "<|", "|>", "<", "|", "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'LL", "ÀÉ", "word", "Word's", "12", " ", "  ", "\n\n"]
    texts = [a + b + c for b in map(chr, range(0x21, 0x100)) for a, c in (("a", "É"), ("1", "²"), ("!", "×"), ("é ", " ß"), ("<", "|"))]
    texts += ["".join(rnd.choices(parts, k=rnd.randrange(40))) for _ in range(3000)]
    for width in (2, 4):
        encoder = LibraryEncoder(PATH, width)
        for at in range(0, len(texts), 90):
            some = texts[at : at + 90]
            got = encoder.encode(pa.array(["x", None, *some])[1:], b"\2\0\0\0"[:width])
            for t, ids in zip([None, *some], got.to_pylist(), strict=True):
                assert np.frombuffer(ids, f"<u{width}").tolist() == [*encoder.library.encode(t or "", add_special_tokens=False).ids, 2], t


def test_encoder_work_grows_with_pieces_not_words():
    """20,000 distinct words of 100 distinct pieces: Python is called a few times for each piece, not for each word."""
    stems = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(100, 190)]
    words = [f"{a.title() if k % 2 else a}.{b}{'!' * (1 + k % 3)}" for k, (a, b) in enumerate((a, b) for a in stems for b in stems)]
    words += [w.upper() for w in words] + [f"{w}?" for w in words[:4000]]
    assert len(set(words)) > 20_000
    encoder, calls = LibraryEncoder(PATH, 2), 0
    raw = [" ".join(words).encode()]

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = encoder.texts(raw, b"")
    finally:
        sys.setprofile(None)
    assert np.frombuffer(got[0], "<u2").tolist() == encoder.library.encode(raw[0].decode(), add_special_tokens=False).ids
    assert calls < 2000


def test_byte_slices():
    texts = ["", "aaaa", None, "bb", "c" * 50, "", "dd", "é"]
    batches = pa.table({"text": texts}).to_batches(max_chunksize=6)
    parts = [p["text"].to_pylist() for p in byte_slices(iter(batches), "text", 6)]
    assert parts == [["", "aaaa", None, "bb"], ["c" * 50], [""], ["dd", "é"]]


def test_store(spark, tmp_path):
    rows = [(i * 3 - 50, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(None, "a"), (7, None), (10**18, "end"), (10, "twice"), (10, "twice"), (10, "thrice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    store = write_token_store(df, PATH, rows_per_shard=9, folder=f"file://{tmp_path}/store")
    encoder = LibraryEncoder(PATH, 4).library
    want, before = [], 0
    key = lambda r: 2**63 - 1 if r[0] is None else r[0]
    encoded = sorted(((key(r), np.array([*encoder.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4"), r[0]) for r in rows), key=lambda x: (x[0], x[1].astype("<u2").tobytes()))
    for _, ids, doc_id in encoded:
        want.append((doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
        before += len(ids)
    none_last = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted((tuple(r) for r in open_token_store(store.folder).lookup(df, digests=True).collect()), key=none_last)
    assert got == sorted(want, key=none_last)
    missing = store.lookup(spark.createDataFrame([(8,), (10,)], "doc_id long")).collect()
    assert {r.doc_id: r.n_tokens is None for r in missing} == {8: True, 10: False}
    asks = spark.createDataFrame([(i, "x", 1) for i in [-50, -50, -50, 10, 10, 10, 10, 10, None, None, 8, 8]], "doc_id long, n_tokens string, shard int").repartition(3)
    many = sorted((tuple(r)[:3] for r in store.lookup(asks).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or 0))
    tens = sorted(w[:3] for w in want if w[0] == 10)
    nulls = [w[:3] for w in want if w[0] is None]
    assert many == [want[0][:3]] * 3 + [(8, None, None)] * 2 + sorted([*tens, tens[0]]) + nulls * 2
    long = spark.createDataFrame([(1, "the word " * 50_000, 1, "x")], "doc_id long, text string, shard int, ids string")
    assert write_token_store(long, PATH, folder=f"file://{tmp_path}/long").lookup(long).first().n_tokens == 100_001
    empty = write_token_store(df.limit(0), PATH, folder=f"file://{tmp_path}/empty")
    assert empty.lookup(df.limit(0)).count() == 0
