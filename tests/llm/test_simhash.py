import random
import re

import numpy as np
import xxhash

from sievework.llm import simhash


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, prints):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(ids[i]), root(ids[j])))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_words_at_one_bit_share_a_codeword():
    table = simhash.nearby_codewords()
    assert 2 <= table.shape[1] <= 6
    rnd = np.random.default_rng(1)
    for x in rnd.integers(0, 1 << 16, 300):
        for b in range(16):
            assert set(table[x][table[x] >= 0]) & set(table[x ^ (1 << b)][table[x ^ (1 << b)] >= 0])


def test_links_share_a_key():
    rnd = random.Random(2)
    for _ in range(2000):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), rnd.randrange(4)):
            y ^= 1 << b
        k, w = simhash.keys(np.array([x, y], np.uint64))
        assert set(k[w == 0]) & set(k[w == 1])


def test_components_equal_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randrange(30, 120))] for _ in range(40)]
    texts = [None, "", "\n", "one", "One two", "one TWO", "É é x y"]
    for words in base:
        texts.append(" ".join(words))
        for _ in range(4):
            w = list(words)
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append(" ".join(w))
    ids = list(range(100, 100 + len(texts)))
    rnd.shuffle(ids)
    rows = [(i, t, 0) for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame([*rows, rows[20]], "doc_id long, text string, fp int").repartition(7)
    got = simhash.simhash_digest(df).collect()
    assert len(got) == len(rows) + 1
    prints = {i: brute_print(t) for i, t, _ in rows}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == brute_components(sorted(ids), [prints[i] for i in sorted(ids)])
    kept = simhash.keep_representatives(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r.component_id for r in got})
    assert simhash.simhash_digest(df.limit(0)).count() == 0


def test_random_fingerprints_link_exactly(spark):
    rnd = random.Random(9)
    prints = set()
    for _ in range(60):
        x = rnd.getrandbits(64)
        for _ in range(12):
            prints.add(x)
            for b in rnd.sample(range(64), rnd.randrange(1, 5)):
                x ^= 1 << b
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    parent = {s: s for s in signed}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for e in edges:
        assert ((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 3
        parent[root(e.a)] = root(e.b)
    want = brute_components(signed, [s & (2**64 - 1) for s in signed])
    groups = lambda f: {frozenset(s for s in signed if f(s) == f(t)) for t in signed}
    assert groups(root) == groups(want.get)


def test_one_representative_for_each_component(spark):
    a, b = "alpha beta gamma delta", "one two three four five six"
    schema = "doc_id long, text string, root int, text_key string, component_id int"

    def kept(rows):
        df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], schema)
        out = simhash.keep_representatives(df)
        assert out.columns == df.columns
        return sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in out.collect())

    assert kept([(1, a), (None, a), (None, b)]) == [(-1, b), (1, a)]
    assert kept([(5, a), (5, b), (3, b)]) == [(3, b), (5, a)]
    assert kept([(None, a), (None, a), (None, b)]) == [(-1, a), (-1, b)]
    assert kept([(7, None), (8, ""), (8, "")]) in ([(7, None)], [(7, "")])
    assert kept([(1, a)] * 3) == [(1, a)]
    assert kept([(1, "word " * 60_000), (2, "word " * 60_000)]) == [(1, "word " * 60_000)]
