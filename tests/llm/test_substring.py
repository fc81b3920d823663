import hashlib
import random
import re
import time

from sievework.llm.substring import remove_repeats


def brute(rows, window):
    first = {}
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    key = lambda i: 2**63 - 1 if i is None else i
    for i, words in docs:
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            first[w] = min(first.get(w, (key(i), s)), (key(i), s))
    out = []
    for i, words in docs:
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] != (key(i), s):
                gone |= set(range(s, s + window))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def corpus(rnd, docs, vocab):
    passages = [[rnd.choice(vocab) for _ in range(rnd.randrange(15, 70))] for _ in range(8)]
    texts = [None, "", "a", "x " * 60, "x y " * 40]
    for _ in range(docs):
        words = []
        for _ in range(rnd.randrange(1, 6)):
            p = list(rnd.choice(passages))
            a, b = sorted((rnd.randrange(len(p)), rnd.randrange(len(p))))
            words += p if rnd.random() < 0.4 else p[a:b]
            words += [rnd.choice(vocab) for _ in range(rnd.randrange(25))]
        texts.append("\n".join(words) if rnd.random() < 0.5 else " ".join(words))
        if rnd.random() < 0.2:
            texts.append(texts[-1])
    return texts


def test_equals_brute_force(spark):
    rnd = random.Random(6)
    order = lambda r: (r[0] is None, r[0] or 0)
    for window, gram, vocab in ((20, 8, [f"w{i}" for i in range(200)]), (6, 2, list("abé")), (5, 5, [f"w{i}" for i in range(30)])):
        texts = corpus(rnd, 50, vocab)
        ids = rnd.sample(range(1000), len(texts))
        rows = list(zip(ids, texts, strict=True)) + [(None, texts[8])]
        df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, anchor int").repartition(6)
        got = sorted((tuple(r)[:4] for r in remove_repeats(df, window=window, gram=gram, digests=True).collect()), key=order)
        assert got == sorted(brute(rows, window), key=order)


def test_rows_of_one_id_and_real_outputs(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (2, "x " + text + " y"), (3, "short")], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed, r.kept_text) for r in remove_repeats(df).collect()}
    assert got == {(1, 0, text), (2, 30, "x y"), (3, 0, "short")}
    assert [tuple(x) for x in remove_repeats(df).filter("doc_id = 2").first().repeats] == [(1, 31)]
    assert remove_repeats(df.limit(0)).count() == 0


def test_rows_without_an_id_are_not_gathered(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    texts = [" ".join([*(f"w{i}-{k}" for k in range(60)), passage, *(f"v{i}-{k}" for k in range(60))]) for i in range(3000)]

    def run(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        began = time.time()
        removed = sorted(r.n_removed for r in remove_repeats(df, digests=True).collect())
        return time.time() - began, removed

    run(list(enumerate(texts[:50])))
    with_ids, got = run(list(enumerate(texts)))
    assert got == [0] + [25] * 2999
    for ids in (lambda i: None, lambda i: 7, lambda i: i // 2):
        seconds, got = run([(ids(i), t) for i, t in enumerate(texts)])
        assert got == ([0, 0] + [25] * 2998 if ids(5) == 2 else [0] * 3000)  # rows of one id don't remove each other
        assert seconds < 3 * with_ids + 5


def test_very_long_text(spark):
    words = " ".join(f"w{i % 5000}" for i in range(60_000))
    df = spark.createDataFrame([(1, words, "x"), (2, "a b " + words[:3000], "x")], "doc_id long, text string, row string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeats(df, digests=True).collect()}
    assert got[1] == (60_000, 55_000) and got[2][1] > 500
