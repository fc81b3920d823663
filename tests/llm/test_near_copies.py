import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_representatives(rows):
    """Ids that stand for the components of all pairs with five-word similarity 0.8 or more."""
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted({root(i) for i in sets})


def edited(rnd, words, n):
    w = list(words)
    for at in rnd.sample(range(len(w)), n):
        w[at] = f"x{rnd.randrange(10**6)}"
    return w


def test_pipeline_near_dedup_equals_brute_force(spark):
    rnd = random.Random(21)
    vocab = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one", "One", "one two three four five", "ONE two  three four five", "one two three four five six"]
    for _ in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.randrange(40, 300))]
        texts.append(" ".join(base))
        texts += [" ".join(edited(rnd, base, rnd.randrange(0, 1 + len(base) // 30))) for _ in range(4)]
        drift = base
        for _ in range(4):  # a chain whose ends are not similar
            drift = edited(rnd, drift, max(1, len(base) // 50))
            texts.append(" ".join(drift))
        texts.append(" ".join([*base[: len(base) // 2], *(rnd.choice(vocab) for _ in range(len(base) // 2))]))
    rows = list(zip(rnd.sample(range(10**4), len(texts)), texts, strict=True))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(5)
    left = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in left) == brute_representatives(rows)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0
