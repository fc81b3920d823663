import random

import numpy as np
from sievework.llm.factorization import Features, Machine, fit_quality, score_quality


def test_identity_equals_all_pairs():
    rnd = np.random.default_rng(1)
    f = Features(512)
    doc = f.of(b"one two two Three 4 # x\ny")
    m = Machine(0.3, rnd.normal(size=528), rnd.normal(size=(528, 4)))
    at, x = doc
    raw = 0.3 + float((m.weight[at] * x).sum())
    raw += sum(float(m.factor[at[i]] @ m.factor[at[j]]) * float(x[i]) * float(x[j]) for i in range(len(at)) for j in range(i))
    assert abs(m.score([doc, f.of(b"")])[0] - 1 / (1 + np.exp(-raw))) < 1e-6


def test_learns_an_interaction():
    rnd = random.Random(2)
    docs, labels = [], []
    f = Features(256)
    for _ in range(600):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        docs.append(f.of(f"{'alpha' if a else 'beta'} {'gamma' if b else 'delta'}".encode()))
        labels.append(int(a == b))
    m = Machine.fit(docs, labels, buckets=256, epochs=60)
    assert np.mean((m.score(docs) >= 0.5) == labels) > 0.95


def test_held_out_accuracy_and_edges(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 8)))
    rows, labels = [], []
    for i in range(600):
        good = rnd.random() < 0.7
        words = [word() for _ in range(rnd.randrange(20, 80))]
        rows.append((i, " ".join(words) if good else " | ".join(w.upper() for w in words), 0.0))
        labels.append((i, int(good)))
    rows += [(None, None, 0.0), (5000, "", 0.0), (5000, "", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(4)
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    got = score_quality(df, fit_quality(df, lab)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    truth = dict(labels)
    assert len(held) > 150 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    flipped = spark.createDataFrame([(i, 1 - q) if r else (i, q) for (i, q), r in zip(labels, [x.held_out for x in sorted((g for g in got if g.doc_id is not None and g.doc_id < 600), key=lambda g: g.doc_id)], strict=True)], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in score_quality(df, fit_quality(df, flipped)).collect()}
    assert again == {r.doc_id: r.score for r in got}  # held-out labels are not learned
    assert score_quality(df.limit(0), fit_quality(df.limit(0), lab)).count() == 0


def test_without_labels_and_with_repeated_ids(spark):
    rows = [(i, f"text {i} " * (1 + 40_000 * (i == 3)), "l") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score_quality(df, fit_quality(df, none)).collect()} == {0.5}
    one = spark.createDataFrame([(7, 1), (7, 0)], "doc_id long, quality int")
    repeated = df.union(spark.createDataFrame([(7, f"again {i}", "l") for i in range(500)], df.schema))
    seen = []
    fit = Machine.fit
    Machine.fit = classmethod(lambda cls, documents, labels, **k: seen.append((len(documents), list(labels))) or fit.__func__(cls, documents, labels, **k))
    try:
        fit_quality(repeated, one)
    finally:
        Machine.fit = fit
    assert seen == [(1, [1])]
