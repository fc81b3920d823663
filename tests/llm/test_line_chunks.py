import hashlib
import random
import time

import xxhash
from sievework.llm.line_chunks import chunks, dedup_lines

NULL = 2**63 - 1


def naive_chunks(text):
    """(first, end, bytes) of every chunk, rule by rule, from the definition."""
    lines = text.split(b"\n")
    n, out = len(lines), set()
    for bit in range(6):
        for parity in (0, 1):
            ends = [i + 1 for i, x in enumerate(lines) if xxhash.xxh3_64_intdigest(x) >> bit & 1 == parity]
            for a, z in zip([0, *ends], [*ends, n], strict=True):
                if 2 <= z - a <= 32 and sum(bool(x.split()) for x in lines[a:z]) > 1:
                    out.add((a, z, b"\n".join(lines[a:z])))
    return sorted(out)


def brute(rows):
    """Rows of (doc_id, text) and what stays of each: (doc_id, sha256, lines, removed lines)."""
    key = lambda i: NULL if i is None else i
    least = {}
    for i, t in rows:
        for _, _, body in naive_chunks((t or "").encode()):
            least[body] = min(least.get(body, NULL), key(i))
    out = []
    for i, t in rows:
        text = (t or "").encode()
        lines, gone, first = text.split(b"\n"), set(), {}
        for a, z, body in naive_chunks(text):
            first_a, first_z = first.setdefault(body, (a, z))
            if a >= first_z or (least[body] < key(i) and a == first_a):
                gone |= set(range(a, z))
        left = [x for k, x in enumerate(lines) if k not in gone]
        out.append((i, hashlib.sha256(b"\n".join(left)).hexdigest(), len(lines), len(gone)))
    return out


def test_boundaries_follow_the_content():
    rnd = random.Random(1)
    lines = [f"line {rnd.random()}".encode() for _ in range(200)]
    before = {tuple(lines[a:z]) for a, z in chunks(lines)}
    after = {tuple(x[a:z]) for x in [[*lines[:100], b"something new", *lines[100:]]] for a, z in chunks(x)}
    assert len(before - after) <= 24 and len(before) > 300  # chunks across the inserted line
    assert all(2 <= z - a <= 32 for a, z in chunks([b"a b"] * 500))


def test_equals_brute_force(spark):
    rnd = random.Random(8)
    pool = [f"sentence number {i} with é" for i in range(120)] + ["", " "]
    blocks = [[rnd.choice(pool) for _ in range(rnd.randrange(2, 9))] for _ in range(12)]
    texts = [None, "", "one line", "a\nb\na\nb\na\nb", "\n\n\n", "same\n" * 100, "x " * 100_000 + "\n" + "y " * 50_000]
    for _ in range(80):
        lines = []
        for _ in range(rnd.randrange(1, 6)):
            lines += rnd.choice(blocks) if rnd.random() < 0.6 else [rnd.choice(pool) for _ in range(4)]
        texts.append("\n".join(lines))
    texts.append("\n".join(rnd.choice(pool) for _ in range(3000)))
    rows = list(zip(rnd.sample(range(1000), len(texts)), texts, strict=True))
    rows += [(None, texts[9]), (None, texts[9]), (None, texts[12]), (rows[20][0], texts[21]), rows[30]]
    df = spark.createDataFrame([(*r, "x", 5, "y", 1) for r in rows], "doc_id long, text string, doc string, least int, rest string, row int").repartition(5)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(brute(rows), key=order)
    got = sorted((tuple(r) for r in dedup_lines(df, digests=True).collect()), key=order)
    assert [r[:4] for r in got] == want
    assert sum(r[3] for r in got) > 100 and all(bool(r[3]) == bool(r[4]) for r in got)
    full = dedup_lines(df, carry=["doc", "least", "rest"]).collect()
    assert sorted((hashlib.sha256(r.text.encode()).hexdigest()) for r in full) == sorted(r[1] for r in want)
    assert all(r["rest"].doc == "x" and r["rest"].least == 5 and r["rest"].rest == "y" for r in full)
    assert dedup_lines(df.limit(0)).count() == 0


def test_planted_passages_are_found(spark):
    """Share of a planted passage's lines that the later of two texts loses; the lines around it stay."""
    rnd = random.Random(5)
    line = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(12))
    rows, planted = [], {}
    for case in range(600):
        k = (2, 3, 4, 6, 10, 20)[case % 6]
        passage = [line() for _ in range(k)]
        for copy in range(2):
            around = [[line() for _ in range(rnd.randrange(1, 8))] for _ in range(2)]
            rows.append((2 * case + copy, "\n".join([*around[0], *passage, *around[1]])))
        planted[2 * case + 1] = k
    got = {r.doc_id: r.n_removed_lines for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in got if i not in planted)
    assert all(got[i] <= k for i, k in planted.items())
    recall = {k: sum(got[i] for i in planted if planted[i] == k) / sum(k for i in planted if planted[i] == k) for k in (2, 3, 4, 6, 10, 20)}
    assert recall[2] > 0.6 and recall[3] > 0.8
    assert min(recall[4], recall[6], recall[10], recall[20]) >= 0.93, recall


def test_rows_without_an_id_are_not_gathered(spark):
    rnd = random.Random(6)
    common = "\n".join(f"common line {i}" for i in range(6))
    texts = [f"{common}\nown {rnd.random()}\nmore {rnd.random()}" for _ in range(4000)]

    def seconds(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        began = time.time()
        removed = sum(r.n_removed_lines for r in dedup_lines(df, digests=True).collect())
        return time.time() - began, removed

    seconds([(i, t) for i, t in enumerate(texts[:100])])
    with_ids, gone = seconds(list(enumerate(texts)))
    without, none = seconds([(None, t) for t in texts])
    assert gone >= 6 * 3999 * 0.9 and none == 0  # they share the largest id, so none of them is later
    assert without < 3 * with_ids + 5
