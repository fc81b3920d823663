import random

from sievework.operators import dedup
from sievework.plans import QUERIES


def brute(rows, threshold, bits=4):
    kept, out = [], {}
    for k, v, h in sorted(rows, key=lambda r: r[0]):
        for o, u, g in kept:
            if (h is None) == (g is None) and (((h ^ g) & (2**64 - 1)).bit_count() <= bits if h is not None else sum(abs(a - b) for a, b in zip(u, v, strict=True)) / len(v) <= threshold):
                out[k] = o
                break
        else:
            kept.append((k, v, h))
            out[k] = k
    return out


def test_whole_kept_set_by_hash_or_difference(spark):
    rnd = random.Random(3)
    rows = []
    for i in rnd.sample(range(1000), 160):
        h = None if i % 2 else rnd.choice([0, -1, 2**40]) ^ sum(1 << b for b in rnd.sample(range(63), rnd.randrange(5)))
        rows.append((i, [float(rnd.randrange(12)), float(rnd.randrange(12))], h))
    df = spark.createDataFrame(rows, "id long, v array<double>, h long").repartition(5)
    got = {r.key: r.kept_by for r in dedup.greedy_over_all(df, "id", "v", 1.0, "h", block=7).collect()}
    assert got == brute(rows, 1.0)
    assert dedup.greedy_over_all(df.limit(0), "id", "v", 1.0).count() == 0


def test_query_compares_across_labels(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(x) for x in r.embedding], None) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.key: r.kept_by for r in QUERIES["greedy_near_duplicates"](spark, sf).collect()}
    assert got == brute(rows, 0.9)


def test_by_hash_equals_the_loop(spark):
    rnd = random.Random(8)
    rows = []
    for i in rnd.sample(range(10_000), 400):
        code = rnd.choice([0, 0x5555555555555555, 2**63 - 1, rnd.getrandbits(63)])
        for b in rnd.sample(range(63), rnd.randrange(9)):
            code ^= 1 << b
        rows.append((i, [0.0], code))
    rows += [(20_000 + k, [0.0], rows[k][2]) for k in range(20)]
    df = spark.createDataFrame([(k, h, 1) for k, _, h in rows] + [(None, 3, 1), (5, None, 1)], "id long, code long, key int").repartition(5)
    got = {r.key: r.kept_by for r in dedup.greedy_by_hash(df, "id", "code").collect()}
    assert got == brute(rows, 0.0)
    assert len(set(got.values())) < len(got) and dedup.greedy_by_hash(df.limit(0), "id", "code").count() == 0
