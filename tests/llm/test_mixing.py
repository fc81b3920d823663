import collections
import math
import random

from pyspark.sql import functions as F
from sievework.llm.mixing import copies_of, mix_sources, source_rates


def test_rates_and_copies(spark):
    rows = [(i, "x" * (5 + i % 7), "big" if i % 3 else None, i) for i in range(6000)] + [(9000 + i, "y" * 10, "small", 0) for i in range(300)] + [(9999, None, "empty", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").repartition(5)
    rates = {r.source_key: r.rate for r in source_rates(df).collect()}
    chars = collections.Counter()
    for _, t, s, _ in rows:
        chars[s] += len(t or "")
    root = sum(math.sqrt(c) for c in chars.values())
    for s, c in chars.items():
        assert math.isclose(rates[s], sum(chars.values()) * math.sqrt(c) / root / c if c else 1.0)
    out = mix_sources(df).collect()
    copies = collections.Counter(r.rest.doc_id for r in out)
    assert all(copies[r.rest.doc_id] == r.copies for r in out)
    for s in ("big", None, "small"):
        members = [i for i, _, x, _ in rows if x == s]
        mean = sum(copies[i] for i in members) / len(members)
        assert abs(mean - rates[s]) < 5 * math.sqrt(rates[s] / len(members))
        for k in range(3):  # a Poisson distribution, not only its mean
            p = math.exp(-rates[s]) * rates[s] ** k / math.factorial(k)
            share = sum(copies[i] == k for i in members) / len(members)
            assert abs(share - p) < 5 * math.sqrt(p * (1 - p) / len(members)) + 1e-9
    again = mix_sources(df.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_given_weights_and_edges(spark):
    df = spark.createDataFrame([(1, "aaaa", "a"), (2, "bb", "b"), (2, "bb", "b"), (None, "", "c"), (3, "q", "rest")], "doc_id long, text string, source string")
    rates = {r.source_key: r.rate for r in source_rates(df, {"a": 1, "b": 3, "gone": 5}).collect()}
    assert rates == {"a": 9 * 1 / 4 / 4, "b": 9 * 3 / 4 / 4, "c": 1.0, "rest": 0.0}
    many = mix_sources(df, {"b": 1.0, "a": 1e-9})
    assert {r.rest.doc_id for r in many.collect()} <= {1, 2, None}
    huge = spark.createDataFrame([(1, "z", "tiny"), (2, "z" * 5000, "large")], "doc_id long, text string, source string")
    copies = mix_sources(huge, {"tiny": 1.0}).filter("rest.doc_id = 1").count()
    assert abs(copies - 5001) < 500
    assert mix_sources(df.limit(0)).count() == 0


def test_any_column_name_null_ids_and_long_texts(spark):
    names = ["u", "copies", "copy", "rate", "steps", "rest", "digest", "batch", "source_key", "shuffle_key", "_u", "_copies", "_rate", "_steps", "_copy"]
    df = spark.createDataFrame([(None, f"text {i} " * (20_000 if i == 7 else 1), "s", *range(15)) for i in range(2000)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mix_sources(df)
    assert out.select("rest.*").columns == df.columns
    rows = out.collect()
    assert 1700 < len(rows) < 2300 and all(tuple(r.rest)[3:] == tuple(range(15)) for r in rows)
    assert len({r.shuffle_key for r in rows}) == len(rows)  # texts spread rows without an id
    spread = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert min(spread) > len(rows) / len(spread) / 2


def exact(rate, u):
    n, log, total = 0, -rate, math.exp(-rate)
    low = 0
    if rate > 700:
        low = math.floor(rate - 12 * math.sqrt(rate) - 30)
        log = low * math.log(rate) - rate - math.lgamma(low + 1)
        n, total = low, math.exp(log)
    while total <= u:
        n += 1
        log += math.log(rate) - math.log(n)
        total += math.exp(log)
    return n


def test_inversion_at_any_rate(spark):
    rnd = random.Random(3)
    cases = [(rate, rnd.random()) for rate in (0.01, 1.0, 64.0, 65.0, 300.0, 699.0, 701.0, 1e4, 1e6) for _ in range(20)]
    df = spark.createDataFrame(cases, "rate double, u double")
    start = F.expr("transform(sequence(0, 200), k -> 0D)")  # tables are tested with whole operators
    got = [r.n for r in df.filter("rate > 64").select(copies_of(F.col("rate"), start, F.col("u")).alias("n")).collect()]
    assert got == [exact(r, u) for r, u in cases if r > 64]
    huge = spark.createDataFrame([(i, "z", "tiny") for i in range(3)] + [(9, "z" * 3_000_000, "large")], "doc_id long, text string, source string")
    n = mix_sources(huge, {"tiny": 1.0}, shuffle=False).groupBy("rest.doc_id").count().collect()
    assert len(n) == 3 and all(abs(r["count"] - 1_000_001) < 6000 for r in n)
    assert source_rates(huge, {"tiny": 1.0}).filter("size(steps) > 200").count() == 0
