import hashlib
import math
import random

import corpus_pipeline
import public_tokenizers
from sievework.llm import mixing
from tests.llm.test_divergence import prose
from tests.llm.test_line_chunks import brute as brute_lines
from tests.llm.test_near_copies import brute_representatives
from tokenizers import Tokenizer


def corpus():
    rnd = random.Random(12)
    shared = [prose(rnd, 14) for _ in range(6)]
    rows = []
    for i in range(60):
        lines = [prose(rnd, rnd.randrange(8, 30)) for _ in range(rnd.randrange(5, 9))]
        if rnd.random() < 0.4:
            lines[1:1] = shared
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}"))
    rows += [(100 + i, rows[i][1] + (" the" if i % 2 else ""), "en", "s0") for i in range(8)]
    rows += [(200, "too short", "en", "s1"), (201, " | ".join("etaoinshr" for _ in range(90)), "en", "s1"), (202, None, None, None)]
    return [(*r, len(r[1] or "")) for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/sf/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/sf/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, "").collect()
    assert {r.doc_id for r in kept} == {r[0] for r in rows if r[0] < 200}
    # lines
    out = corpus_pipeline.line_dedup(spark, spark.createDataFrame(kept, SCHEMA), "").collect()
    want = {r[0]: r[1] for r in brute_lines([(r.doc_id, r.text) for r in kept])}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in out} == want
    assert all(r.n_chars == len(r.text) for r in out) and sum(r.n_chars for r in out) < sum(r.n_chars for r in kept)
    # near copies
    ids = sorted(r.doc_id for r in out)
    text = {r.doc_id: r.text for r in out}
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(out, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in left) == brute_representatives([(i, text[i]) for i in ids])
    # mixing
    source = {r.doc_id: r.source for r in left}
    chars = {s: sum(len(text[i]) for i in source if source[i] == s) for s in set(source.values())}
    root = sum(math.sqrt(c) for c in chars.values())
    want = []
    for i in source:
        c = chars[source[i]]
        rate = sum(chars.values()) * math.sqrt(c) / (c * root) if c else 1.0
        digest = hashlib.md5(f"{mixing.SEED}:{i}:{hashlib.md5(text[i].encode()).hexdigest()}".encode()).hexdigest()
        u, n, mass, total = int(digest[:13], 16) / 2**52, 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            n += 1
            mass *= rate / n
            total += mass
        want += [i] * n
    # ids
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    final = corpus_pipeline.run(spark, f"{tmp_path}/sf").collect()
    assert sorted(r.doc_id for r in final) == sorted(want)
    for r in final:
        e = tok.encode(text[r.doc_id], add_special_tokens=False)
        assert r.n_tokens == len(e.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_columns_and_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/sf/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/sf/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
    assert corpus_pipeline.run(spark, f"{tmp_path}/sf").count() == 0


def test_rows_without_or_with_repeated_ids(spark, tmp_path):
    rnd = random.Random(9)
    texts = ["\n".join(prose(rnd, 20) for _ in range(6)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (3, texts[3]), (7, texts[4] + " " + "the of and " * 20_000), (8, None), (9, "")]
    data = [(i, t, "en", f"s{k % 2}" if k else None, len(t or "")) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/sf/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/sf/documents.parquet")
    left = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:30]) for r in left) == sorted([(0, texts[0][:30]), (0, texts[1][:30]), (5, texts[2][:30]), (3, texts[3][:30]), (7, texts[4][:30]), (8, "")])
    out = corpus_pipeline.run(spark, f"{tmp_path}/sf").collect()
    assert {r.doc_id for r in out} <= {None, 3, 5, 7}
