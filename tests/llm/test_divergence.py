import collections
import random
import re

from sievework.llm.divergence import COMMON_WORDS, divergence_rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    count = collections.Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def prose(rnd, n):
    spec = COMMON_WORDS["en"].split()
    words, weights = spec[::2], [int(x) for x in spec[1::2]]
    made = lambda: "".join(rnd.choice("etaoinshrdlucmfwypvbgk") for _ in range(rnd.randrange(3, 9)))
    out = [rnd.choices([*words, ""], [*weights, 1000 - sum(weights)])[0] or made() for _ in range(n)]
    return " ".join(w.capitalize() + "," if i % 15 == 0 else w for i, w in enumerate(out)) + "."


def test_counts_and_verdicts(spark):
    rnd = random.Random(5)
    texts = [None, "", " \n\t", "a", "one two", "a b c a b c", "a a a a", "é\x0bü\x0cñ\x0dß", "x\n\nx\n x\nx", "## | <b>&"]
    texts += [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(60))) for _ in range(40)]
    texts += ["\n".join(rnd.choice(["", " ", "aa b", "aa  b"]) for _ in range(12)) for _ in range(10)]
    clean = prose(rnd, 400)
    junk = [" | ".join("".join(rnd.choice("etaoinshr") for _ in range(9)) for _ in range(200)), re.sub(" ", "### ", clean), clean.upper().replace(" ", "!! ")]
    long = prose(rnd, 20_000)
    rows = [(i, t, "en", 1) for i, t in enumerate([*texts, clean, *junk, long])] + [(999, clean, None, 1), (None, clean, "xx", 1), (999, clean, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    got = divergence_rules(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        r = by_id[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    at = len(texts)
    assert by_id[at].kept and by_id[999].kept and by_id[None].kept and by_id[len(texts) + 4].kept
    assert not any(by_id[at + k].kept for k in (1, 2, 3))
    assert divergence_rules(df.limit(0)).count() == 0


def test_native(spark):
    plan = divergence_rules(spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert "Exchange" not in plan


def test_a_filter_on_the_verdict_stays_above_the_expressions(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(i, prose(rnd, 3000), "en") for i in range(4)], "doc_id long, text string, lang string").repartition(2)
    kept = divergence_rules(df, carry=["text"]).filter("kept").select("rest.text")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert not any("xxhash64" in line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter"))
    assert kept.count() == 4
