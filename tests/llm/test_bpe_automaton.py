import hashlib
import random

import public_tokenizers
from sievework.llm import bpe_automaton as B
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def unicode_texts(n):
    rnd = random.Random(77)
    pools = ["abcdefghij the and 'll 's", "ÀÉîßøñ àüö", "中文字符テスト한국어", "АБВгде жз", "😀👍🏽é́ﬁ", "0123456789²½Ⅷ", " \t\n\r\x0b\x0c\x85  ", "<|startoftext|>", "<|endoftext|>", "#*&!?.,;:_-\xad​́"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randrange(1, 12)):
            pool = rnd.choice(pools)
            if pool.startswith("<|"):
                parts.append(pool)
            elif rnd.random() < 0.05:
                parts.append(chr(rnd.choice([rnd.randrange(1, 0xD800), rnd.randrange(0xE000, 0x110000)])))
            else:
                parts.append("".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 14))))
        out.append("".join(parts))
    return out


def want(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False)


def test_equals_the_library_on_unicode(spark):
    texts = [None, "", " ", "\n\n", *unicode_texts(3000), "word " * 40_000, "x" * 200_000, "thé" * 70_000]
    rows = [(i, t, "a", 1, "b") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[7], (None, "null id", "a", 1, "b")], "doc_id long, text string, ids string, n_tokens int, decoded string").repartition(5)
    got = B.bpe_encode_decode(df, PATH).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        text = "null id" if r.doc_id is None else texts[r.doc_id]
        assert (r.n_tokens, r.ids, r.decoded) == want(text), repr(text)[:200]
    for r in B.bpe_encode_decode(df.limit(300), PATH, digests=True).collect():
        n, ids, decoded = want("null id" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (n, *(hashlib.sha256(x.encode()).hexdigest() for x in (ids, decoded)))
    assert B.bpe_encode_decode(df.limit(0), PATH).count() == 0


def coder_of(most):
    words = B.WordCoder(PATH)
    words.table = B.SymbolTable(words.automaton, most)
    return words


def test_table_bound_does_not_change_results():
    texts = [t.encode() for t in unicode_texts(300)] + [b"internationalization " * 3, b"zzzzzzzzzzzzzzzzzz", b"antidisestablishmentarianism"]
    whole, small = coder_of(100_000), coder_of(20)
    for t in texts:
        assert whole.text(t) == small.text(t)
    assert len(small.table.states) <= 20 + 1


def test_one_successor_for_each_state_and_symbol():
    table = coder_of(100_000).table
    rnd = random.Random(3)
    pieces = [bytes(rnd.choice(b"abehinorst") for _ in range(rnd.randrange(1, 20))) for _ in range(800)]
    first = [table.encode(p) for p in pieces]
    for key, found in table.next.items():
        state, ids = table.transition(table.states[key >> 9], key & 255, bool(key >> 8 & 1))
        assert ids == table.settled.get(key, ())
        assert state is None or table.number[state] == found >> 1
    assert first == [table.encode(p) for p in pieces]


def test_automaton_accepts_only_what_merges_give():
    """Every split of short words into tokens: the library's is the only path with all its arcs."""
    a = coder_of(10).automaton
    for word in ("there", "thinking", "aaaa", "nothing", "international"):
        paths = []

        def walk(at, state, path):
            for end in range(at + 1, len(word) + 1):
                token = a.at.get(word[at:end] + (B.END if end == len(word) else ""))
                if token is not None and (state < 0 or a.arc(state, token)):
                    if end == len(word):
                        paths.append([a.ids[t] for t in (*path, token)])
                    else:
                        walk(end, token, (*path, token))

        walk(0, -1, ())
        assert paths == [LIBRARY.encode(word, add_special_tokens=False).ids]
