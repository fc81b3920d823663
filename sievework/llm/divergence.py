"""Quality rules: divergence of a document's histograms from references of its language.

Two histograms are taken of each text: of eight character classes and of the
language's most common words (each word a bin, all others together one). The
Jensen-Shannon distance (base 2, 0 to 1) of each to the language's reference
must not exceed a limit. A limit is ``base + slack / sqrt(size)``: short texts
stray from any reference by chance, and below a least size a histogram does not
speak at all. A language without a reference is held against all of them, and
the nearest counts.

Everything is an expression on the row: one scan, no shuffle, no Python. The
repeated three-word windows are found by sorting hashes packed with their
positions, a primitive sort, instead of comparing windows with each other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK

# Common words per thousand words of running text.
COMMON_WORDS = {
    "en": "the 60 of 30 and 28 to 26 a 22 in 20 is 11 that 11 it 10 for 10 was 9 on 8 with 7 as 7 be 7 by 6 this 5 are 5 at 5 from 5",
    "de": "der 33 die 33 und 28 in 18 den 12 von 11 zu 11 das 11 mit 9 sich 8 des 8 auf 8 ist 8 im 8 ein 8 für 7 dem 7 nicht 7 eine 7 als 6",
    "fr": "de 50 la 30 le 25 et 24 les 20 des 18 en 16 un 14 du 13 une 12 que 11 est 11 pour 8 qui 8 dans 8 a 8 par 7 au 7 sur 6 plus 5",
    "es": "de 60 la 38 que 30 el 28 en 27 y 26 a 20 los 17 se 14 del 13 las 11 un 11 por 10 con 9 no 9 una 9 para 7 es 7 su 7 al 6",
}
# Shares of vowels and consonants a-z, capitals, other letters, digits, punctuation, symbols, white space.
CHARACTER_CLASSES = {
    "en": (0.310, 0.465, 0.025, 0.000, 0.005, 0.030, 0.001, 0.164),
    "de": (0.280, 0.470, 0.055, 0.015, 0.005, 0.030, 0.001, 0.144),
    "fr": (0.335, 0.400, 0.025, 0.035, 0.005, 0.035, 0.001, 0.164),
    "es": (0.360, 0.400, 0.025, 0.020, 0.005, 0.030, 0.001, 0.159),
}
SYMBOLS = r"[#*$%&|<>]"
BLANKS = " \t\n\x0b\f\r"
_POSITION_BITS = 21
_MASK = (1 << _POSITION_BITS) - 1
_CODES = [chr(c) for c in range(0x21, 0x7F)]


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    char_base: float = 0.165
    char_slack: float = 1.2
    min_chars: int = 150
    word_base: float = 0.24
    word_slack: float = 1.1
    min_judged_words: int = 60
    common_words: dict = field(default_factory=lambda: COMMON_WORDS)
    character_classes: dict = field(default_factory=lambda: CHARACTER_CLASSES)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _hash(word: str) -> int:
    h = xxhash.xxh64(word.encode(), 42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def _shares(spec: str) -> dict[str, float]:
    parts = spec.split()
    return {w: int(n) / 1000 for w, n in zip(parts[::2], parts[1::2], strict=True)}


def _js_distance(counts: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of ``counts / total`` to the reference, which sums to 1."""

    def term(count, q):
        def halves(p):
            mid = (p + q) / 2
            mine = F.when(p > 0, p * F.log2(p / mid)).otherwise(F.lit(0.0))
            other = F.when(q > 0, q * F.log2(q / mid)).otherwise(F.lit(0.0))
            return (mine + other) / 2

        return _let(count / total, halves)

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(counts, reference, term), F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def _repeat_words(hashes: Column) -> Column:
    """Words covered by three-word windows that occur twice or more."""

    def windows(h):
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))

    def covered(positions):
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            F.sort_array(positions), start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"]
        )

    def prefix(x):
        return F.shiftright(x, _POSITION_BITS)

    def packed(t):
        return F.sort_array(F.transform(t, lambda x, i: x.bitwiseAND(F.lit(~_MASK)).bitwiseOR(i.cast("long"))))

    def position(x):
        return x.bitwiseAND(F.lit(_MASK)).cast("int")

    def neighbours(p, i, key):
        return (key(F.get(p, i)) == key(F.get(p, i - 1))) | (key(F.get(p, i)) == key(F.get(p, i + 1)))

    def from_packed(p):
        return F.transform(F.filter(p, lambda x, i: F.coalesce(prefix(x) == prefix(F.get(p, i - 1)), F.lit(False)) | F.coalesce(prefix(x) == prefix(F.get(p, i + 1)), F.lit(False))), position)

    def clash(t, p):  # equal prefixes of different hashes
        return F.exists(
            F.transform(p, lambda x, i: F.coalesce((prefix(x) == prefix(F.get(p, i - 1))) & (F.get(t, position(x)) != F.get(t, position(F.get(p, i - 1)))), F.lit(False))),
            lambda x: x,
        )

    def full(t):
        pairs = F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(
            pairs,
            lambda p: F.transform(
                F.filter(p, lambda x, i: F.coalesce(x["h"] == F.get(p, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(p, i + 1)["h"], F.lit(False))),
                lambda x: x["i"],
            ),
        )

    def repeated(t):
        return F.when(F.size(t) > _MASK, full(t)).otherwise(_let(packed(t), lambda p: F.when(clash(t, p), full(t)).otherwise(from_packed(p))))

    return _let(_let(hashes, windows), lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(covered(repeated(t)))).cast("long")


def divergence_rules(docs: DataFrame, rules: Rules | None = None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """Counts, distances and verdict for each row.

    Null texts read as empty: no words, ``base_failed``. A null or unknown
    language takes the nearest reference. Repeated rows get the same verdict;
    no other column is read, but ``carry`` columns come back in a struct ``rest``.
    """
    rules = rules or Rules()
    langs = sorted(rules.common_words)
    shares = {k: _shares(v) for k, v in rules.common_words.items()}
    vocabulary = sorted({w for s in shares.values() for w in s})
    if len(vocabulary) > len(_CODES):
        raise ValueError(f"at most {len(_CODES)} common words in all")
    code = dict(zip(vocabulary, _CODES, strict=False))
    by_hash = {_hash(form + end): code[w] for w in vocabulary for form in {w, w.capitalize()} for end in ("", ",", ".")}
    if len(by_hash) < 3 * len(vocabulary):
        raise ValueError("hashes of common words clash")
    table = next(m for m in range(len(by_hash), 1 << 20) if len({h % m for h in by_hash}) == len(by_hash))
    codes = [""] * table
    for h, c in by_hash.items():
        codes[h % table] = c
    slots = F.split(F.lit(" ".join(codes)), " ")  # folded to one literal array; no code is a blank

    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"), docs[lang_col].cast("string").alias("_lang"),
        *([F.struct(*[docs[c] for c in carry]).alias("rest")] if carry else []),
    )
    rest = ["rest"] if carry else []
    trimmed = F.btrim("_text", F.lit(BLANKS))
    rows = rows.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK)))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    no_vowels = F.regexp_replace("_text", "[aeiou]+", "")
    rows = rows.select(
        "doc_id",
        "_lang",
        *rest,
        F.size("_words").cast("long").alias("n_words"),
        F.transform("_words", lambda x: F.xxhash64(x)).alias("_hashes"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.char_length("_text").cast("long").alias("_chars"),
        no_vowels.alias("_rest1"),
    )
    rows = rows.withColumns({"_rest2": F.regexp_replace("_rest1", "[b-df-hj-np-tv-z]+", ""), "_n1": F.char_length("_rest1")})
    rows = rows.withColumns({"_rest3": F.regexp_replace("_rest2", WORD_BREAK, ""), "_n2": F.char_length("_rest2")}).drop("_rest1")
    rows = rows.withColumns({"_n3": F.char_length("_rest3"), "_upper": F.char_length(F.regexp_replace("_rest3", r"\P{Lu}+", ""))}).drop("_rest2")
    rows = rows.withColumns(
        {
            "_letters": F.char_length(F.regexp_replace("_rest3", r"\P{L}+", "")) - F.col("_upper"),
            "_digits": F.char_length(F.regexp_replace("_rest3", r"[^0-9]+", "")),
            "_points": F.char_length(F.regexp_replace("_rest3", r"[^.,;:!?'\"()\-]+", "")),
            "n_symbols": F.char_length(F.regexp_replace("_rest3", r"[^#*$%&|<>]+", "")).cast("long"),
            "_coded": F.array_join(
                F.transform(F.filter("_hashes", lambda x: x.isin(*by_hash)), lambda x: F.get(slots, F.pmod(x, F.lit(table)).cast("int"))), ""
            ),
            "n_repeat_words": _repeat_words(F.col("_hashes")),
            "word_chars": (F.col("_chars") - (F.col("_n2") - F.col("_n3"))).cast("long"),
        }
    ).drop("_rest3", "_hashes")
    total = F.greatest(F.col("_chars"), F.lit(1)).cast("double")
    classes = [
        F.col("_chars") - F.col("_n1"),
        F.col("_n1") - F.col("_n2"),
        F.col("_upper"),
        F.col("_letters"),
        F.col("_digits"),
        F.col("_points"),
        F.col("_n3") - F.col("_upper") - F.col("_letters") - F.col("_digits") - F.col("_points"),
        F.col("_n2") - F.col("_n3"),
    ]

    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")

    def doubles(values) -> Column:
        values = list(values)
        return F.array(*[F.lit(x / math.fsum(values)) for x in values])

    # One array of references, so that the plan's code stays small however many languages there are.
    references = F.array(
        *[
            F.struct(
                F.lit(k).alias("lang"),
                doubles(rules.character_classes[k]).alias("classes"),
                F.array(*[F.lit(code[w]) for w in shares[k]]).alias("codes"),
                doubles([*shares[k].values(), 1 - math.fsum(shares[k].values())]).alias("words"),
            )
            for k in langs
        ]
    )
    known = F.col("_lang").isin(*langs)
    used = F.filter(references, lambda r: ~F.coalesce(known, F.lit(False)) | (r["lang"] == F.col("_lang")))
    classes = F.array(*[c.cast("double") for c in classes])

    def word_distance(r):
        own = F.transform(r["codes"], lambda c: (F.char_length("_coded") - F.char_length(F.replace(F.col("_coded"), c, F.lit("")))).cast("double"))
        return _let(own, lambda o: _js_distance(F.concat(o, F.array(F.col("n_words") - F.aggregate(o, F.lit(0.0), lambda a, x: a + x))), words, r["words"]))

    rows = rows.withColumns(
        {
            "char_distance": F.array_min(F.transform(used, lambda r: _js_distance(classes, total, r["classes"]))),
            "word_distance": F.array_min(F.transform(used, word_distance)),
            # A filter on the verdict must not be pushed below this projection: its expressions would be copied into the filter.
            "_barrier": F.monotonically_increasing_id(),
        }
    )
    base_failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    char_odd = (F.col("word_chars") >= rules.min_chars) & (F.col("char_distance") > rules.char_base + rules.char_slack / F.sqrt(total))
    word_odd = (F.col("n_words") >= rules.min_judged_words) & (F.col("word_distance") > rules.word_base + rules.word_slack / F.sqrt(words))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & ~char_odd & ~word_odd & (F.col("_barrier") >= 0)).alias("kept"), "char_distance", "word_distance", *rest,
    )
