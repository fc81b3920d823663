"""Decisions from evidence: JSON fields, flags, captions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import col
from .text import filename_words


def exact_keys(js: Column | str, keys: Sequence[str]) -> Column:
    """The object has just these keys; null or no object has not."""
    return F.coalesce(F.array_sort(F.json_object_keys(col(js))) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))


def coerce(raw: Column | str, strings: Sequence[str], lists: Sequence[str], flags: Sequence[str] = (), numbers: Sequence[str] = ()) -> Column:
    """A JSON object as a fixed struct.

    Strings are trimmed, absent ones empty; a scalar becomes a list of one, blank
    items go; ``true``/``yes``/``1`` in any case are true; numbers default to 0.
    """
    get = lambda k: F.get_json_object(col(raw), f"$.{k}")
    text = [F.trim(F.coalesce(get(k), F.lit(""))).alias(k) for k in strings]

    def as_list(k):
        value = get(k)
        many = F.from_json(value, T.ArrayType(T.StringType()))
        one = F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(value))
        items = F.when(F.trim(value).startswith("["), F.coalesce(many, F.array().cast("array<string>"))).otherwise(one)
        return F.filter(F.transform(items, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "").alias(k)

    yes = [F.coalesce(F.lower(F.trim(get(k))).isin("true", "yes", "1"), F.lit(False)).alias(k) for k in flags]
    real = [F.coalesce(F.expr("1.0d") * get(k).try_cast("double"), F.lit(0.0)).alias(k) for k in numbers]
    return F.struct(*text, *[as_list(k) for k in lists], *yes, *real)


def semantic_merge(file_name: Column | str, proposed: Column | str, relation: Column | str, visual: Column | str, flags: Column) -> Column:
    """The proposed name stands only if it keeps all words of the file name; flags suppress the views."""
    source = F.filter(filename_words(file_name), lambda w: ~w.rlike("^[0-9]+$"))
    has = F.transform(filename_words(proposed), lambda w: F.lower(w))
    missing = F.filter(source, lambda w: ~F.array_contains(has, F.lower(w)))
    name = F.when(F.size(missing) > 0, F.array_join(filename_words(file_name), " ")).otherwise(F.trim(F.regexp_replace(col(proposed), r"\s+", " ")))
    why = F.array_compact(F.concat(flags, F.array(F.when(col(relation) != "compatible", F.concat(F.lit("name_"), col(relation))), F.when(F.size(missing) > 0, "name_information_loss"))))
    both = F.concat(name, F.lit(". "), col(visual))
    return F.struct(
        name.alias("effective_name"), missing.alias("missing"), both.alias("combined"), why.alias("flags"),
        F.when(F.size(why) == 0, F.array(name, col(visual), both)).otherwise(F.array().cast("array<string>")).alias("views"),
        F.when(F.size(why) == 0, "candidate").otherwise("quarantine").alias("status"),
    )


def evidence_decision(checks: Mapping[str, Column], name: Column, name_ok: Column, caption: Column, name_flag: str = "filename_identity_unverified") -> Column:
    """Structural flags quarantine both labels; a doubtful name suppresses only itself.

    A pure function of stored evidence, so a new policy needs no new evidence.
    """
    structural = F.array_compact(F.array(*[F.when(c, k) for k, c in checks.items()]))
    ok = F.size(structural) == 0
    file_label, visual_label = F.when(ok & name_ok, name), F.when(ok, caption)
    return F.struct(
        file_label.alias("file_label"),
        visual_label.alias("visual_label"),
        F.array_sort(F.array_distinct(F.concat(structural, F.when(~name_ok, F.array(F.lit(name_flag))).otherwise(F.array().cast("array<string>"))))).alias("flags"),
        F.when(ok, "eligible").otherwise("quarantine").alias("decision"),
        F.array_compact(F.array(file_label, visual_label)).alias("variants"),
    )


def caption_supervision(file_name: Column | str, text: Column | str, flags: Column, reject: Sequence[str], override: Column) -> Column:
    """Why a description is unusable, by priority: a reviewer's word, flags, nothing there, separators; the name always serves."""
    short = F.array_join(filename_words(file_name), " ")
    bad = F.array_sort(F.array_intersect(F.coalesce(flags, F.array().cast("array<string>")), F.array(*map(F.lit, reject))))
    value = F.trim(F.coalesce(col(text), F.lit("")))
    reason = F.coalesce(
        F.nullif(override, F.lit("")),
        F.when(F.size(bad) > 0, F.concat(F.lit("annotation_flags:"), F.array_join(bad, ","))),
        F.when(value == "", "missing_descriptive_text"),
        F.when(F.contains(value, F.lit("_")), "identifier_separators_in_description"),
    )
    long = F.when(reason.isNull(), value)
    return F.struct(short.alias("filename_text"), long.alias("descriptive_text"), reason.alias("rejection"), F.when(long.isNotNull() & (long != short), F.array(F.lit("short"), F.lit("long"))).otherwise(F.array(F.lit("short"))).alias("variants"))


def style_views(raw: Column | str, styles: Sequence[str]) -> Column:
    """The views of a JSON object in the styles' order, each text once; missing ones filled with the first."""
    text = [F.lower(F.trim(F.regexp_replace(F.coalesce(F.get_json_object(col(raw), f"$.{s}"), F.lit("")), r"\s+", " "))) for s in styles]
    texts = F.array(*text)
    unique = F.transform(F.array(texts), lambda a: F.transform(a, lambda x, i: F.when((x != "") & (F.array_position(a, x) == i + 1), x)))[0]
    first = F.get(F.array_compact(unique), 0)
    return F.transform(F.arrays_zip(F.array(*map(F.lit, styles)).alias("style"), unique.alias("text")), lambda v: F.struct(v["style"].alias("style"), F.coalesce(v["text"], first).alias("text")))


def unpivot_variants(key: Column | str, variants: Column) -> Column:
    """Explode to one struct per caption variant, with the key and its number as id."""
    return F.explode(F.transform(variants, lambda x, i: F.struct(F.concat(col(key).cast("string"), F.lit("#"), i.cast("string")).alias("id"), x.alias("text"))))


def from_pipes(text: Column | str) -> Column:
    """A pipe-separated list; blanks go."""
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def properties(text: Column | str) -> Column:
    """``key=value`` lines as a map; other lines are left aside, the last of equal keys wins."""
    lines = F.filter(F.split(F.coalesce(col(text), F.lit("")), "\n"), lambda x: F.contains(x, F.lit("=")) & ~F.trim(x).startswith("#"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substring(x, F.locate("=", x) + 1, F.char_length(x))).alias("v")))
    last = F.transform(F.array(pairs), lambda p: F.filter(p, lambda e, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda o: o["k"] == e["k"])))[0]
    return F.map_from_entries(last)
