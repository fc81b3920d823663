"""Column functions on names, captions and licences (group H; B3-B7, B11-B14, L10).

Every function is an expression on the row. Vocabularies are parameters; none is
built in. Patterns use ASCII classes, as identifiers do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import col


def words_of(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _is_in(values: Sequence[str]):
    return lambda x: x.isin(*values) if values else F.lit(False)


def identifier_tokens(name: Column | str) -> Column:
    """H1: lower-case parts between ``_ - .`` and white space."""
    return F.filter(F.split(F.lower(col(name)), r"[_\-.\s]+"), lambda x: x != "")


def without_repeats(tokens: Column) -> Column:
    """Drops a token that equals the one before it."""
    return F.filter(tokens, lambda x, i: (i == 0) | (x != F.get(tokens, i - 1)))


def concept_tokens(name: Column | str, drop: Sequence[str]) -> Column:
    """H2: identifier tokens without dropped words and numbers; a word that then repeats the one before it goes."""
    kept = F.filter(identifier_tokens(name), lambda x: ~_is_in(drop)(x) & ~x.rlike("^[0-9]+$"))
    return F.transform(F.array(kept), lambda k: F.filter(k, lambda x, i: (i == 0) | (x != F.get(k, i - 1))))[0]


def label_tokens(name: Column | str, drop: Sequence[str], context: Sequence[Column | str]) -> Column:
    """H3: as H2, also without the tokens of context columns; all non-numeric tokens if nothing is left."""
    noise = F.flatten(F.array(*[F.coalesce(identifier_tokens(c), F.array().cast("array<string>")) for c in context])) if context else F.array().cast("array<string>")
    strict = F.filter(concept_tokens(name, drop), lambda x: ~F.array_contains(noise, x))
    plain = F.filter(identifier_tokens(name), lambda x: ~x.rlike("^[0-9]+$"))
    return F.when(F.size(strict) > 0, strict).otherwise(plain)


def prompt_views(tokens: Column, colors: Sequence[str], forms: Sequence[str]) -> Column:
    """H4: the concept, it with an article, and colour - material - form; distinct."""
    concept = F.array_join(tokens, " ")
    article = F.when(F.substring(concept, 1, 1).isin(*"aeiou"), "an ").otherwise("a ")
    color = F.slice(F.filter(tokens, _is_in(colors)), 1, 2)
    material = F.coalesce(F.get(F.filter(tokens, lambda x: ~_is_in(colors)(x)), 0), concept)
    form = F.get(F.filter(tokens, _is_in(forms)), 0)
    parts = F.array(F.nullif(F.array_join(color, " "), F.lit("")), F.when(~F.array_contains(color, material), material), F.when(form != material, form))
    structured = F.array_join(F.array_compact(parts), " ")
    views = F.array(concept, F.concat(article, concept), structured)
    return F.array_distinct(F.filter(views, lambda x: (x != "") & (concept != "")))


def type_word(kind: Column | str) -> Column:
    """H5."""
    return F.when(F.lower(F.coalesce(col(kind), F.lit(""))).startswith("item"), "item").otherwise("block")


def contains_word(text: Column | str, word: Column) -> Column:
    """H7: the word stands between word boundaries, perhaps with a plural s."""
    return F.regexp_like(F.lower(col(text)), F.concat(F.lit(r"\b\Q"), word, F.lit(r"\Es?\b")))


def label_valid(text: Column | str, tokens: Column, kind: Column) -> Column:
    """H6: all tokens and the type word occur."""
    return F.forall(F.concat(tokens, F.array(kind)), lambda t: contains_word(text, t))


def parse_name(name: Column | str, materials: Sequence[str], forms: Sequence[str], states: Sequence[str]) -> Column:
    """First material, first form, distinct states; a state word is never a material."""
    tokens = F.filter(F.split(col(name), r"[_\-\s]+"), lambda x: x != "")
    state = _is_in(states)
    form_only = [f for f in forms if f not in materials]
    material = F.filter(tokens, lambda x: _is_in(materials)(x) & ~state(x))
    # a later material word may still be the form if both lists name it
    both = F.slice(material, 2, F.greatest(F.size(material), F.lit(1)))
    form = F.get(F.filter(tokens, lambda x: (_is_in(form_only)(x) | (F.array_contains(both, x) & _is_in(forms)(x))) & ~state(x)), 0)
    return F.struct(F.get(material, 0).alias("material"), form.alias("form"), F.array_distinct(F.filter(tokens, state)).alias("state"), tokens.alias("tokens"))


def weak_prompt(parsed: Column, name: Column | str, suffix: str) -> Column:
    """H9: states, form, material; else the name; a suffix on what is there."""
    made = F.array_join(F.array_compact(F.array(F.nullif(F.array_join(parsed["state"], " "), F.lit("")), parsed["form"], F.replace(parsed["material"], F.lit("_"), F.lit(" ")))), " ")
    text = F.when(made != "", made).otherwise(F.replace(col(name), F.lit("_"), F.lit(" ")))
    return F.when(text != "", F.concat(text, F.lit(suffix))).otherwise("")


def camel_tokens(name: Column | str) -> Column:
    """camelCase and acronyms apart, then runs of letters or digits."""
    cut = F.regexp_replace(F.regexp_replace(col(name), "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z])([A-Z])", "$1 $2")
    return F.regexp_extract_all(F.lower(cut), F.lit("[a-z]+|[0-9]+"), F.lit(0))


def filename_words(name: Column | str, prefix: str = "item.") -> Column:
    """Words of a file name, case kept; prefix and extension go."""
    stem = F.regexp_replace(F.regexp_replace(col(name), r"\.png$", ""), "^" + prefix.replace(".", r"\."), "")
    cut = F.regexp_replace(stem, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(cut, r"[^A-Za-z0-9]+"), lambda x: x != "")


def drop_at(tokens: Column, at: Column, n: int = 1) -> Column:
    """Tokens without ``n`` of them from a zero-based position; unchanged if it is null or negative."""
    return F.when(at.isNull() | (at < 0), tokens).otherwise(F.filter(tokens, lambda x, i: (i < at) | (i >= at + n)))


def resource_policy(name: Column | str, paths: Column, flags: Mapping[str, Sequence[str]], path_flags: Mapping[str, Sequence[str]], namespaces: Sequence[str], forms: Sequence[str], prefix: str = "item") -> Column:
    """Tokens that remain of a resource name, the removed ones, reasons and decision.

    ``flags`` maps a reason to words any of which raises it, ``path_flags`` to
    path parts. A prefix word, namespaces, and ``frame``/``anim`` with its
    number are technical and removed; a code such as ``ab12`` is opaque.
    """
    stem = F.regexp_replace(F.element_at(F.split(F.replace(col(name), F.lit("\\"), F.lit("/")), "/"), -1), r"(?i)\.png$", "")
    tokens = camel_tokens(stem)
    body = F.filter(tokens, lambda x, i: ~((i == 0) & (x == prefix)) & ~_is_in(namespaces)(x))
    technical = lambda k: F.filter(
        k, lambda x, i: ~((x.isin("frame", "anim") & F.coalesce(F.get(k, i + 1).rlike("^[0-9]+$"), F.lit(False))) | (x.rlike("^[0-9]+$") & (i > 0) & F.coalesce(F.get(k, i - 1).isin("frame", "anim"), F.lit(False))))
    )
    kept = F.transform(F.array(body), technical)[0]
    reasons = [F.when(F.exists(tokens, _is_in(words)), reason) for reason, words in flags.items()]
    reasons += [F.when(F.exists(paths, _path_has(parts)), reason) for reason, parts in path_flags.items()]
    reasons.append(F.when(stem.rlike("^[a-zA-Z]{1,6}[0-9]+$") & ~F.exists(tokens, _is_in(forms)), "opaque_code_identifier"))
    reasons.append(F.when(stem.rlike("(?i)_(e|n|s)$"), "possible_auxiliary_map"))
    reasons.append(F.when(~F.exists(kept, lambda x: x.rlike("[a-z]")), "empty_semantic_name"))
    why = F.array_sort(F.array_distinct(F.array_compact(F.array(*reasons))))
    return F.struct(
        F.array_join(kept, " ").alias("candidate_text"),
        tokens.alias("original_tokens"),
        F.array_except(tokens, kept).alias("removed_tokens"),
        why.alias("reasons"),
        F.when(F.size(why) > 0, "quarantine").otherwise("keep").alias("decision"),
    )


def _path_has(parts: Sequence[str]):
    return lambda p: _any([F.contains(F.concat(F.lit("/"), F.lower(p)), F.lit(x)) for x in parts])


def _any(parts: Sequence[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def strip_boilerplate(text: Column | str, phrases: Sequence[str]) -> Column:
    """Phrases, separators, two leading articles and a trailing function word go."""
    out = F.coalesce(col(text), F.lit(""))
    for p in phrases:
        out = F.regexp_replace(out, r"(?i)\Q" + p + r"\E", " ")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, "[,;|/]+", " "), r"\s+", " "))
    for _ in range(2):
        out = F.regexp_replace(out, r"(?i)^(a|an|the|of)\s+", "")
    out = F.regexp_replace(out, r"(?i)\s+(a|an|the|of|and|with|or|in|on)$", "")
    return F.regexp_replace(F.regexp_replace(out, r"[ .,;:\-]+$", ""), r"^[ .,;:\-]+", "")


def remove_word(text: Column | str, word: str) -> Column:
    """A whole word goes, white space and points close up."""
    out = F.regexp_replace(col(text), rf"(?i)\b{word}\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"\s+([,.;])", "$1"))


def normalize(text: Column | str) -> Column:
    """Lower-case letters and digits, one blank between runs."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9]+", " "))


def token_set(text: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(normalize(text), " "), lambda x: x != "")))


def keyword_categories(text: Column | str, rules: Mapping[str, Sequence[str]], default: str = "other") -> Column:
    """All categories whose keywords occur in the padded text, in the rules' order; the first is primary."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(col(text), F.lit(""))), F.lit(" "))
    hits = F.array_compact(F.array(*[F.when(_any([F.contains(padded, F.lit(w)) for w in words]), name) for name, words in rules.items()]))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))


def noun_category(text: Column | str, nouns: Mapping[str, str], exclude: Mapping[str, str] | None = None) -> Column:
    """The category of the first listed noun that occurs, unless its exclusion pattern does."""
    low, out = F.lower(col(text)), None
    for noun, category in nouns.items():
        hit = low.rlike(rf"\b{noun}s?\b")
        if exclude and noun in exclude:
            hit = hit & ~low.rlike(exclude[noun])
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out


def last_noun(text: Column | str, nouns: Sequence[str], alias: Mapping[str, str] | None = None) -> Column:
    """The last listed noun of a text, by its alias if it has one."""
    words = F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z]+"), F.lit(0))
    found = F.get(F.filter(F.reverse(words), _is_in(nouns)), 0)
    for a, b in (alias or {}).items():
        found = F.when(found == a, b).otherwise(found)
    return found


def assemble_caption(name: Column | str, description: Column | str, prefix: str, markers: Sequence[str]) -> Column:
    """Distinct captions: the name; the description without prefix and from a marker on, led by the name unless it holds it."""
    n = F.trim(F.regexp_replace(col(name), r"\s+", " "))
    d = F.trim(F.regexp_replace(F.coalesce(col(description), F.lit("")), r"\s+", " "))
    d = F.regexp_replace(d, rf"(?i)^{prefix}\s*", "")
    d = F.regexp_replace(F.trim(F.regexp_replace(d, rf"(?is)\b({'|'.join(markers)})\b.*$", "")), r"[ .]+$", "")
    long = F.when(F.contains(F.lower(d), F.lower(n)), d).otherwise(F.concat(n, F.lit(". "), d))
    long = F.regexp_replace(F.regexp_replace(long, r"[ .]+$", ""), r"^[ .]+", "")
    return F.array_distinct(F.filter(F.array(n, long), lambda x: x != ""))


def style_prefix(style: str, text: Column | str) -> Column:
    """An empty text stays empty."""
    return F.when(F.trim(F.coalesce(col(text), F.lit(""))) == "", "").otherwise(F.concat(F.lit(f"{style}: "), col(text)))


def without_prefix(text: Column | str, prefix: str) -> Column:
    """H23."""
    return F.regexp_replace(col(text), r"^\Q" + prefix + r"\E", "")


def split_from_name(path: Column | str) -> Column:
    """``validation`` is looked for before ``val`` and ``test``; train otherwise."""
    low = F.lower(col(path))
    return F.when(F.contains(low, F.lit("validation")) | low.rlike(r"(^|[^a-z])val([^a-z]|$)"), "val").when(F.contains(low, F.lit("test")), "test").otherwise("train")


def grid_hint(name: Column | str) -> Column:
    """The size of a square grid named twice, as in ``16x16``; null without one."""
    found = F.regexp_extract(col(name), r"(?:^|[^0-9])([0-9]{1,4})x\1(?:[^0-9]|$)", 1)
    return F.nullif(found, F.lit("")).cast("int")


def word_ngrams(tokens: Column, n: int) -> Column:
    """N consecutive tokens joined by a blank."""
    return F.when(F.size(tokens) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " ")))


def char_ngrams(text: Column | str, n: int) -> Column:
    size = F.char_length(col(text))
    return F.when(size < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(col(text), i, F.lit(n))))


def caption_flags(text: Column | str, low: int, high: int, doubt: Sequence[str]) -> Column:
    """What is wrong with a caption's length, separators or certainty; sorted."""
    value = F.trim(F.coalesce(col(text), F.lit("")))
    n = F.size(F.filter(F.split(value, r"\s+"), lambda x: x != ""))
    flags = [
        F.when(n < low, "too_short"),
        F.when(n > high, "too_long"),
        F.when(F.contains(value, F.lit("_")), "identifier_separators"),
        F.when(F.lower(value).rlike(r"\b(" + "|".join(doubt) + r")\b"), "uncertain"),
    ]
    return F.array_sort(F.array_compact(F.array(*flags)))


def bullet_lines(fields: Mapping[str, Column]) -> Column:
    """A line for each field that has a value, in order."""
    lines = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"- {k}: "), v.cast("string"))) for k, v in fields.items()]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def vocabulary_pairs(tokens: Column, first: Sequence[str], second: Sequence[str]) -> Column:
    """All pairs of a first and a second word that occur in one name."""
    a, b = F.array_distinct(F.filter(tokens, _is_in(first))), F.array_distinct(F.filter(tokens, _is_in(second)))
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x.alias("first"), y.alias("second")))))


# licences, predicates


def classify_license(license_id: Column | str, extra: Column | str, allow: Sequence[str], review: Sequence[str], deny: Sequence[str], deny_extra: Sequence[str]) -> Column:
    """Allowed, then to be reviewed by name; denied by substring of the name, then of name and notes; else reviewed."""
    name = F.replace(F.trim(F.lower(F.coalesce(col(license_id), F.lit("")))), F.lit(" "), F.lit("-"))
    blob = F.lower(F.concat(name, F.lit(" "), F.coalesce(col(extra), F.lit(""))))
    return (
        F.when(name.isin(*allow), "allow").when(name.isin(*review), "review").when(_any([F.contains(name, F.lit(x)) for x in deny]) | _any([F.contains(blob, F.lit(x)) for x in deny_extra]), "deny").otherwise("review")
    )


def license_group(license_id: Column | str, exact: Mapping[str, Sequence[str]], prefixes: Mapping[str, Sequence[str]]) -> Column:
    """The group that lists the licence, then the one whose prefix it has; ``unknown`` if empty, else ``other``."""
    name, out = F.coalesce(col(license_id), F.lit("")), None
    for group, names in exact.items():
        out = F.when(name.isin(*names), group) if out is None else out.when(name.isin(*names), group)
    for group, starts in prefixes.items():
        out = out.when(_any([name.startswith(s) for s in starts]), group)
    return out.when(name == "", "unknown").otherwise("other")


def first_nonempty(*values: Column | str, default: str | None = None) -> Column:
    """The first value that is not blank, trimmed."""
    parts = [F.nullif(F.trim(col(v).cast("string")), F.lit("")) for v in values]
    return F.coalesce(*parts, *([F.lit(default)] if default is not None else []))


def tri_state_tileable(annotation: Column, kind: Column | str, name: Column | str, deny: Sequence[str], allow: Sequence[str]) -> Column:
    """Annotation, then items never, then deny words before allow words; null if nothing speaks."""
    low = F.lower(col(name))
    said = F.when(F.lower(annotation).isin("true", "yes"), True).when(F.lower(annotation).isin("false", "no"), False)
    return F.coalesce(said, F.when(type_word(kind) == "item", False).when(_any([F.contains(low, F.lit(w)) for w in deny]), False).when(_any([F.contains(low, F.lit(w)) for w in allow]), True))


def display_readable(text: Column | str, low: int, high: int, banned: Sequence[str], attributes: Sequence[str], nouns: Sequence[str]) -> Column:
    """Letters and blanks only, a length window, no banned word, an attribute, and a known noun at the end."""
    words = F.split(F.lower(col(text)), " ")
    return (
        col(text).rlike("^[A-Za-z]+( [A-Za-z]+)*$")
        & F.size(words).between(low, high)
        & ~F.exists(words, _is_in(banned))
        & F.exists(words, _is_in(attributes))
        & F.element_at(words, -1).isin(*nouns)
    )
