"""JSON from model output: fences, braces, truncation.

These run in Arrow batches because they scan brackets with a stack, which no
built-in expression can. Callers first try ``from_json`` and hand over only the
rows it could not read.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed pattern: a fenced block, with or without the word json.
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)
_OUTERMOST = re.compile(r"\{.*\}", re.DOTALL)
#: JSON's tokens: a whole string, a number, a literal, a mark. A quote on its own opens a string that never ends.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|[][{}:,"]', re.DOTALL)
_CLOSES = {"{": "}", "[": "]"}


def _value_ends(body: str) -> list[tuple[int, tuple | None]]:
    """Where the text could end: after tokens that can end a value, with the brackets open there as a chain ``(closer, the rest)``."""
    ends, chain = [], None
    for token in _TOKEN.finditer(body):
        mark = token[0]
        if mark == '"':
            break
        if mark in _CLOSES:
            chain = (_CLOSES[mark], chain)
        elif mark in "}]":
            chain = chain and chain[1]
        if mark not in ",:":
            ends.append((token.end(), chain))
    return ends


def _loaded(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def repaired(text: str) -> dict | list | None:
    """The longest prefix from the first brace on that parses once its open brackets are closed."""
    body = text[text.find("{") :] if "{" in text else ""
    for end, chain in reversed(_value_ends(body)):
        closers = ""
        while chain:
            closers, chain = closers + chain[0], chain[1]
        if (found := _loaded(body[:end] + closers)) is not None:
            return found
    return None


def extracted(text: str | None) -> dict | None:
    """The object in a response: inside a fence if there is one, between the outermost braces, else repaired."""
    if text is None:
        return None
    fenced = _FENCE.search(text)
    body = fenced[1] if fenced else text
    whole = _OUTERMOST.search(body)
    found = _loaded(whole[0]) if whole else None
    return repaired(body) if found is None else found


def first_object(text: str | None) -> dict | None:
    """The first complete object; what follows it does not matter."""
    if text is None or (at := text.find("{")) < 0:
        return None
    try:
        found, _ = json.JSONDecoder().raw_decode(text[at:])
        return found
    except ValueError:
        return None


def _dumps(value) -> str | None:
    return None if value is None else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def extract_json(text: pd.Series) -> pd.Series:
    """J1, J2 as canonical JSON; null where nothing can be read."""
    return text.map(lambda t: _dumps(extracted(t)))


@F.pandas_udf(T.StringType())
def first_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _dumps(first_object(t)))


def read_json(column):
    """Canonical text of strict JSON objects from the JVM; only the rest goes through Python."""
    from .keys import col

    good = F.try_parse_json(col(column)).isNotNull() & F.trim(col(column)).startswith("{")
    return F.when(good, F.trim(col(column))).otherwise(extract_json(F.when(~F.coalesce(good, F.lit(False)), col(column))))
