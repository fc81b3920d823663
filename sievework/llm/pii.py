"""Personal data: patterns propose spans, validators confirm them, nearby words adjust their scores.

Four base kinds are kept whatever their score: email, ip (parts up to 255),
card (14 to 19 digits that pass Luhn) and phone (10 to 15 digits). Three more
are kept from a score of ``THRESHOLD`` on: iban (mod-97), ssn (ranges that are
issued) and secret (keys and tokens: letters and digits mixed, of high entropy).
Words near a span, on either side and in four languages, raise its score where
they speak of such data and lower it where they speak of something else that
looks alike. Spans of one kind don't overlap and are found from left to right;
positions are code points, ends exclusive.

Every pattern runs in linear time on any text: an address is looked for around
each at-sign, and runs of digits or letters are entered at their start only.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, map_slices

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = 4
THRESHOLD = 0.5
BEFORE, AFTER = 48, 32  # characters on each side in which a word counts as nearby
SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.7, "ssn": 0.2, "secret": 0.3}
BOOST, DOUBT, KNOWN_PREFIX = 0.35, 0.3, 0.3


def _words(*words: str) -> re.Pattern:
    return re.compile(rf"(?i)(?<![^\W_])(?:{'|'.join(words)})(?![^\W\d_])")


#: Words that speak of each kind: English, German, French, Spanish.
NEARBY = {
    "email": _words("e-?mails?", "contact", "write to", "kontakt", "schreib(?:en|t)?", "courriel", "contacte[rz]", "correo", "contacto"),
    "ip": _words("ip", "hosts?", "server", "address", "adresse", "rechner", "serveur", "machine", "servidor", "direcci[oó]n"),
    "card": _words("cards?", "visa", "credit", "debit", "payment", "kreditkarte", "karte", "zahlung", "carte", "paiement", "tarjeta", "pago"),
    "phone": _words("phone", "tel", "call", "mobile", "fax", "telefon", "handy", "anruf", "t[ée]l[ée]phone", "appele[rz]", "portable", "tel[ée]fono", "m[óo]vil", "llam(?:ar|e)"),
    "iban": _words("iban", "account", "bank", "transfer", "konto", "[üu]berweisung", "compte", "virement", "banque", "cuenta", "banco", "transferencia"),
    "ssn": _words("ssn", "social security", "tax id", "sozialversicherung\\w*", "steuernummer", "s[ée]curit[ée] sociale", "seguridad social"),
    "secret": _words("tokens?", "secrets?", "(?:api|access|private)?[ _-]?keys?", "passwords?", "bearer", "passwort", "kennwort", "schl[üu]ssel", "mot de passe", "cl[ée]", "jeton", "contrase[ñn]a", "clave"),
}
#: Words that speak of numbers of another kind.
AGAINST = {
    "iban": _words("order", "serial", "part", "isbn", "bestellung", "bestellnummer", "seriennummer", "commande", "num[ée]ro de s[ée]rie", "pedido", "n[úu]mero de serie"),
    "ssn": _words("order", "serial", "part", "isbn", "bestellung", "bestellnummer", "seriennummer", "commande", "num[ée]ro de s[ée]rie", "pedido", "n[úu]mero de serie"),
    "secret": _words("sha-?[0-9]*", "md5", "commit", "checksum", "digest", "revision", "pr[üu]fsumme", "somme de contr[ôo]le", "suma de verificaci[óo]n"),
}
#: How published kinds of keys begin.
_PREFIX = re.compile(r"AKIA|ASIA|AIza|gh[pousr]_|xox[abpr]-|sk_live_|eyJ")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_DIGITS = re.compile(r"[^0-9]+")
LONGEST_SECRET = 4096

SPANS = "doc_id long, spans array<struct<kind: string, start: int, end: int, score: double>>"
DIGESTS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_iban long, n_ssn long, n_secret long"


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _ips(text: str):
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if len(m[0]) >= 14:
            digits = _DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text: str):
    for m in _IBAN.finditer(text):
        iban = m[0].replace(" ", "")
        if 15 <= len(iban) <= 34 and mod97(iban):
            yield m.span()


def _ssns(text: str):
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def entropy(text: str) -> float:
    """Bits per character, by the text's own frequencies."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def _secrets(text: str):
    for m in _SECRET.finditer(text):
        body = m[0].rstrip("=")
        if len(body) > LONGEST_SECRET or body.isalpha() or not any(c.isalpha() for c in body) or not any(c.isdigit() for c in body):
            continue
        if (len(body) >= 32 and entropy(body) >= 3.0) if _HEX.fullmatch(body) else entropy(body) >= 3.6:
            yield m.span()


_FINDERS = (_emails, _ips, _cards, _phones, _ibans, _ssns, _secrets)


def score(kind: str, text: str, start: int, end: int) -> float:
    around = text[max(0, start - BEFORE) : start] + "\n" + text[end : end + AFTER]
    found = SCORE[kind] + BOOST * bool(NEARBY[kind].search(around))
    if kind in AGAINST:
        found -= DOUBT * bool(AGAINST[kind].search(around))
    if kind == "secret" and _PREFIX.match(text, start):
        found += KNOWN_PREFIX
    return round(min(1.0, max(0.0, found)), 2)


def find_spans(text: str) -> list[Span]:
    """All kept spans by start, then kind, then end."""
    out = []
    for kind, find in enumerate(_FINDERS):
        for start, end in find(text):
            found = score(KINDS[kind], text, start, end)
            if kind < BASE or found >= THRESHOLD:
                out.append(Span(start, kind, end, found))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def find_pii(docs: DataFrame, *, digests: bool = False) -> DataFrame:
    """Spans of personal data in each whole text, one row per input row.

    Null and empty texts have no spans; repeated rows come back repeated; other
    columns are left aside. With ``digests`` the spans come as counts, as text,
    and the base ones as a SHA-256.
    """

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [find_spans(t or "") for t in part["text"].to_pylist()]
        if not digests:
            rows = [[{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "score": s.score} for s in x] for x in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            return pa.RecordBatch.from_arrays([part["doc_id"], pa.array(rows, kind)], names=["doc_id", "spans"])
        count = {name: pa.array([sum(s.kind == k for s in x) for x in found], pa.int64()) for k, name in enumerate(KINDS)}
        base = [hashlib.sha256(joined([s for s in x if s.kind < BASE]).encode()).hexdigest() for x in found]
        columns = {
            "doc_id": part["doc_id"],
            **{f"n_{k}": count[k] for k in KINDS[:BASE]},
            "base_sha256": pa.array(base, pa.string()),
            "spans": pa.array([joined(x) for x in found], pa.string()),
            **{f"n_{k}": count[k] for k in KINDS[BASE:]},
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return map_slices(id_and_text(docs), lambda: step, DIGESTS if digests else SPANS)
