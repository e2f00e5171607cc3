"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby move the score.

Base kinds (e-mail, IP address, card, phone) are always kept once they pass their check. Further
kinds (account numbers by mod 97, shorter cards by Luhn, national phone and identity numbers) are
kept if their score, with what the words around them add, reaches a threshold.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import Span, SpanSet, count_of, find_spans, joined_spans, of_kinds

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "short_card", "national_phone", "identity")
MIN_SCORE = 0.6
CONTEXT_CHARS = 40

# The shapes that the contract names. Run starts are guarded where a failing run would
# otherwise be tried again from each of its characters; the matches are the same.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NATIONAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20/-])[0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9])")
IDENTITY = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write|mail", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|address|host|server|login", re.IGNORECASE),
    "card": re.compile(r"card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta", re.IGNORECASE),
    "short_card": re.compile(r"card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta", re.IGNORECASE),
    "phone": re.compile(r"phone|tel|call|mobile|fax|cell|whatsapp", re.IGNORECASE),
    "national_phone": re.compile(r"phone|tel\b|tel[.:]|telefon|call|mobile|fax|whatsapp", re.IGNORECASE),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.IGNORECASE),
    "identity": re.compile(r"ssn|social security|identity|tax id|passport", re.IGNORECASE),
}
_START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "short_card": 0.4, "national_phone": 0.4, "identity": 0.5}
_CONTEXT_BONUS = 0.3


def luhn(digits: str) -> bool:
    """Whether the digits' Luhn sum is divisible by ten; every second digit from the right counts twice."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number's check digits hold (letters count from 10, remainder 1)."""
    plain = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str):
    """Matches of local part, @ and dotted domain: leftmost, non-overlapping, in linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        # the local part cannot hold an @, so it is all that fits before this one
        low = at
        while low > free and text[low - 1] in _LOCAL:
            low -= 1
        domain = _DOMAIN.match(text, at + 1) if low < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield low, free
        at = text.find("@", free)


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _near(kind: str, text: str, start: int, end: int) -> bool:
    around = f"{text[max(0, start - CONTEXT_CHARS) : start]}\n{text[end : end + CONTEXT_CHARS]}"
    return bool(_CONTEXT[kind].search(around))


def pii_spans_of(text: str, min_score: float = MIN_SCORE) -> list[Span]:
    """Spans of one text by kind, then start; ``score`` is between 0 and 1."""
    base = [("email", s, e) for s, e in _emails(text)]
    base += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
    cards = [(m.start(), m.end(), _digits(m[0])) for m in CARD.finditer(text) if m.end() - m.start() >= 13]
    base += [("card", s, e) for s, e, d in cards if 16 <= len(d) <= 19 and luhn(d)]
    base += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    more = [("iban", m.start(), m.end()) for m in IBAN.finditer(text) if mod97(m[0])]
    more += [("short_card", s, e) for s, e, d in cards if 13 <= len(d) <= 15 and luhn(d)]
    more += [("national_phone", m.start(), m.end()) for m in NATIONAL_PHONE.finditer(text)]
    more += [("identity", m.start(), m.end()) for m in IDENTITY.finditer(text)]

    scored = [(k, s, e, min(1.0, _START_SCORE[k] + _CONTEXT_BONUS * _near(k, text, s, e))) for k, s, e in base + more]
    kept = [(k, s, e, text[s:e], score) for k, s, e, score in scored if k in BASE_KINDS]
    if len(scored) > len(kept):  # further kinds: good enough, and clear of what is there already
        taken = SpanSet((s, e) for _, s, e, _, _ in kept)
        last = 0
        for k, s, e, score in sorted(scored[len(kept) :], key=lambda x: (x[1], -x[2])):
            if score >= min_score and s >= last and not taken.meets(s, e):
                kept.append((k, s, e, text[s:e], score))
                last = e
    order = {kind: i for i, kind in enumerate((*BASE_KINDS, *MORE_KINDS))}
    return sorted(kept, key=lambda x: (order[x[0]], x[1]))


def _small(part: str) -> bool:
    return int(part.lstrip("0")[:4] or 0) <= 255


def pii_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``(key, spans)``: per row the personal data in its whole text.

    Null and empty texts have no spans; repeated rows and rows with a null key each give a row; other
    columns are ignored; an empty table gives no rows.
    """
    return find_spans(docs, key, text, lambda t: pii_spans_of(t, min_score))


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the personal data in ``documents``, one row per document."""
    spans = F.col("spans")
    return pii_spans(docs).select(
        "doc_id",
        *[count_of(spans, k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined_spans(of_kinds(spans, *BASE_KINDS)), 256).alias("base_sha256"),
        joined_spans(spans).alias("spans"),
        F.size(of_kinds(spans, *MORE_KINDS)).cast("long").alias("n_more"),
    )
