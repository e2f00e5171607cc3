"""Secrets in texts: fixed shapes, and values in a credential context that are costly to guess.

A value's cost is the least number of guesses (log10) over all ways to cut it into known words,
dates, repeats, keyboard walks, runs of neighbours and brute-force characters; a dynamic programme
over the value's characters finds it. ``password = password1`` is cheap and no secret,
``passphrase: kX9#vvQ2-t`` is costly and one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import Span, SpanSet, count_of, find_spans, joined_spans, of_kinds

BASE_KINDS = ("assign", "access", "hex")
GUESS_KIND = "guess"
MIN_LOG10_GUESSES = 8.0
MIN_VALUE = 6
# A cost is not followed further than this: every decision is taken far below it.
SATURATED = 64.0

# The shapes that the contract names.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run that starts here and is shorter cannot match further on
HEX = re.compile(r"[0-9a-f]{32,}")

CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z])|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?:password|passwd|passphrase|passcode|pwd|secret|token|credential|bearer|authorization
    |api[_-]?key|access[_-]?key|private[_-]?key)s?["']?(?:\x20*(?::=|=>|==|=|:)|\x20is\x20)\x20*
    (?:(?:bearer|basic)\x20)?(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;<>()\[\]{}]+))""",
    re.IGNORECASE | re.ASCII | re.VERBOSE,
)
USERINFO = re.compile(r"://[^\s:@/]*:([^\s@/]+)@")

COMMON_WORDS = (
    "password pass admin root user login welcome letmein master secret token test guest default changeme "
    "dragon monkey shadow sunshine princess football baseball superman batman michael jordan summer winter "
    "spring autumn hello love money freedom whatever trustno computer internet server system public private "
    "service example sample demo temp null none true false value string your my the and key api access auth"
).split()
_RANKS = {w: i + 2 for i, w in enumerate(COMMON_WORDS)}
_LONGEST_WORD = max(map(len, COMMON_WORDS))
_LEET = str.maketrans("@4310$57", "aaeiosst")
_KEY_ROWS = ("`1234567890-=", "\0qwertyuiop[]", "\0asdfghjkl;'", "\0zxcvbnm,./")
_DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0?[1-9]|[12]\d|3[01])([-/._])(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d"
    r"|(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d"
)
_YEAR = re.compile(r"(?:19|20)\d\d")
# What a plain syllable starts with, holds and ends with, and what may follow a word's last one.
_SYLLABLE = re.compile(
    "(?:qu|[bcdfghjklmnprstvwyz]|[bcdfgpst][rl]|[cstw]h|st)?(?:ai|ea|ee|ie|oa|oo|ou|[aeiouy])(?:ck|ng|n[dt]|st|ll|ss|[cst]h|[bcdfgklmnprstvwxyz])?"
)
_ENDING = re.compile("(?:s|ed|er|ing|ly|es)(?![a-z])")
# Guesses (log10) for a syllable: some 20 starts, 6 vowels and 20 ends; for one more ending.
_SYLLABLE_COST, _ENDING_COST, _MOST_SYLLABLES = 3.4, 1.0, 8
_MAX_PERIOD = 8


def _neighbours() -> set[tuple[str, str]]:
    at = {c: (x + y / 2, y) for y, row in enumerate(_KEY_ROWS) for x, c in enumerate(row) if c != "\0"}
    return {(a, b) for a, (x, y) in at.items() for b, (u, v) in at.items() if a != b and abs(x - u) <= 1 and abs(y - v) <= 1}


_NEXT_KEYS = _neighbours()


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33)


def _run_ends(n: int, holds) -> list[int]:
    """For each place the end of the longest run from there in which ``holds(i)`` links i and i + 1."""
    ends = [n] * n
    for i in range(n - 2, -1, -1):
        ends[i] = ends[i + 1] if holds(i) else i + 1
    return ends


class _Arcs:
    """The ways to go on from each place of a value: single characters, words, dates, walks, runs and repeats."""

    def __init__(self, value: str):
        n = len(value)
        self.value, self.plain = value, value.lower()
        plain = self.plain
        self.leet = plain.translate(_LEET)
        self.walk = _run_ends(n, lambda i: (plain[i], plain[i + 1]) in _NEXT_KEYS)
        self.up = _run_ends(n, lambda i: ord(plain[i + 1]) - ord(plain[i]) == 1)
        self.down = _run_ends(n, lambda i: ord(plain[i + 1]) - ord(plain[i]) == -1)
        self.repeats: dict[int, list[int]] = {}
        for p in range(1, min(_MAX_PERIOD, n // 2) + 1):
            ends = [0] * (n + 1)
            for i in range(n - p - 1, -1, -1):
                ends[i] = (ends[i + 1] or i + p + 1) if plain[i] == plain[i + p] else 0
            self.repeats[p] = ends

    def cased(self, i: int, j: int) -> float:
        return math.log10(2) * (self.value[i:j] != self.plain[i:j])

    def of(self, i: int) -> Iterator[tuple[int, float]]:
        """Ends and costs of all pieces that start at ``i``; a piece of more than a character costs one more cut to guess."""
        value, plain, n = self.value, self.plain, len(self.value)
        cut = 0.3 * (i > 0)
        yield i + 1, _brute(value[i])
        for j in range(i + 3, min(_LONGEST_WORD, n - i) + i + 1):
            if rank := _RANKS.get(plain[i:j]):
                yield j, cut + math.log10(rank) + self.cased(i, j)
            elif rank := _RANKS.get(self.leet[i:j]):
                yield j, cut + math.log10(rank) + self.cased(i, j) + math.log10(2)
        yield from self.unknown_words(i, cut)
        if m := _DATE.match(value, i):
            yield m.end(), cut + math.log10(365 * 120) + 0.6 * bool(m[1] or m[2])
        if _YEAR.match(value, i):
            yield i + 4, cut + math.log10(120)
        if (j := self.walk[i]) - i >= 3:
            turns = sum(ord(plain[k + 1]) - ord(plain[k]) != ord(plain[k]) - ord(plain[k - 1]) for k in range(i + 1, min(j, i + 32) - 1))
            yield j, cut + math.log10(94) + math.log10(j - i) + turns * math.log10(3)
        for ends in (self.up, self.down):
            if (j := ends[i]) - i >= 3:
                yield j, cut + math.log10(52) + math.log10(j - i)
        for p, ends in self.repeats.items():
            if (j := i + (ends[i] - i) // p * p) - i >= max(2 * p, 3):
                yield j, cut + sum(_brute(c) for c in value[i : i + p]) + math.log10((j - i) // p)

    def unknown_words(self, i: int, cut: float) -> Iterator[tuple[int, float]]:
        """Words of plain syllables, each priced for itself, so random letters seldom are one and long ones are never cheap."""
        at, cost = i, cut
        for _ in range(_MOST_SYLLABLES):
            m = _SYLLABLE.match(self.plain, at)
            if not m:
                return
            # an end that the next syllable needs as its start is left to it
            if m[0][-1] not in "aeiouy" and len(m[0]) > 1 and self.plain[m.end() : m.end() + 1] in tuple("aeiouy"):
                at = m.end() - 1
            else:
                at = m.end()
            cost += _SYLLABLE_COST
            yield at, cost + self.cased(i, at)
            if e := _ENDING.match(self.plain, at):
                yield e.end(), cost + _ENDING_COST + self.cased(i, e.end())


def guess_cost(value: str) -> float:
    """Least log10 number of guesses for ``value`` (at most ``SATURATED``); 0 for the empty text.

    Runs (repeats, walks, neighbours) are taken as far as they go, words are at most as long as the
    longest known word, so the time is linear in the length of the value. It ends where no place that can still be reached is
    below the bound.
    """
    n = len(value)
    arcs = _Arcs(value)
    best = [0.0] + [math.inf] * n
    reached = 0  # the furthest place below the bound
    for i in range(n):
        if i > reached:
            return SATURATED
        start = best[i]
        if start >= SATURATED:
            continue
        for j, cost in arcs.of(i):
            if start + cost < best[j]:
                best[j] = start + cost
                if best[j] < SATURATED and j > reached:
                    reached = j
    return min(best[n], SATURATED)


def secret_spans_of(text: str, min_log10: float = MIN_LOG10_GUESSES) -> list[Span]:
    """Spans of one text by start, then kind; values in context count only if they meet no base span. Base spans
    are found by their shape and have no score."""
    found: list[Span] = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            found.append(("assign", m.start(), m.end(), m[2], None))
    found += [("access", m.start(), m.end(), m[0], None) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0], None) for m in HEX.finditer(text)]
    base, last = SpanSet((s, e) for _, s, e, _, _ in found), 0
    guessed = [(m.start(g), m.end(g)) for p in (CONTEXT, USERINFO) for m in p.finditer(text) if (g := m.lastindex)]
    for start, end in sorted(guessed):
        if end - start < MIN_VALUE or start < last or base.meets(start, end):
            continue
        cost = guess_cost(text[start:end])
        if cost >= min_log10:
            found.append((GUESS_KIND, start, end, text[start:end], cost))
            last = end
    order = {kind: i for i, kind in enumerate((*BASE_KINDS, GUESS_KIND))}
    return sorted(found, key=lambda s: (s[1], order[s[0]]))


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", min_log10: float = MIN_LOG10_GUESSES) -> DataFrame:
    """``(key, spans)``: per row the secrets in its whole text; ``score`` is the log10 guesses of a value in context.

    Null and empty texts have no spans; repeated rows and rows with a null key each give a row; other
    columns are ignored; an empty table gives no rows.
    """
    return find_spans(docs, key, text, lambda t: secret_spans_of(t, min_log10))


def secrets_report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the secrets in ``documents``, one row per document."""
    spans = F.col("spans")
    return secret_spans(docs).select(
        "doc_id",
        *[count_of(spans, k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined_spans(of_kinds(spans, *BASE_KINDS)), 256).alias("base_sha256"),
        joined_spans(spans).alias("spans"),
        count_of(spans, GUESS_KIND).alias("n_guess"),
    )
