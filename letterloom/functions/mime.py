"""RFC 822 messages as columns: headers unfolded, bodies cut at their boundaries, senders and time read, all by Spark's expressions.

A message is looked at as signs, one for each byte (Latin-1), so that it can be cut before any charset is known. Only the decoding of
single values, transfer encodings, charsets and encoded words, is left to Python: :func:`decoded_part`, :func:`decoded_words`.
"""

from __future__ import annotations

import base64
import binascii
import quopri
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterloom.functions.text import bind

# Entities within entities that are opened; what lies deeper stays one part without text.
MOST_NESTED = 5

_HEADER = r"^[!-9;-~]*:"
_ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def signs(content: Column) -> Column:
    """The bytes of a message as signs, lines ended by a line feed."""
    return F.regexp_replace(F.decode(content, "ISO-8859-1"), "\r\n?", "\n")


def entity(text: Column) -> Column:
    """``struct<headers array<struct<name, value>>, body, kind, bound, multi>`` of a message or a part.

    Headers end at a blank line, or at the first line that is none. ``kind`` is the content type, ``bound`` the expression of the lines between
    its parts, ``multi`` whether it has any.
    """

    def with_lines(t: Column) -> Column:
        at = F.locate("\n\n", t)
        none, whole = t.startswith("\n"), at == 0
        head = F.when(none, F.lit("")).when(whole, t).otherwise(F.left(t, at - 1))
        body = F.when(none, F.substring(t, F.lit(2), F.length(t))).when(whole, F.lit("")).otherwise(F.substring(t, at + 2, F.length(t)))
        lines = F.split(F.regexp_replace(head, r"\n(?=[ \t])", ""), "\n")
        lines = F.when(head == "", F.array().cast("array<string>")).when(head.startswith("From "), F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)
        gap = F.when(none | whole, F.lit("")).otherwise(F.lit("\n\n"))
        return bind(F.struct(lines.alias("lines"), body.alias("body"), gap.alias("gap")), parsed)

    def parsed(cut: Column) -> Column:
        lines = cut["lines"]
        wrong = F.array_position(F.transform(lines, lambda line: F.rlike(line, F.lit(_HEADER))), False)
        good = F.when(wrong == 0, F.size(lines)).otherwise(wrong - 1).cast("int")
        name = lambda line: F.substring_index(line, ":", 1)
        value = lambda line: F.regexp_replace(F.substring(line, F.instr(line, ":") + 1, F.length(line)), r"^[ \t]+", "")
        headers = F.transform(F.slice(lines, F.lit(1), good), lambda line: F.struct(name(line).alias("name"), value(line).alias("value")))
        left = F.when(wrong > 0, F.concat(F.array_join(F.slice(lines, wrong.cast("int"), F.size(lines)), "\n"), cut["gap"])).otherwise(F.lit(""))
        return bind(F.struct(headers.alias("headers"), F.concat(left, cut["body"]).alias("body")), typed)

    def typed(e: Column) -> Column:
        kind = F.coalesce(header(e["headers"], "content-type"), F.lit("text/plain"))
        kind = F.trim(F.regexp_replace(kind, r"\s+", " "))
        return bind(kind, lambda k: bound_of(e, k))

    def bound_of(e: Column, kind: Column) -> Column:
        mark = parameter(kind, "boundary")
        line = F.concat(F.lit(r"(?:^|\n)--\Q"), F.replace(mark, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        bound = F.when(F.lower(kind).startswith("multipart/") & (mark != ""), line)
        parts = F.coalesce(F.rlike(e["body"], F.concat(bound, F.lit(r"[ \t]*(?:\n|\z)"))), F.lit(False))
        inner = F.lower(kind).startswith("message/rfc822") & (e["body"] != "")
        return F.struct(e["headers"].alias("headers"), e["body"].alias("body"), kind.alias("kind"), bound.alias("bound"), (parts | inner).alias("multi"))

    return bind(text, with_lines)


def opened(entities: Column) -> Column:
    """Entities in order, each that has parts replaced by them. Open as often as parts may lie within parts."""

    def pieces(e: Column) -> Column:
        """The texts between the bounds, up to the closing one; a message within a message is one text."""
        inner = F.get(F.split(e["body"], F.concat(e["bound"], F.lit(r"--[ \t]*(?:\n|\z)")), 2), 0)
        cut = F.split(inner, F.concat(e["bound"], F.lit(r"[ \t]*(?=\n|\z)")), -1)
        texts = F.transform(F.slice(cut, F.lit(2), F.size(cut)), lambda t: F.substring(t, F.lit(2), F.length(t)))
        return F.when(e["bound"].isNull(), F.array(e["body"])).otherwise(texts)

    each = F.transform(entities, lambda e: F.when(e["multi"], F.transform(pieces(e), entity)).otherwise(F.array(e)))
    return F.when(F.exists(entities, lambda e: e["multi"]), F.flatten(each)).otherwise(entities)


def header(headers: Column, name: str) -> Column:
    """The first value of a header, by its lower-cased name."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), 0)["value"]


def parameter(value: Column, name: str) -> Column:
    """``name=value`` after a semicolon, quoted or not; empty if there is none."""
    pattern = rf'(?i);\s*{name}\s*=\s*(?:"([^"]*)"|([^\s;"]+))'
    return F.concat(F.regexp_extract(value, pattern, 1), F.regexp_extract(value, pattern, 2))


def senders(value: Column) -> Column:
    """Addresses between commas as ``name <address>``, or the address alone."""
    each = F.transform(F.split(F.regexp_replace(value, r"\s+", " "), r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda a: F.trim(a))
    plain = F.transform(each, lambda a: F.regexp_replace(F.regexp_replace(a, r'^"([^"]*)"\s*<', "$1 <"), r"^([^<>()\s]+@[^<>()\s]+)\s*\(([^)]*)\)$", "$2 <$1>"))
    return F.filter(F.transform(plain, lambda a: F.regexp_replace(a, r"^<([^<>]*)>$", "$1")), lambda a: a != "")


def sent_at(value: Column) -> Column:
    """The time of a date header; null if it is none."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(value, r"\([^)]*\)", "")), r"^[A-Za-z]+,\s*", "")
    plain = F.regexp_replace(plain, r"\s+", " ")
    for zone, offset in _ZONES.items():
        plain = F.regexp_replace(plain, rf" {zone}$", f" {offset}")
    read = [F.try_to_timestamp(plain, F.lit(f"d MMM {year} HH:mm[:ss] xx")) for year in ("yyyy", "yy")]
    return F.when(F.rlike(plain, F.lit(r"^\d{1,2} [A-Za-z]{3} \d{4} ")), read[0]).otherwise(read[1])


# What is decoded value by value

_WORD = re.compile(r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?=")


def _base64(data: bytes) -> bytes:
    data = re.sub(rb"[^A-Za-z0-9+/]", b"", data)
    return base64.b64decode(data[: len(data) - (len(data) % 4 == 1)] + b"=" * (-len(data) % 4))


def decoded_part(raw: str, encoding: str, charset: str) -> str:
    """The text of a part; a charset that is missing or unknown is taken as UTF-8, and what cannot be decoded is replaced."""
    data, encoding = raw.encode("latin-1", "replace"), encoding.strip().lower()
    if encoding == "base64":
        try:
            data = _base64(data)
        except (binascii.Error, ValueError):
            pass
    elif encoding == "quoted-printable":
        data = quopri.decodestring(data)
    try:
        text = data.decode(charset.lower() or "utf-8", "replace")
    except (LookupError, ValueError):
        text = data.decode("utf-8", "replace")
    return text.replace("\r\n", "\n")


def decoded_words(value: str) -> str:
    """A header's value with its encoded words read; one that cannot be read stays whole as it is."""
    raw = value.encode("latin-1", "replace").decode("utf-8", "replace")
    if "=?" not in raw:
        return raw
    out: list[tuple[bytes, str | None]] = []
    at = 0
    try:
        for m in _WORD.finditer(raw):
            between = raw[at : m.start()]
            if between.strip() or not out or out[-1][1] is None:
                out.append((between.encode(), None))
            charset = m[1].split("*")[0].lower()
            data = _base64(m[3].encode()) if m[2] in "bB" else quopri.decodestring(m[3].replace("_", " ").encode(), header=True)
            if out and out[-1][1] == charset:
                data = out.pop()[0] + data  # a letter may be cut between two words
            out.append((data, charset))
            at = m.end()
        return "".join(data.decode(charset or "utf-8") for data, charset in out) + raw[at:]
    except (LookupError, UnicodeError, ValueError):
        return raw
