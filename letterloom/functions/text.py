"""Text expressions: tokens and their positions, plain text of HTML. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token, the English stop words, and the elements that do not break a word.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
ENGLISH_STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their "
    "then there these they this to was will with"
).split()
INLINE_ELEMENTS = (
    "a abbr acronym applet b basefont bdo big button cite code del dfn em font i iframe img "
    "input ins kbd label map object q s samp script select small span strike strong sub sup "
    "textarea tt u var"
).split()

# Positions skipped between two values of one field, so that no phrase crosses them.
POSITION_GAP = 100


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def tokens(text: Column) -> Column:
    """Lower-cased tokens of one text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def spaced_tokens(values: Column, gap: int = POSITION_GAP) -> Column:
    """Tokens of several values as one array, with ``gap`` nulls between two values.

    An array index is then the token's position.
    """
    hole = F.array_repeat(F.lit(None).cast("string"), gap)
    many = F.flatten(
        F.transform(values, lambda v, i: F.when(i == 0, tokens(v)).otherwise(F.concat(hole, tokens(v))))
    )
    return F.when(F.size(values) == 1, tokens(values[0])).otherwise(many)


def term_entries(token_array: Column, stop_words: list[str] | tuple[str, ...] = ()) -> Column:
    """``array<struct<term, pos array<int>>>`` of one document: its distinct terms, sorted.

    Grouping happens inside the row: sort the (term, position) pairs, find where a new term
    starts, cut there. A document needs no shuffle for this whatever its length. Positions are
    taken before stop words are dropped.
    """
    pairs = F.transform(token_array, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    pairs = F.filter(pairs, lambda p: p["term"].isNotNull())
    if stop_words:
        pairs = F.filter(pairs, lambda p: ~p["term"].isin(*stop_words))

    def cut(sorted_pairs: Column) -> Column:
        starts = F.filter(
            F.transform(
                sorted_pairs,
                lambda p, i: F.when((i == 0) | (F.get(sorted_pairs, i - 1)["term"] != p["term"]), i),
            ),
            lambda i: i.isNotNull(),
        )
        return bind(starts, lambda b: entries_of(sorted_pairs, b))

    def entries_of(s: Column, b: Column) -> Column:
        return F.transform(
            b,
            lambda start, j: F.struct(
                F.get(s, start)["term"].alias("term"),
                F.slice(s, start + 1, F.coalesce(F.get(b, j + 1), F.size(s)) - start)["pos"].alias("pos"),
            ),
        )

    return bind(F.sort_array(pairs), cut)


def decode_entities(text: Column) -> Column:
    """Replace named, decimal and hexadecimal character references; unknown ones stay. Digits may have any
    number of zeros before them, names are those of HTML 5 that end with a semicolon."""
    reference = r"&(#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"
    # one literal that is parsed when the plan is made; the few that pages hold most are told apart first
    rare = F.str_to_map(F.lit("\x01".join(f"{name}\x02{sign}" for name, sign in _NAMED.items())), F.lit("\x01"), F.lit("\x02"))

    def named(name: Column) -> Column:
        out = rare[name]
        for common in _COMMON:
            out = F.when(name == common, F.lit(_NAMED[common])).otherwise(out)
        return out

    def character(code: Column) -> Column:
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def value(ref: Column) -> Column:
        decimal = character(F.regexp_extract(ref, "^#0*([0-9]+)$", 1).try_cast("int"))
        hexadecimal = character(F.conv(F.regexp_extract(ref, "^#[xX]0*([0-9a-fA-F]+)$", 1), 16, 10).try_cast("int"))
        return F.coalesce(
            F.when(ref.rlike("^#[0-9]"), decimal).when(ref.rlike("^#[xX]"), hexadecimal).otherwise(named(ref)),
            F.concat(F.lit("&"), ref, F.lit(";")),
        )

    def decoded(t: Column) -> Column:
        pieces = F.split(t, reference, -1)
        joined = bind(
            F.regexp_extract_all(t, F.lit(reference), F.lit(1)),
            lambda refs: F.array_join(
                F.transform(pieces, lambda piece, i: F.concat(piece, F.coalesce(value(F.get(refs, i)), F.lit("")))), ""
            ),
        )
        return F.when(F.contains(t, F.lit("&")), joined).otherwise(t)

    return bind(text, decoded)


# Those that pages hold most, the most common one last.
_COMMON = ("middot", "copy", "apos", "gt", "lt", "quot", "nbsp", "amp")
_NAMED = {**{name[:-1]: sign for name, sign in html5.items() if name.endswith(";")}, "nbsp": " "}

# The chain of html_to_text, in order: (pattern, replacement). The same patterns work in RE2.
HTML_CHAIN = (
    (r"(?is)<!--.*?-->", ""),
    (r"(?is)<script(?:\s[^>]*)?>.*?</script\s*>", ""),
    (r"(?is)<style(?:\s[^>]*)?>.*?</style\s*>", ""),
    (rf"(?i)</?(?:{'|'.join(INLINE_ELEMENTS)})(?:[\s/][^>]*)?>", ""),
    (r"<[!/?a-zA-Z][^>]*>", " "),
)


def html_to_text(html: Column) -> Column:
    """Text of an HTML page: no comments, scripts, styles or tags, references decoded,
    white space collapsed. A block tag parts two words, an inline tag does not."""
    out = html
    for pattern, replacement in HTML_CHAIN:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(F.regexp_replace(decode_entities(out), r"[ \t\r\n\f]+", " "))


def body_text(content_type: Column, text: Column) -> Column:
    """Indexable text of one part: plain text as it is, HTML as text, anything else empty."""
    kind = F.lower(content_type)
    return (
        F.when(kind.startswith("text/plain"), text)
        .when(kind.startswith("text/html"), html_to_text(text))
        .otherwise(F.lit(""))
    )
