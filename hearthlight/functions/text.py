"""Text columns: cleaning, hashing, identity, previews and chunks."""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlight import rules
from hearthlight.functions.matching import pattern, prefix_tree
from hearthlight.operators.barrier import evaluate_once

# Unicode white space; Java's plain \s is ASCII only and would miss the no-break space.
_NON_SPACE = (
    r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The first ranges rule out printable ASCII by two comparisons, before the list is gone through.
WHITESPACE = rf"[\x00- \x7f-\uffff&&[ {_NON_SPACE}]]"
_RUNS = rf"[\x00-\x1f\x7f-\uffff&&[{_NON_SPACE}]]{WHITESPACE}*| {WHITESPACE}+"
_TRIM = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(col(value), F.lit(_TRIM))


def collapse_whitespace(value) -> Column:
    """Each run of white space becomes one blank; lone blanks are left untouched."""
    return F.regexp_replace(col(value), _RUNS, " ")


def strip_tags(value) -> Column:
    return F.regexp_replace(col(value), r"<[^>]+>", " ")


def _code_point(number: Column) -> Column:
    """Character of a numeric reference, with the HTML rules for invalid numbers."""
    cp1252 = {n: bytes([n]).decode("cp1252", "replace") for n in range(0x80, 0xA0)}
    remapped = {n: (c if c != "\ufffd" else chr(n)) for n, c in cp1252.items()}
    remapped |= {0x00: "\ufffd", 0x0D: "\r"}
    low = (
        number.between(0x01, 0x08) | number.between(0x0E, 0x1F) | number.between(0x7F, 0x9F)
        | (number == 0x0B) | number.between(0xFDD0, 0xFDEF)
        | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    table = F.from_json(F.lit(json.dumps(remapped)), "map<string,string>")
    mapped = F.element_at(table, number.cast("string"))
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return (
        F.when(mapped.isNotNull(), mapped)
        .when(number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), F.lit("\ufffd"))
        .when(low, F.lit(""))
        .otherwise(char)
    )


def unescape_html(value) -> Column:
    """Decode HTML5 character references, named and numeric, in one pass.

    No reference contains an ampersand, so the text is split there and each piece decodes on its
    own. Names that may come without a semicolon match by their longest known prefix.
    """
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    bare = "^" + prefix_tree(n for n in html5 if not n.endswith(";"))
    huge = F.lit(0x7FFFFFFF).cast("bigint")

    def decode(piece: Column) -> Column:
        dec = F.regexp_extract(piece, r"^#([0-9]+);?", 1)
        hexa = F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]+);?", 1)
        number = F.when(
            dec != "", F.coalesce(dec.try_cast("bigint"), huge)
        ).when(
            F.length(F.ltrim(hexa, F.lit("0"))) > 8, huge
        ).otherwise(F.conv(hexa, 16, 10).try_cast("bigint"))
        name = F.regexp_extract(piece, r"^[^\t\n\f <&#;]{1,32};?", 0)
        known = F.element_at(names, name)
        prefix = F.regexp_extract(piece, bare, 0)
        return (
            F.when((dec != "") | (hexa != ""), F.concat(
                _code_point(number), F.regexp_replace(piece, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", "")
            ))
            .when((name != "") & known.isNotNull(),
                  F.concat(known, F.substring(piece, F.length(name) + 1, F.length(piece))))
            .when(prefix != "", F.concat(
                F.element_at(names, prefix),
                F.substring(piece, F.length(prefix) + 1, F.length(piece))))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    pieces = F.split(col(value), "&")
    return F.array_join(
        F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(decode(p))), ""
    )


def clean_text(value) -> Column:
    """Drop tags, then decode references, then collapse and trim white space; null becomes ''."""
    raw = col(value)
    bare = strip_tags(raw)
    decoded = F.when(F.contains(raw, F.lit("&")), unescape_html(bare)).otherwise(bare)
    return F.coalesce(F.trim(collapse_whitespace(decoded)), F.lit(""))


def normalize_training_text(value) -> Column:
    return F.lower(clean_text(value))


def text_hash(value) -> Column:
    """SHA-256 of the normalized text, in hexadecimal."""
    return F.sha2(normalize_training_text(value), 256)


def is_viable_training_text(cleaned) -> Column:
    """Enough letters to learn from, or a short text with a signal word. Takes cleaned text."""
    text = col(cleaned)
    size = F.length(text)
    long_enough = (size >= 15) & text.rlike("(?:[A-Za-z][^A-Za-z]*){3}")
    short_signal = (
        (size >= 6)
        & text.rlike("(?:[A-Za-z][^A-Za-z]*){2}")
        & text.rlike(pattern(rules.SHORT_TEXT_SIGNAL, ignore_case=True))
    )
    return F.coalesce(long_enough | short_signal, F.lit(False))


def normalize_identity(value, fallback: str = "N/A") -> Column:
    trimmed = strip(col(value).cast("string"))
    empty = trimmed.isNull() | (trimmed == "") | F.lower(trimmed).isin(*rules.NULL_LIKE)
    return F.when(empty, F.lit(fallback)).otherwise(trimmed)


def is_staff(name, email, domains=(), tokens=()) -> Column:
    """True for staff: an address in one of ``domains``, or a staff word in the name.

    ``domains`` and ``tokens`` hold the organisation's own values, for example
    ``("staff.example.org",)`` and ``("example org",)``; the generic words always apply.
    """
    who = F.lower(normalize_identity(name, ""))
    mail = F.lower(normalize_identity(email, ""))
    tests = [F.contains(mail, F.lit("@" + d.lower())) for d in domains]
    tests += [F.contains(who, F.lit(t.lower())) for t in (*rules.STAFF_NAME_TOKENS, *tokens)]
    return reduce(lambda a, b: a | b, tests)


def contact_email(value) -> Column:
    """First e-mail address in the text, or 'N/A'."""
    text = col(value)
    found = F.when(
        F.contains(text, F.lit("@")),
        F.regexp_extract(text, pattern(rules.EMAIL, ignore_case=True), 0),
    )
    return F.when(F.coalesce(found, F.lit("")) != "", found).otherwise(F.lit("N/A"))


def preview(value, size: int = 80, always_dots: bool = False) -> Column:
    text = col(value)
    dots = F.lit("...") if always_dots else F.when(F.length(text) > size, "...").otherwise("")
    return F.concat(F.substring(text, 1, size), dots)


def cap_chars(value, size: int = 2500) -> Column:
    return F.substring(col(value), 1, size)


def title_case(value) -> Column:
    return F.initcap(col(value))


def percent(value, digits: int = 1) -> Column:
    return F.round(col(value) * 100, digits)


def escape_html(value) -> Column:
    text = col(value)
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                      ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(ref))
    return text


def chunks(value, size: int = 300, overlap: int = 50) -> Column:
    """Array of overlapping word windows; a text of at most ``size`` words stays whole."""
    text = col(value)
    words = F.split(F.trim(collapse_whitespace(text)), " ")
    starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(size - overlap))
    windows = F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " "))
    return F.when(F.size(words) <= size, F.array(text)).otherwise(windows)


def explode_chunks(df: DataFrame, text: str = "content", size: int = 300,
                   overlap: int = 50) -> DataFrame:
    """One row per chunk, with ``chunk_no`` from 0 and ``chunk``."""
    return df.select(
        "*", F.posexplode(chunks(text, size, overlap)).alias("chunk_no", "chunk")
    )


def with_training_text(df: DataFrame, text: str = "content") -> DataFrame:
    """Clean the text column in place and add ``normalized_text``, ``text_hash``, ``char_len``.

    Cleaning is not idempotent (an escaped tag becomes a tag), and the hash is taken over the
    text cleaned once more, so both steps are kept as they are.
    """
    cleaned = evaluate_once(df, {text: clean_text(text)})
    return evaluate_once(cleaned, {
        "normalized_text": normalize_training_text(text)
    }).withColumns({
        "text_hash": F.sha2("normalized_text", 256),
        "char_len": F.length(text),
    })
