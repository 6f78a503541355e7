"""Text and date expressions for landed news and documents."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "America/Sao_Paulo"

# Everything Python treats as white space (Java's class misses the four separators).
_SPACE = r"(?U)[\s\x1c-\x1f]+"


#: Numeric references that HTML reads as the Windows character of that number.
_WINDOWS = {str(i): bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)}
#: Names that count without a semicolon, longest first, so that the first match is the longest one.
_SHORT_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def _character(code: Column) -> Column:
    """Character of a code point given as a decimal number, by the rules for HTML references."""
    n = code.cast("long")
    lost = (code > 0x10FFFF) | (code == 0) | code.between(0xD800, 0xDFFF)
    none = (
        code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    )
    windows = F.element_at(F.from_json(F.lit(json.dumps(_WINDOWS)), "map<string,string>"), n.cast("string"))
    safe = F.when(lost | none, 32).otherwise(n)
    plain = F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")
    return F.when(lost, "\ufffd").when(code.between(0x80, 0x9F), windows).when(none, "").otherwise(plain)


def _resolved(piece: Column) -> Column:
    """What stands behind an ampersand, its reference resolved; an unknown one keeps the ampersand."""
    number = F.regexp_extract(piece, "^#(?:([0-9]+)|[xX][0-9a-fA-F]+);?", 1)
    digits = F.regexp_extract(piece, "^#[xX]([0-9a-fA-F]+);?", 1)
    # More digits than a code point can have leave the range, however many there are.
    tail = F.substring(F.concat(F.lit("0" * 8), F.regexp_replace(digits, "^0+", "")), -8, 8)
    from_hex = F.when(F.length(F.regexp_replace(digits, "^0+", "")) > 7, F.lit(0x110000)).otherwise(F.conv(tail, 16, 10).cast("decimal(20,0)"))
    short = F.regexp_replace(number, "^0+", "")
    from_number = F.when(F.length(short) > 8, F.lit(0x110000)).when(short == "", F.lit(0)).otherwise(short.cast("decimal(20,0)"))
    after_number = F.regexp_replace(piece, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", "")
    name = F.regexp_extract(piece, r"^[^\t\n\f <&#;]{1,32};?", 0)
    known = F.element_at(F.from_json(F.lit(json.dumps(html5)), "map<string,string>"), name)
    part = F.regexp_extract(piece, "^(?:" + "|".join(_SHORT_NAMES) + ")", 0)
    short_known = F.element_at(F.from_json(F.lit(json.dumps({n: html5[n] for n in _SHORT_NAMES})), "map<string,string>"), part)
    return (
        F.when(number != "", F.concat(_character(from_number), after_number))
        .when(digits != "", F.concat(_character(from_hex), after_number))
        .when((name != "") & known.isNotNull(), F.concat(known, F.substr(piece, F.length(name) + 1)))
        .when((part != "") & (F.length(part) < F.length(name) + 1), F.concat(short_known, F.substr(piece, F.length(part) + 1)))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def unescaped(text: Column) -> Column:
    """References resolved by the full HTML 5 table. Texts without an ampersand pass untouched."""
    pieces = F.split(text, "&", -1)
    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), _resolved)
    return F.when(F.instr(text, "&") > 0, F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))).otherwise(text)


def plain_text(markup: Column) -> Column:
    """Tags to blanks, entities resolved (the full HTML 5 table), white space collapsed and trimmed."""
    no_tags = F.regexp_replace(markup, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(unescaped(no_tags), _SPACE, " "))


def short_hash(text: Column) -> Column:
    """First ten hex digits of the SHA-1 of a query text."""
    return F.substring(F.sha1(text), 1, 10)


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def day_first(text: Column) -> Column:
    return F.to_date(text, "dd/MM/yyyy")


def compact_utc(text: Column) -> Column:
    """'20240102T000000Z' as an instant, whatever the session zone is."""
    return F.to_timestamp(F.regexp_replace(text, "Z$", "+0000"), "yyyyMMdd'T'HHmmssZ")


def mail_date(text: Column) -> Column:
    """RFC 822 date; the weekday name is dropped because Spark's parser rejects it."""
    body = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"\s(GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(
        F.try_to_timestamp(body, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(body, F.lit("d MMM yyyy HH:mm Z"))
    )


def local_day(instant: Column, zone: str = LOCAL_ZONE) -> Column:
    """Calendar day of an instant in the market's zone."""
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit(zone), instant.cast("timestamp_ntz")))


def date_chunks(start: Column, end: Column, days: int) -> Column:
    """Array of (start, end) pieces of a date range; each piece ends ``days`` after its start or at the end."""
    starts = F.sequence(start, end, F.expr(f"interval {days + 1} days"))
    return F.transform(
        starts, lambda s: F.struct(s.alias("chunk_start"), F.least(end, F.date_add(s, days)).alias("chunk_end"))
    )
