"""Per-line byte functions as Spark expressions over a binary column.

Patterns run on the Latin-1 view of the bytes, where each byte is one character; the view is lossless both ways.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space, tab, vertical tab (fixed values).
WHITESPACE = b"\x20\x09\x0b"


def latin1(line: Column) -> Column:
    return F.decode(line, "ISO-8859-1")


def from_latin1(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def to_dollar_hex(c: Column) -> Column:
    """Latin-1 text in, text out: lines with a byte outside 0x20-0x7e become $HEX[lower-case hex]."""
    return F.when(c.rlike("[^\\x20-\\x7e]"), F.concat(F.lit("$HEX["), F.lower(F.hex(from_latin1(c))), F.lit("]"))).otherwise(c)


def from_dollar_hex(c: Column) -> Column:
    """The inverse; anything that is no whole $HEX[...] stays."""
    inner = F.regexp_extract(c, r"\A\$HEX\[((?:[0-9A-Fa-f]{2})*)\]\z", 1)
    return F.when(c.rlike(r"\A\$HEX\[(?:[0-9A-Fa-f]{2})*\]\z"), latin1(F.unhex(inner))).otherwise(c)


def trim(c: Column, chars: bytes = WHITESPACE) -> Column:
    return F.btrim(c, F.lit(chars.decode("latin-1")))


def strip(c: Column, chars: bytes = WHITESPACE) -> Column:
    return F.translate(c, chars.decode("latin-1"), "")


def strip_nulls(c: Column) -> Column:
    return F.replace(c, F.lit("\x00"), F.lit(""))  # a search for one byte; translate would look at each character


def shard_key(line: Column, k: int) -> Column:
    """Hex of byte k (from 1); `!` for shorter lines."""
    return F.when(F.octet_length(line) < k, F.lit("!")).otherwise(F.lower(F.hex(F.substring(line, k, 1))))


#: Character classes, their bits and names (fixed values).
CATEGORIES = (
    (1, "UppercaseLetter", "[A-Z]"),
    (2, "LowercaseLetter", "[a-z]"),
    (4, "Number", "[0-9]"),
    (8, "Punctuation", r"[!-/:-@\[-`{-~]"),
    (16, "Whitespace", r"[\x20\x09\x0b]"),
    (32, "LowControl", r"[\x00-\x08\x0a\x0c-\x1f]"),
    (64, "HighNonAscii", r"[\x7f-\xff]"),
)


def category_mask(c: Column) -> Column:
    """Bits of all classes that a line's bytes fall in."""
    out = F.lit(0)
    for bit, _, pattern in CATEGORIES:
        out = out + F.when(c.rlike(pattern), bit).otherwise(0)
    return out


def category_names(mask: Column) -> Column:
    """Names of a mask's bits, by comma and space; Empty for 0."""
    names = F.array_compact(F.array(*[F.when(mask.bitwiseAND(bit) != 0, F.lit(name)) for bit, name, _ in CATEGORIES]))
    return F.when(mask == 0, F.lit("Empty")).otherwise(F.array_join(names, ", "))


def charset_name(mask: Column) -> Column:
    """Short name of a mask: letter case, then Number, Symbol, Special, Extended; Empty for 0."""
    has = lambda bits: mask.bitwiseAND(bits) != 0
    case = F.when(has(1) & has(2), "Mixed").when(has(1), "Upper").when(has(2), "Lower").otherwise("")
    rest = [F.when(has(bits), F.lit(name)).otherwise("") for bits, name in ((4, "Number"), (8 | 16, "Symbol"), (32, "Special"), (64, "Extended"))]
    return F.when(mask == 0, F.lit("Empty")).otherwise(F.concat(case, *rest))
