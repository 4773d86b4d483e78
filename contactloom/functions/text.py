"""Text helpers. Blanks are Unicode's; lengths count code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks, as one class of a pattern, and the ends of whole ASCII words.
BLANK = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: What Unicode calls white space, one by one.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORD_STARTS, WORD_ENDS = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
EASTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once."""
    return F.transform(F.array(value), then)[0]


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def utrim(value: Column) -> Column:
    # each end is held against every sign of the list, of which ASCII texts need but six
    return let(value, lambda v: F.when(F.octet_length(v) == F.length(v), F.btrim(v, F.lit(WHITE_SPACE[:6]))).otherwise(F.btrim(v, F.lit(WHITE_SPACE + "\ufeff"))))


def constants(pairs: dict[str, str | int]) -> Column:
    """A map of fixed values, parsed at once."""
    shown = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{shown(k)}, {shown(v)}" for k, v in pairs.items()) + ")")


def first_fields(text: Column, cut: str) -> Column:
    """What stands before the first character of a class."""
    return F.regexp_extract(text, rf"\A[^{cut}]*", 0)


def collapse_blanks(value: Column) -> Column:
    # single blanks stay as they are
    return utrim(F.regexp_replace(value, f"(?:[{WHITE_SPACE.replace(' ', '')}]| (?=[{WHITE_SPACE}]))[{WHITE_SPACE}]*", " "))


def ascii_digits(value: Column) -> Column:
    """Arabic-Indic and Persian digits as 0 to 9; an ASCII text is not looked through."""
    return let(value, lambda v: F.when(F.octet_length(v) == F.length(v), v).otherwise(F.translate(v, EASTERN_DIGITS, "0123456789" * 2)))


def digits(value: Column) -> Column:
    return F.regexp_replace(ascii_digits(value), "[^0-9]", "")


def ellipsized(value: Column, most: int) -> Column:
    return F.when(F.length(value) > most, F.concat(F.rtrim(F.left(value, F.lit(most - 1))), F.lit("…"))).otherwise(value)


def first_nonempty(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def percent_decoded(value: Column) -> Column:
    """Percent-decoding that keeps plus signs, and malformed text as it is."""
    return let(value, lambda v: F.when(F.contains(v, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v)).otherwise(v))


def nonempty_distinct(values: Column) -> Column:
    """The non-empty values, each once, in first-seen order."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def spaced(words: str) -> str:
    """A pattern of words in which a blank stands for any number of blanks."""
    return words.replace(" ", BLANK + "*")


def whole_words(patterns: list[str]) -> str:
    """A pattern of any of some patterns between characters that are no ASCII letters, digits or underscores, in any case."""
    return f"(?i){WORD_STARTS}(?:{'|'.join(patterns)}){WORD_ENDS}"
