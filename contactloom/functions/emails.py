"""E-mail addresses as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactloom.functions.folds import distinct_by
from contactloom.functions.text import BLANK, WORD_ENDS, WORD_STARTS, first_fields, let, nonempty_distinct, percent_decoded, utrim

# The characters of a local part when capturing and when crawling, a captured address's host, and its last label [E1, E2].
LOCAL = r"a-z0-9.!#$%&'*+/=?^_`{|}~-"
CRAWLED_LOCAL = r"\w.!#$%&'*+/=?^`{|}~-"
HOST = "[a-z0-9](?:[a-z0-9.-]{0,61}[a-z0-9])?"
TOP = "(?:[a-z]{2,63}|xn--[a-z0-9-]{2,59})"


def _from_the_start(local: str) -> str:
    """A run of such characters from its start, or from the end of the last match: a long run is looked at once."""
    return rf"(?:\G|(?<![{local}]))[{local}]+"


ADDRESS = rf"(?i){_from_the_start(LOCAL)}@{HOST}\.{TOP}"
CRAWLED = rf"(?U){_from_the_start(CRAWLED_LOCAL)}@[\w-]+(?:\.[\w-]+)+"


def _spelt(word: str) -> str:
    return rf"(?:\[{word}\]|\({word}\)|{WORD_STARTS}{word}{WORD_ENDS})"


_SPELT = rf"(?i)({_from_the_start(LOCAL)}){BLANK}*{_spelt('at')}{BLANK}*([a-z0-9.-]+){BLANK}*{_spelt('dot')}{BLANK}*([a-z]{{2,63}})"


def revealed(text: Column) -> Column:
    """``name [at] host [dot] tld`` and its like as addresses; only texts that hold both words are searched."""
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("dot")) & F.contains(low, F.lit("at")), F.regexp_replace(text, _SPELT, "$1@$2.$3")).otherwise(text)


def _split(value: Column, then: Callable[[Column, Column], Column]) -> Column:
    """``then(local, domain)``: what stands before and after the last @."""
    domain = F.when(F.contains(value, F.lit("@")), F.substring_index(value, "@", -1)).otherwise("")
    local = lambda d: F.left(value, F.greatest(F.length(value) - F.length(d) - 1, F.lit(0)))
    return F.when(value.isNotNull(), let(domain, lambda d: let(F.when(F.contains(value, F.lit("@")), local(d)).otherwise(""), lambda x: then(x, d))))


def _badly_dotted(value: Column, local: Column) -> Column:
    return F.contains(value, F.lit("..")) | F.contains(local, F.lit(".")) & local.rlike(r"^\.|\.$")


def extracted_email(value: Column) -> Column:
    """An address found in a text: wrappers off, domain in lower case; empty if it can't be one."""
    bare = F.regexp_replace(utrim(value), r"^[<(\"'\[]+|[>)\"',.;:\]]+$", "")

    def checked(v: Column) -> Column:
        bad = lambda local: (local == "") | (F.length(v) > 254) | (F.length(local) > 64) | _badly_dotted(v, local)
        return _split(v, lambda local, domain: F.when(bad(local), F.lit("")).otherwise(F.concat(local, F.lit("@"), F.lower(domain))))

    return let(bare, checked)


def distinct_emails(values: Column) -> Column:
    """The non-empty ones, each once whatever its case, first wins."""
    return distinct_by(F.filter(values, lambda x: x.isNotNull() & (x != "")), F.lower)


def emails_in(text: Column) -> Column:
    """Addresses in a text, as found."""
    return let(revealed(text), lambda t: F.when(F.contains(t, F.lit("@")), F.regexp_extract_all(t, F.lit(ADDRESS), F.lit(0))).otherwise(F.array().cast("array<string>")))


def mailto_texts(hrefs: Column) -> Column:
    """What mailto hrefs name, several each, decoded."""
    named = F.transform(F.filter(F.transform(hrefs, utrim), lambda h: h.rlike("(?i)^mailto:")), lambda h: percent_decoded(first_fields(F.substr(h, F.lit(8)), "?#")))
    return F.flatten(F.transform(named, lambda x: F.split(x, "[;,]")))


def captured_emails(texts: Column) -> Column:
    """Addresses of texts in their order, normalized."""
    return distinct_emails(F.transform(F.flatten(F.transform(texts, emails_in)), extracted_email))


def crawled_emails(text: Column, hrefs: Column) -> Column:
    """Those of mailto hrefs first, then the text's, in lower case."""
    named = F.transform(F.filter(hrefs, lambda h: F.startswith(h, F.lit("mailto:"))), lambda h: F.substring_index(percent_decoded(F.substr(h, F.lit(8))), "?", 1))
    found = F.flatten(F.transform(F.concat(named, F.array(text)), lambda t: F.when(F.contains(t, F.lit("@")), F.regexp_extract_all(t, F.lit(CRAWLED), F.lit(0))).otherwise(F.array().cast("array<string>"))))
    return nonempty_distinct(F.transform(found, lambda x: F.regexp_replace(F.lower(x), "^[.,;:]+|[.,;:]+$", "")))


def normalized_email(value: Column) -> Column:
    """A stored address: trimmed, domain in lower case and with a dot; else empty."""

    def checked(v: Column) -> Column:
        bad = lambda local, domain: (local == "") | ~F.contains(domain, F.lit(".")) | _badly_dotted(v, local)
        return _split(v, lambda local, domain: F.when(bad(local, domain), F.lit("")).otherwise(F.concat(local, F.lit("@"), F.lower(domain))))

    return let(utrim(value), checked)


def normalized_emails(values: Column) -> Column:
    return distinct_emails(F.transform(values, normalized_email))


def email_key(value: Column) -> Column:
    return F.lower(normalized_email(value))
