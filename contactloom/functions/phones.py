"""Phone numbers as Column expressions: finding, judging, normalizing, countries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactloom import dims
from contactloom.functions import urls
from contactloom.functions.folds import fold_by, stronger_or_fuller
from contactloom.functions.text import BLANK, WORD_ENDS, WORD_STARTS, ascii_digits, collapse_blanks, constants, digits, ellipsized, first_fields, first_nonempty, let, percent_decoded, spaced, text_or_empty, utrim, whole_words

_BETWEEN = r"[ \t\x{A0}().-]"
CANDIDATE = rf"(?:\+|00)?[0-9](?:{_BETWEEN}*[0-9]){{6,18}}"
#: Digits of the shortest candidate.
FEWEST_DIGITS = 7
#: Characters of the line on each side of a number that are its context; its most characters; those of a stored one.
NEAR, CONTEXT, STORED_CONTEXT = 90, 180, 200
_CANDIDATES = "array<struct<raw:string,context:string,source:string>>"

_EGYPT_PLAN = rf"(?:1[0125][0-9]{{8}}|2[0-9]{{8}}|3[0-9]{{7}}|(?:{'|'.join(dims.EGYPT_AREA_CODES)})[0-9]{{7}})"


def _bare(value: Column) -> Column:
    """Decoded, without scheme and parameters."""
    return first_fields(F.regexp_replace(percent_decoded(ascii_digits(text_or_empty(value))), "(?i)^tel:", ""), ";?")


def cleaned_phone(value: Column) -> Column:
    """A number without its scheme, parameters, marks and edges."""
    plain = F.regexp_replace(_bare(value), r"[\x{200E}\x{200F}\x{202A}-\x{202E}]", "")
    return utrim(F.regexp_replace(F.regexp_replace(plain, r"[ \t\x{A0}]+", " "), r"^[^0-9+]+|[^0-9)]+$", ""))


def phone_key(value: Column) -> Column:
    """Under which candidates are the same: the digits, without a leading 00."""
    return F.regexp_replace(digits(text_or_empty(value)), "^00", "")


def cleaned_context(value: Column, most: int = CONTEXT) -> Column:
    return ellipsized(utrim(F.regexp_replace(collapse_blanks(text_or_empty(value)), r"^[\s,;:|–—-]+|[\s,;:|–—-]+$", "")), most)


def candidate(raw: Column, context: Column, source: Column) -> Column:
    return F.struct(raw.alias("raw"), context.alias("context"), source.alias("source"))


def _date(y: Column, m: Column, d: Column) -> Column:
    """Whether three numbers, as text, are a day of 1900 to 2100."""
    year, month, day = (x.try_cast("int") for x in (y, m, d))
    last = F.day(F.last_day(F.make_date(year, month, F.lit(1))))
    # the parts are checked before a date is made of them
    return F.when(F.coalesce(year.between(1900, 2100) & month.between(1, 12) & day.between(1, 31), F.lit(False)), day <= last).otherwise(False)


def looks_like_date(value: Column) -> Column:
    """Three runs of digits that form a calendar day, two years, or a day of eight digits."""
    plain = ascii_digits(value)
    day = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
    none = F.array().cast("array<struct<y:string,m:string,d:string>>")

    def any_three(g: Column) -> Column:
        at = F.when(F.size(g) >= 3, F.sequence(F.lit(0), F.size(g) - 3)).otherwise(F.array().cast("array<int>"))
        a, b, c = (lambda i: g[i]), (lambda i: g[i + 1]), (lambda i: g[i + 2])
        return F.flatten(F.transform(at, lambda i: F.array(day(a(i), b(i), c(i)), day(c(i), b(i), a(i)), day(c(i), a(i), b(i)))))

    def eight(d: Column) -> Column:
        cut = lambda a, n: F.substr(d, F.lit(a), F.lit(n))
        return F.when(F.length(d) == 8, F.array(day(cut(1, 4), cut(5, 2), cut(7, 2)), day(cut(5, 4), cut(3, 2), cut(1, 2)), day(cut(5, 4), cut(1, 2), cut(3, 2)))).otherwise(none)

    years = utrim(plain).rlike(r"^(?:19|20)[0-9]{2}[ \t.-]+(?:19|20)[0-9]{2}$")
    read = F.concat(let(phone_key(value), eight), let(F.regexp_extract_all(plain, F.lit("[0-9]+"), F.lit(0)), any_three))
    return years | F.exists(read, lambda x: _date(x["y"], x["m"], x["d"]))


def _suffixed(things: list[str], suffixes: list[str], needed: bool) -> str:
    """Things with a suffix, whole words: behind a suffix that is a sign, a word must follow, behind any other none may."""
    words, signs = [x for x in suffixes if x.isalnum()], [x for x in suffixes if not x.isalnum()]
    ends = [rf"(?:{'|'.join(words)}){WORD_ENDS}", *([rf"[{''.join(signs)}](?=[A-Za-z0-9_])"] if signs else []), *([] if needed else [WORD_ENDS])]
    return rf"(?:{'|'.join(things)})(?:{BLANK}*(?:{'|'.join(ends[: len(ends) - (not needed)])}){'' if needed else '|' + WORD_ENDS})"


_WHATSAPP = r"whats(?:[\s-]|\x{A0})*app"
_PHONE_CUE = [whole_words([_WHATSAPP if x == "whatsapp" else x for x in dims.PHONE_CUES]), "|".join(map(spaced, dims.PHONE_CUES_AR))]
_NON_PHONE_CUE = [
    f"(?i){WORD_STARTS}(?:"
    + "|".join([_suffixed(dims.NUMBERED_THINGS, dims.NUMBERED_SUFFIXES, False), _suffixed(dims.NUMBERED_PAGES, dims.NUMBERED_PAGE_SUFFIXES, True), _suffixed(dims.COUNTED_THINGS, dims.COUNTED_SUFFIXES, False), f"(?:{'|'.join(map(spaced, dims.OTHER_NON_PHONES))}){WORD_ENDS}"])
    + ")",
    "|".join([*(spaced(f"{word} (?:{'|'.join(of)})") for word, of in dims.NUMBERED_THINGS_AR.items()), *map(spaced, dims.OTHER_NON_PHONES_AR)]),
]
_PRICE_CUE = [f"[{dims.PRICE_SIGNS}]|{'|'.join(dims.PRICE_CUES_AR)}", whole_words(dims.PRICE_CUES)]
#: A mention of WhatsApp, in English or Arabic.
MENTION = f"(?:{_WHATSAPP}|{spaced(dims.PHONE_CUES_AR[-1])})"


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike(patterns[0]) | text.rlike(patterns[1])


def phone_cue(text: Column) -> Column:
    return _any(text, _PHONE_CUE)


def non_phone_cue(text: Column) -> Column:
    return _any(text, _NON_PHONE_CUE)


def price_cue(text: Column) -> Column:
    return _any(text, _PRICE_CUE)


def egyptian_shape(value: Column) -> Column:
    return phone_key(value).rlike("^(?:01[0125][0-9]{8}|201[0125][0-9]{8}|0[2-9][0-9]{7,8}|20[2-9][0-9]{7,8})$")


def is_likely_phone(value: Column, context: Column, explicit: Column) -> Column:
    """The rules in order; the first that applies decides. ``explicit``: the markup says that it is a number."""
    around = text_or_empty(context)

    def judged(v: Column) -> Column:
        return let(
            F.struct(v.alias("v"), phone_key(v).alias("d")),
            lambda x: F.when(~F.length(x["d"]).between(8, 15), False)
            .when(x["d"].rlike(r"^([0-9])\1+$") | looks_like_date(x["v"]), False)
            .when(price_cue(around), False)
            .when(explicit, True)
            .when(non_phone_cue(around), False)
            .when(egyptian_shape(x["v"]), True)
            .when(x["v"].rlike(r"^(?:\+|00)"), True)
            .when(phone_cue(around), True)
            .otherwise(x["v"].rlike("[ ()-]")),
        )

    return let(cleaned_phone(value), judged)


_A, _B = "\x01", "\x02"


def matches(text: Column, then: Callable[[Column, Column], Column]) -> Column:
    """``then(raw, context)`` of each candidate of the text, in order; the context is the rest of its line, nearby."""
    plain = F.translate(ascii_digits(text_or_empty(text)), _A + _B, "  ")
    marked = F.regexp_replace(plain, f"({CANDIDATE})", f"{_A}$1{_B}")

    def found(pieces: Column) -> Column:
        def one(k: Column) -> Column:
            # other candidates nearby are text like any other; every second piece has 7 characters or more
            many = 2 * NEAR // 7 + 2
            first = F.greatest(k - many, F.lit(0))
            before = F.right(F.array_join(F.slice(pieces, first + 1, k - first), ""), F.lit(NEAR))
            after = F.left(F.array_join(F.slice(pieces, k + 2, F.lit(many)), ""), F.lit(NEAR))
            return then(utrim(pieces[k]), cleaned_context(F.concat(F.regexp_extract(before, r"[^\n\r]*\z", 0), F.lit(" "), F.regexp_extract(after, r"^[^\n\r]*", 0))))

        return F.transform(F.when(F.size(pieces) > 2, F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))).otherwise(F.array().cast("array<int>")), one)

    return let(F.split(marked, f"[{_A}{_B}]", -1), found)


def candidates_of(text: Column, source: Column, explicit: Column, context: Column) -> Column:
    """The likely numbers of a text as candidates; ``context``, unless it is empty, takes the place of what stands around them."""
    given = cleaned_context(context)
    each = matches(text, lambda raw, around: candidate(cleaned_phone(raw), first_nonempty(given, around), source))
    # most texts have too few digits in a row for a number
    some = ascii_digits(text_or_empty(text)).rlike(CANDIDATE)
    return F.when(some, F.filter(each, lambda c: is_likely_phone(c["raw"], c["context"], explicit))).otherwise(F.array().cast(_CANDIDATES))


def candidates_in(text: Column, source: str, explicit: bool = False, context: Column | None = None) -> Column:
    return candidates_of(text, F.lit(source), F.lit(explicit), F.lit("") if context is None else context)


def distinct_candidates(values: Column) -> Column:
    """One candidate a key, at the place of its first."""
    return fold_by(F.filter(values, lambda c: phone_key(c["raw"]) != ""), lambda c: phone_key(c["raw"]), stronger_or_fuller)


def normalized_number(value: Column, source: Column | None = None) -> Column:
    """``+`` and digits where the country is known, else the digits."""
    shown = F.regexp_replace(_bare(utrim(text_or_empty(value))), "[^0-9+]", "")
    is_link = F.lit(False) if source is None else text_or_empty(source) == "whatsapp-link"

    def named(v: Column) -> Column:
        return let(
            F.struct(v.alias("v"), F.regexp_replace(v, r"\+", "").alias("d")),
            lambda x: F.when(x["d"] == "", "")
            .when(x["d"].rlike(f"^0{_EGYPT_PLAN}$"), F.concat(F.lit("+20"), F.substr(x["d"], F.lit(2))))
            .when(x["d"].rlike(f"^20{_EGYPT_PLAN}$"), F.concat(F.lit("+"), x["d"]))
            .when(is_link & ~F.startswith(x["d"], F.lit("0")) & (F.length(x["d"]) >= 8), F.concat(F.lit("+"), x["d"]))
            .when(F.startswith(x["v"], F.lit("00")) & (F.length(x["d"]) > 2), F.concat(F.lit("+"), F.substr(x["d"], F.lit(3))))
            .when(F.startswith(x["v"], F.lit("+")), F.concat(F.lit("+"), x["d"]))
            .otherwise(x["d"]),
        )

    return let(shown, named)


def number_identity(phone: Column) -> Column:
    """Under which stored numbers are the same; empty for one without digits."""
    return F.when(text_or_empty(phone["normalized"]) != "", phone["normalized"]).otherwise(normalized_number(phone["raw"]))


def normalized_phones(values: Column) -> Column:
    """Stored phones (raw, normalized, context, source) of candidates, one a number; empty context and source are null."""
    context = lambda c: F.left(collapse_blanks(text_or_empty(c["context"])), F.lit(STORED_CONTEXT))
    each = F.transform(values, lambda c: F.struct(utrim(text_or_empty(c["raw"])).alias("raw"), normalized_number(c["raw"], c["source"]).alias("normalized"), let(context(c), lambda x: F.nullif(x, F.lit(""))).alias("context"), let(utrim(text_or_empty(c["source"])), lambda x: F.nullif(x, F.lit(""))).alias("source")))
    return fold_by(F.filter(each, lambda p: p["normalized"] != ""), lambda p: p["normalized"], stronger_or_fuller)


def _is_whatsapp(p: Column) -> Column:
    return (p["scheme"] == "whatsapp") | urls.is_web(p) & let(p["hostname"], lambda h: urls.any_domain(h, dims.PLATFORM_DOMAINS["whatsapp"]))


def is_whatsapp_url(url: Column) -> Column:
    return urls.with_parts(url, _is_whatsapp)


def _recipient(p: Column) -> Column:
    """The digits of a link's number: of a parameter, else, for wa.me, of the path's first part."""
    first = F.regexp_extract(p["path"], "^/*([^/]*)", 1)
    given = F.coalesce(urls.value_of(p, "phone"), urls.value_of(p, "number"), F.lit(""))
    named = F.when(given != "", given).when(urls.domain_matches(p["hostname"], "wa.me"), first).otherwise("")
    return F.regexp_replace(named, "[^0-9]", "")


def whatsapp_number(url: Column) -> Column:
    """The digits that a WhatsApp link is for, 8 to 15 of them, or empty."""
    return urls.with_parts(url, lambda p: let(F.regexp_replace(_recipient(p), "^00", ""), lambda d: F.when(_is_whatsapp(p) & d.rlike("^[0-9]{8,15}$"), d).otherwise("")))


def recipient_of(p: Column) -> Column:
    return F.length(_recipient(p)) >= 8


def has_whatsapp_recipient(url: Column) -> Column:
    """Eight digits or more, in a parameter or, for wa.me, the path."""
    return urls.with_parts(url, recipient_of)


def whatsapp_numbers_in(value: Column) -> Column:
    """Numbers of the WhatsApp links inside an attribute's value."""
    found = F.regexp_extract_all(F.replace(value, F.lit("\\/"), F.lit("/")), F.lit(r"(?i)(?:https?://)?(?:wa\.me/|(?:api|web)\.whatsapp\.com/)[^\s\"'<>]+|whatsapp://[^\s\"'<>]+"), F.lit(0))
    absolute = F.transform(found, lambda u: F.when(u.rlike(r"(?i)^wa\.me/"), F.concat(F.lit("https://"), u)).otherwise(u))
    return F.filter(F.transform(absolute, whatsapp_number), lambda x: x != "")


def whatsapp_value(href: Column) -> Column:
    """What a WhatsApp link names when crawling, as it is written there, or empty."""
    named = lambda p: F.coalesce(urls.value_of(p, "phone"), F.lit(""))
    wa_me = lambda p: urls.domain_matches(p["hostname"], "wa.me")
    return urls.with_parts(href, lambda p: F.when(wa_me(p), F.regexp_replace(p["path"], "^/+|/+$", "")).when(urls.domain_matches(p["hostname"], "whatsapp.com") | (p["scheme"] == "whatsapp"), named(p)).otherwise(""))


def calling_number(value: Column) -> Column:
    """``+digits`` where the international form is known, else empty."""
    v = utrim(text_or_empty(value))
    path = lambda p: F.when(p["hostname"] == "wa.me", F.regexp_extract(p["path"], "^/*([^/]*)", 1))
    linked = F.regexp_replace(urls.with_parts(v, lambda p: first_nonempty(urls.value_of(p, "phone"), path(p))), "[^0-9]", "")

    def of(d: Column) -> Column:
        return F.when(F.startswith(d, F.lit("+")), d).when(F.startswith(d, F.lit("00")), F.concat(F.lit("+"), F.substr(d, F.lit(3)))).when(country_of_digits(d) != "", F.concat(F.lit("+"), d)).otherwise("")

    from_link = let(linked, lambda d: F.when(d != "", F.concat(F.lit("+"), F.regexp_replace(d, "^00", ""))).otherwise(""))
    return F.when(v.rlike("(?i)^https?:"), from_link).otherwise(let(F.regexp_replace(v, "[^0-9+]", ""), of))


def country_of_digits(d: Column) -> Column:
    """The country of a calling code; no code is a prefix of another."""
    table = constants(dims.CALLING_CODES)
    return F.coalesce(F.try_element_at(table, F.left(d, F.lit(3))), F.try_element_at(table, F.left(d, F.lit(2))), F.lit(""))


def unanimous_country(values: Column) -> Column:
    """The country of all numbers whose country is known, if it is one; else empty."""
    found = F.array_distinct(F.filter(F.transform(values, lambda v: country_of_digits(F.substr(calling_number(v), F.lit(2)))), lambda c: c != ""))
    return F.when(F.size(found) == 1, found[0]).otherwise("")


# Numbers of these countries' plans, without the calling code: shortest and longest. A valid number is one of such a length; one of
# another country has 7 to 15 digits with its code. Egypt's, and those of calling code 1, are checked against a pattern of their own.
NATIONAL_LENGTHS = {
    "SA": (8, 9), "AE": (8, 9), "KW": (8, 8), "QA": (8, 8), "BH": (8, 8), "OM": (8, 8), "JO": (8, 9), "LB": (7, 8), "IQ": (8, 10), "MA": (9, 9), "DZ": (8, 9), "TN": (8, 8),
    "LY": (8, 9), "SD": (9, 9), "SY": (8, 9), "YE": (7, 9), "PS": (8, 9), "IL": (8, 9), "TR": (10, 10), "IR": (10, 10), "IN": (10, 10), "PK": (9, 10), "CN": (9, 11),
    "JP": (9, 10), "KR": (8, 10), "GB": (9, 10), "FR": (9, 9), "DE": (6, 11), "ES": (9, 9), "IT": (6, 11), "NL": (9, 9), "BE": (8, 9), "CH": (9, 9), "PL": (9, 9), "RU": (10, 10),
    "AU": (9, 9), "BR": (10, 11), "MX": (10, 10),
}
_NANP = "[2-9][0-8][0-9][2-9][0-9]{6}"
_NANP_COUNTRIES = dict.fromkeys(dims.CANADA_AREA_CODES, "CA") | dims.ISLAND_AREA_CODES
_ALL_CODES = dims.CALLING_CODES | dims.MORE_CALLING_CODES


def valid_number(value: Column, region: str) -> Column:
    """(e164, region) of a number as written in a region, or null; ``region`` may be empty, for numbers with their country's code alone.

    Approximate where a plan is known by its lengths alone; a number whose calling code is not assigned is none.
    """
    own = {v: k for k, v in _ALL_CODES.items()}.get(region, "")
    table = constants(_ALL_CODES)
    written = first_fields(F.regexp_replace(utrim(percent_decoded(ascii_digits(text_or_empty(value)))), "(?i)^tel:", ""), "&?")

    def fits_own(n: Column) -> Column:
        return n.rlike(f"^{_EGYPT_PLAN}$") if region == "EG" else n.rlike(f"^{_NANP}$") if own == "1" else F.length(n).between(*NATIONAL_LENGTHS.get(region, (4, 14)))

    def national(d: Column) -> Column:
        """A number without a sign: the region's, with or without its trunk prefix 0, or with the region's code."""
        bare = F.regexp_replace(d, "^0", "")
        coded = F.substr(d, F.lit(len(own) + 1))
        return F.when(F.lit(own == ""), "").when(fits_own(bare), F.concat(F.lit(own), bare)).when(F.startswith(d, F.lit(own)) & fits_own(coded), d).otherwise("")

    def full(x: Column) -> Column:
        plus = F.startswith(x["v"], F.lit("+"))
        return F.when(plus, x["d"]).when(F.startswith(x["v"], F.lit("00")) & (F.length(x["d"]) >= 10), F.substr(x["d"], F.lit(3))).otherwise(national(x["d"]))

    def checked(n: Column) -> Column:
        sized = lambda k: F.struct(F.try_element_at(table, F.left(n, F.lit(k))).alias("iso"), F.substr(n, F.lit(k + 1)).alias("rest"))
        one = F.when(n.rlike("^[17]"), sized(1)).when(n.rlike("^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), sized(2)).otherwise(sized(3))

        def judged(c: Column) -> Column:
            iso = F.when(c["iso"] == "US", F.coalesce(F.try_element_at(constants(_NANP_COUNTRIES), F.left(c["rest"], F.lit(3))), F.lit("US"))).when((c["iso"] == "RU") & c["rest"].rlike("^[67]"), "KZ").otherwise(text_or_empty(c["iso"]))
            least, most = (F.try_element_at(constants({k: x[j] for k, x in NATIONAL_LENGTHS.items()}), text_or_empty(c["iso"])) for j in (0, 1))
            fits = F.length(n).between(7, 15) & F.length(c["rest"]).between(F.coalesce(least, F.lit(0)), F.coalesce(most, F.lit(15)))
            fits = F.when(c["iso"] == "EG", c["rest"].rlike(f"^{_EGYPT_PLAN}$")).when(c["iso"] == "US", c["rest"].rlike(f"^{_NANP}$")).otherwise(fits)
            return F.when(fits & n.rlike("^[1-9]") & c["iso"].isNotNull(), F.struct(F.concat(F.lit("+"), n).alias("e164"), iso.alias("region")))

        return let(one, judged)

    return let(F.struct(written.alias("v"), digits(written).alias("d")), lambda x: let(full(x), checked))


# Numbers in running text: no letter, digit, percent or currency sign touches them. Neighbours may have run into one, which a plus sign, a
# slash, a full stop, a lone dash or a wide gap parts, and any blank where that is not enough.
_EDGE = r"[A-Za-z\x{C0}-\x{24F}0-9%$€£¥]"
IN_TEXT = rf"(?:(?<!{_EDGE})|(?=\+))(?>(?:\+{_BETWEEN}*)?[0-9](?:[/+]?{_BETWEEN}*[/+]?[0-9]){{6,60}})(?!{_EDGE})"
_APART = r"(?=\+)|/|\.[ \t\x{A0}]+|[ \t\x{A0}]+-[ \t\x{A0}]+|[ \t\x{A0}]{2,}"
#: A number with a plus sign, up to the first later word of eight digits or more, and up to its last word.
_LED = [r"^(\+.*?)[ \t\x{A0}]+(?=(?:[^0-9 \t\x{A0}]*[0-9]){8})", r"^(\+.*[^ \t\x{A0}])[ \t\x{A0}]"]


#: Countries whose own numbers begin with a 0 wherever they are written without their country's code.
_TRUNK_ZERO = ["EG", "SA", "AE", "JO", "LB", "IQ", "MA", "DZ", "LY", "SD", "SY", "YE", "PS", "IL", "TR", "IR", "IN", "PK", "CN", "JP", "KR", "GB", "FR", "DE", "NL", "BE", "CH", "AU"]


def numbers_in(text: Column, region: str) -> Column:
    """What may be a number in running text: groups of texts, the first group the whole, the others its pieces, each with its parts.

    The first of a group is to be tried before the rest of it, and the whole before all pieces. Dates are empty, and so is what lacks
    the 0 that the region's own numbers begin with.
    """
    own = {v: k for k, v in _ALL_CODES.items()}.get(region, "")
    bare = f"^(?!0|{own})[1-9]" if region in _TRUNK_ZERO else r"\A\z"
    plain = ascii_digits(text_or_empty(text))
    long = lambda v: F.regexp_count(v, F.lit("[0-9]")) >= 7
    parted = lambda v, at: F.filter(F.split(v, at, -1), lambda x: long(x) & (x != v))
    pieces = lambda v: let(parted(v, _APART), lambda ps: F.when(F.size(ps) > 0, ps).otherwise(F.array(v)))
    groups = lambda v: F.concat(F.array(F.array(v)), F.transform(pieces(v), lambda p: F.concat(F.array(p), F.filter(F.array(*(F.regexp_extract(p, x, 1) for x in _LED)), long), parted(p, r"[ \t\x{A0}]+"))))
    each = F.transform(F.regexp_extract_all(plain, F.lit(IN_TEXT), F.lit(0)), groups)
    return F.transform(each, lambda gs: F.transform(gs, lambda g: F.transform(g, lambda x: F.when(x.rlike(bare) | looks_like_date(x), "").otherwise(x))))
