"""From pages to leads: captured leads, one a page, and crawled leads, one a host.

The HTML is parsed once; all rules then work on the arrays in the page's row, and only the
crawled flavour shuffles, by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom import dims
from contactloom.functions import emails, html, links, phones, urls
from contactloom.functions.text import ascii_digits, collapse_blanks, first_nonempty, let, nonempty_distinct, text_or_empty, utrim
from contactloom.schemas import CSV_FIELDS

_WIDGET_TEXT = "WhatsApp contact button"
_ANCHOR_TEXT = "WhatsApp contact link"
_NUMBER_KEY = rf"(?i)(?:^|[-_:])(?:{'|'.join(dims.NUMBER_KEYS)})(?:$|[-_:])"
_LABELLED = rf"(?i)(?:{'|'.join(dims.NUMBER_KEYS)})[\"'\s:=\\]+(\+?[0-9](?:[\s().-]*[0-9]){{7,14}})"
_SIGNAL = r"(?i)whats[\s_-]*app|joinchat|wa\.me|whatsapp://"


def attribute(element: Column, name: str) -> Column:
    return text_or_empty(F.try_element_at(element["attributes"], F.lit(name)))


def is_contact_section(e: Column) -> Column:
    return e["tag"].isin(*html.SECTION_TAGS) | F.concat_ws(" ", attribute(e, "id"), attribute(e, "class")).rlike(html.SECTION_WORDS)


def _descriptor(e: Column) -> Column:
    return F.concat_ws(" ", attribute(e, "name"), attribute(e, "property"), attribute(e, "itemprop"))


def is_relevant_meta(e: Column) -> Column:
    return (e["tag"] == "meta") & (_descriptor(e).rlike(r"(?i)contact|description|email|mobile|phone|telephone|whats[\s-]*app") | phones.phone_cue(attribute(e, "content")))


def is_button(e: Column) -> Column:
    return (e["tag"] == "button") | (attribute(e, "role") == "button")


def is_link(e: Column) -> Column:
    return (e["tag"] == "a") & F.map_contains_key(e["attributes"], F.lit("href"))


def described(e: Column, text: Column) -> Column:
    return F.concat_ws(" ", attribute(e, "class"), attribute(e, "id"), attribute(e, "aria-label"), attribute(e, "title"), text)


def element_context(e: Column, text: Column) -> Column:
    """The element's words without the numbers in them."""
    words = F.array_join(nonempty_distinct(F.array(*(utrim(x) for x in (text, attribute(e, "aria-label"), attribute(e, "title"))))), " ")
    return phones.cleaned_context(F.regexp_replace(ascii_digits(words), phones.CANDIDATE, " "))


def anchors(page: Column) -> Column:
    """(url, href, text, described, context) of the page's links."""

    def of(e: Column) -> Column:
        return let(html.element_text(page, e), lambda text: F.struct(text_or_empty(e["url"]).alias("url"), utrim(attribute(e, "href")).alias("href"), text.alias("text"), described(e, text).alias("described"), element_context(e, text).alias("context")))

    return F.transform(F.filter(page["elements"], is_link), of)


# A text to be searched for numbers, or the element that has it: of which list they are, where they come from, whether the markup says that they are numbers, the
# context that takes the place of the text's own, what stands before its own, and whether the text is a number as it is.
def _searched(text: Column | None, source: str, *, element: Column | None = None, explicit: bool = False, context: Column | None = None, before: Column | None = None, whatsapp: bool = False, whole: bool = False) -> Column:
    blank = F.lit("")
    where = F.lit(None).cast("struct<start:int,end:int>") if element is None else F.struct(element["start"].alias("start"), element["end"].alias("end"))
    return F.struct((F.lit(None).cast("string") if text is None else text).alias("text"), where.alias("where"), F.lit(source).alias("source"), F.lit(explicit).alias("explicit"), (blank if context is None else context).alias("context"), (blank if before is None else before).alias("before"), F.lit(whatsapp).alias("whatsapp"), F.lit(whole).alias("whole"))


def _phone_texts(page: Column) -> Column:
    """Visible text, links, buttons, contact sections and meta tags, in that order."""
    elements = page["elements"]
    many = lambda e: e["digits"] >= phones.FEWEST_DIGITS

    def of_link(e: Column) -> Column:
        shown = F.filter(F.array(_searched(None, "anchor-text", element=e)), lambda _: many(e))
        tel = lambda href: F.array(_searched(F.substr(href, F.lit(5)), "tel-link", explicit=True, context=element_context(e, html.element_text(page, e))))
        return let(utrim(attribute(e, "href")), lambda href: F.when(href.rlike("(?i)^tel:"), F.concat(tel(href), shown)).otherwise(shown))

    each = lambda rule, one: F.transform(F.filter(elements, rule), one)
    return F.concat(
        F.array(_searched(page["lines"], "visible-text")),
        F.flatten(each(is_link, of_link)),
        each(lambda e: is_button(e) & many(e), lambda e: _searched(None, "button-text", element=e)),
        # a number and its context lie in one line, so lines that an enclosing section has give nothing new
        each(lambda e: is_contact_section(e) & ~e["within"] & many(e), lambda e: _searched(None, "visible-text", element=e)),
        each(is_relevant_meta, lambda e: _searched(attribute(e, "content"), "meta-tag", before=_descriptor(e))),
    )


def near_mentions(text: Column) -> Column:
    """Each mention of WhatsApp with what stands up to NEAR characters around it."""
    # a look behind finds its shortest match first: it is as long as there is text
    n = phones.NEAR
    around = rf"(?is)(?={phones.MENTION})(?<=(\A.{{0,{n - 1}}}|.{{{n}}}))({phones.MENTION})(?=(.{{0,{n}}}))"
    before, own, after = (F.regexp_extract_all(text, F.lit(around), F.lit(k)) for k in (1, 2, 3))
    some = F.transform(before, lambda x, k: F.concat(x, own[k], after[k]))
    return F.when(text.rlike(f"(?i){phones.MENTION}"), some).otherwise(F.array().cast("array<string>"))


def is_widget(e: Column) -> Column:
    """What may carry a WhatsApp number outside a link's target, and says so."""
    has = lambda name: F.map_contains_key(e["attributes"], F.lit(name))
    holds = lambda name, words: attribute(e, name).rlike(f"(?i){words}")
    button = attribute(e, "role") == "button"
    chosen = holds("class", "whatsapp|joinchat") | holds("id", "whatsapp|joinchat") | holds("aria-label", "whatsapp") | has("data-whatsapp") | has("data-wa-number") | button & (has("data-telephone") | has("data-phone")) | has("data-settings") | holds("onclick", r"whatsapp|wa\.me")
    pairs = F.map_entries(e["attributes"])
    signal = F.exists(pairs, lambda x: F.concat(x["key"], F.lit(" "), x["value"]).rlike(_SIGNAL))
    named = F.exists(pairs, lambda x: x["key"].rlike(_NUMBER_KEY))
    return chosen & (signal | (F.lower(attribute(e, "role")) == "button") & named)


def _widget_texts(page: Column, e: Column) -> Column:
    """A widget's texts to search, attribute by attribute: values of number-like names, settings, and links inside."""
    own_context = let(element_context(e, html.element_text(page, e)), lambda c: first_nonempty(c, F.lit(_WIDGET_TEXT)))
    piece = lambda text, number, links_too: F.struct(text.alias("text"), number.alias("number"), links_too.alias("linked"))
    yes, no = F.lit(True), F.lit(False)

    def settings(v: Column) -> Column:
        walked = F.transform(e["settings"], lambda s: piece(s["value"], s["key"].rlike(_NUMBER_KEY), yes))
        return F.coalesce(walked, F.concat(F.transform(F.regexp_extract_all(v, F.lit(_LABELLED), F.lit(1)), lambda x: piece(x, yes, no)), F.array(piece(v, no, yes))))

    def of(x: Column) -> Column:
        own, rest = F.array(piece(x["value"], x["key"].rlike(_NUMBER_KEY), no)), F.array(piece(x["value"], no, yes))
        return F.when(x["key"].isin(dims.SETTINGS_ATTRIBUTES), F.concat(own, settings(x["value"]), rest)).otherwise(F.concat(own, rest))

    def searched(p: Column, context: Column) -> Column:
        number = F.filter(F.array(_searched(p["text"], "whatsapp-link", explicit=True, context=context, whatsapp=True)), lambda _: p["number"])
        linked = F.transform(F.filter(phones.whatsapp_numbers_in(p["text"]), lambda _: p["linked"]), lambda n: _searched(n, "whatsapp-link", context=context, whatsapp=True, whole=True))
        return F.concat(number, linked)

    pieces = F.flatten(F.transform(F.map_entries(e["attributes"]), of))
    # one context for all pieces
    return let(own_context, lambda context: F.flatten(F.transform(pieces, lambda p: searched(p, context))))


def _whatsapp_texts(page: Column, judged: Column) -> Column:
    """WhatsApp links, text near a mention, and widgets, in that order; ``judged``: the page's links, judged."""
    own = F.filter(judged, lambda a: (a["platform"] == "whatsapp") & ~a["shares"] & ~a["excluded"])
    from_links = F.transform(own, lambda a: _searched(phones.whatsapp_number(a["href"]), "whatsapp-link", context=first_nonempty(a["context"], F.lit(_ANCHOR_TEXT)), whatsapp=True, whole=True))
    from_text = F.transform(near_mentions(page["lines"]), lambda x: _searched(x, "visible-text", whatsapp=True))
    return F.concat(from_links, from_text, F.flatten(F.transform(F.filter(page["elements"], is_widget), lambda e: _widget_texts(page, e))))


_FOUND = "array<struct<raw:string,context:string,source:string,whatsapp:boolean>>"


def _numbers_of(page: Column, texts: Column) -> Column:
    """The likely numbers of texts, as candidates of one of the two lists. An element's text is cut here, one at a time."""

    def of(t: Column) -> Column:
        whole = F.array(phones.candidate(phones.cleaned_phone(t["text"]), phones.cleaned_context(t["context"]), t["source"]))
        text = F.coalesce(t["text"], html.element_text(page, t["where"]))
        found = F.when(t["whole"], whole).otherwise(let(text, lambda x: phones.candidates_of(x, t["source"], t["explicit"], t["context"])))
        context = lambda c: F.when(t["before"] != "", phones.cleaned_context(F.concat(t["before"], F.lit(" "), c["context"]))).otherwise(c["context"])
        return F.transform(found, lambda c: F.struct(c["raw"], context(c).alias("context"), c["source"], t["whatsapp"].alias("whatsapp")))

    return F.filter(F.flatten(F.transform(F.filter(texts, lambda t: (text_or_empty(t["text"]) != "") | t["where"].isNotNull()), of)), lambda c: phones.phone_key(c["raw"]) != "")


def widget_numbers(page: Column) -> Column:
    """The numbers of a page's WhatsApp widgets, each once."""
    texts = F.flatten(F.transform(F.filter(page["elements"], is_widget), lambda e: _widget_texts(page, e)))
    return F.transform(phones.distinct_candidates(_numbers_of(page, texts)), lambda c: c["raw"])


def page_emails(page: Column) -> Column:
    """Visible text, links, buttons, contact sections and meta tags; then mailto links and ``data-email``."""
    elements = page["elements"]
    each = lambda rule, one: F.transform(F.filter(elements, rule), one)
    shown_text = lambda e: html.element_text(page, e)
    # no element's text is cut on a page that holds no address, however it may be written
    low = F.lower(page["buffer"])
    spelt = F.contains(low, F.lit("dot")) & F.contains(low, F.lit("at"))
    some = F.contains(low, F.lit("@")) | spelt
    # only an address in words may go over several lines
    sections = lambda e: is_contact_section(e) & (~e["within"] | spelt)
    parts = F.when(some, F.concat(each(is_link, shown_text), each(is_button, shown_text), each(sections, shown_text))).otherwise(F.array().cast("array<string>"))
    shown = F.concat(F.array(page["lines"]), parts, each(is_relevant_meta, lambda e: attribute(e, "content")))
    return emails.captured_emails(F.concat(shown, emails.mailto_texts(each(is_link, lambda e: attribute(e, "href"))), F.transform(elements, lambda e: attribute(e, "data-email"))))


def parse_pages(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The table with ``page``. Filter first: the parse is the costly step."""
    return pages.withColumn("page", html.parsed(F.col(html_col), F.col(url_col)))


def captured(pages: DataFrame, captured_at: str, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A lead for each web page, of candidates as found; ``captured_at`` is ISO text."""
    page, url = F.col("page"), F.col(url_col)
    rows = parse_pages(pages.where(urls.is_web_url(url)), url_col=url_col, html_col=html_col).withColumn("links", links.judged(anchors(page), url))
    # each text is searched once, by one expression
    found = rows.withColumn("found", _numbers_of(page, F.concat(_phone_texts(page), _whatsapp_texts(page, F.col("links")))))
    # phones are those of the first list, then the others once more
    own = lambda wanted: F.transform(F.filter("found", lambda c: c["whatsapp"] == wanted), lambda c: c.dropFields("whatsapp"))
    found = found.withColumn("whatsapp_found", phones.distinct_candidates(own(True)))
    return found.select(
        F.sha2(url, 256).alias("id"),
        utrim(page["title"]).alias("page_title"),
        url.alias("source_url"),
        urls.hostname(url).alias("hostname"),
        F.lit(captured_at).alias("captured_at"),
        F.lit(None).cast("string").alias("last_updated_at"),
        phones.distinct_candidates(F.concat(own(False), F.col("whatsapp_found"))).alias("phones"),
        F.col("whatsapp_found").alias("whatsapp"),
        page_emails(page).alias("emails"),
        links.social_links(F.col("links")).alias("social_links"),
        links.external_links(F.col("links"), url).alias("external_links"),
    )


def normalize_leads(leads: DataFrame) -> DataFrame:
    """Captured leads with their URL and every list normalized; external links without the page itself and the profiles."""
    leads = leads.withColumn("source_url", first_nonempty(urls.normalized_url(F.col("source_url")), utrim(text_or_empty(F.col("source_url")))))
    social = links.normalized_social(F.col("social_links"))
    cleaned = leads.select(
        "id",
        utrim(text_or_empty(F.col("page_title"))).alias("page_title"),
        "source_url",
        first_nonempty(urls.hostname(F.col("source_url")), utrim(text_or_empty(F.col("hostname")))).alias("hostname"),
        "captured_at",
        "last_updated_at",
        phones.normalized_phones(F.col("phones")).alias("phones"),
        phones.normalized_phones(F.col("whatsapp")).alias("whatsapp"),
        emails.normalized_emails(F.col("emails")).alias("emails"),
        social.alias("social_links"),
        links.normalized_external(F.col("external_links")).alias("external_links"),
    )
    kept = F.filter(links.external_without_social(F.col("external_links"), F.col("social_links")), lambda e: e["url"] != F.col("source_url"))
    return cleaned.withColumn("external_links", kept)


def jsonld_text(page: Column) -> Column:
    """The JSON-LD blocks that parse, written again without escapes."""
    return F.array_join(F.filter(F.transform(page["jsonld"], lambda x: F.to_json(F.try_parse_json(x))), lambda x: x.isNotNull()), " ")


def crawled(pages: DataFrame, *, as_of: str, source: str = "google dorks", default_country: str = "EG", order_col: str = "page_id", url_col: str = "url", html_col: str = "html", error_col: str | None = None, host_col: str | None = None, website_col: str | None = None) -> DataFrame:
    """One flat lead a host, of all its pages in the order of ``order_col``. ``as_of`` is the date's text.

    A page's host and website are its URL's, or, after redirects, those of the seed, in ``host_col`` and ``website_col``.
    A value that many pages repeat, an error too, counts once, at its first place; a host's row gathers its distinct values only.
    """
    url, page, region = F.col(url_col), F.col("page"), default_country.upper()
    host = F.col(host_col) if host_col else urls.host_for_url(url)
    website = F.col(website_col) if website_col else url
    rows = parse_pages(pages.withColumn("_host", host).where("_host <> ''"), url_col=url_col, html_col=html_col)
    hrefs = F.transform(F.filter(page["elements"], is_link), lambda e: F.struct(attribute(e, "href").alias("href"), e["url"].alias("url")))
    tel = F.transform(F.filter(hrefs, lambda h: h["href"].rlike("(?i)^tel:")), lambda h: h["href"])
    wa = F.filter(F.transform(hrefs, lambda h: phones.whatsapp_value(h["href"])), lambda x: x != "")
    text = F.concat_ws(" ", page["text"], jsonld_text(page))
    # WhatsApp numbers first, then those of links, then those of the text; each is judged by one expression
    named = lambda values, part: F.transform(values, lambda v: F.struct(v.alias("v"), F.lit(part).alias("part")))
    alone = lambda values: F.transform(values, lambda v: F.array(F.array(v)))
    written = F.concat(named(alone(wa), 0), named(F.concat(alone(tel), phones.numbers_in(text, region)), 1))
    best = lambda ns: F.when(ns[0].isNotNull(), F.slice(ns, 1, 1)).otherwise(F.filter(ns, lambda n: n.isNotNull()))

    def judged(x: Column) -> Column:
        found = F.transform(x["v"], lambda group: F.transform(group, lambda v: phones.valid_number(v, region)))
        kept = let(found, lambda gs: F.when(gs[0][0].isNotNull(), gs[0]).otherwise(F.flatten(F.transform(F.slice(gs, F.lit(2), F.size(gs)), best))))
        return F.transform(kept, lambda n: F.struct(n.alias("n"), x["part"].alias("part")))

    numbers = F.flatten(F.transform(written, judged))
    each = rows.select(
        "_host",
        F.col(order_col).alias("_seq"),
        website.alias("_url"),
        (F.col(error_col) if error_col else F.lit(None).cast("string")).alias("_error"),
        numbers.alias("_numbers"),
        emails.crawled_emails(page["text"], F.transform(hrefs, lambda h: h["href"])).alias("_mail"),
        F.filter(F.transform(hrefs, lambda h: F.struct(links.crawl_kind(h["url"]).alias("kind"), links.clean_social_url(h["url"]).alias("url"))), lambda s: s["url"].isNotNull()).alias("_social"),
    )
    # the first place of each of a host's values, then only those are gathered; WhatsApp numbers are before all others
    none = F.lit(None).cast("string")

    def entries(kind: str, part: int, values: Column, value, more, key) -> Column:
        return F.transform(values, lambda x, k: F.struct(F.lit(kind).alias("kind"), value(x).alias("value"), key(x).alias("key"), F.lit(part).alias("part"), k.alias("at"), more(x).alias("more")))

    nothing = lambda _: none
    number = (lambda x: x["n"]["e164"], lambda x: x["n"]["region"], lambda x: x["n"]["region"])
    of_part = lambda k: F.filter("_numbers", lambda x: x["part"] == k)
    every = F.concat(
        entries("page", 0, F.array("_url"), nothing, nothing, nothing),
        entries("error", 0, F.filter(F.array("_error"), lambda x: x.isNotNull()), lambda x: x, nothing, nothing),
        entries("number", 0, of_part(0), *number),
        entries("number", 1, of_part(1), *number),
        entries("mail", 0, F.col("_mail"), lambda x: x, nothing, nothing),
        entries("social", 0, F.col("_social"), lambda s: s["url"], lambda s: s["kind"], nothing),
    )
    exploded = each.select("_host", "_seq", "_url", F.explode(every).alias("v")).select("_host", "_seq", "_url", "v.*")
    first = exploded.groupBy("_host", "kind", "value", "key").agg(F.min(F.struct("part", "_seq", "_url", "at", "more")).alias("first"))
    hosts = first.groupBy("_host").agg(F.sort_array(F.collect_list(F.struct("kind", "first", "value"))).alias("p"))
    own = lambda kind: F.filter("p", lambda x: x["kind"] == kind)
    values = lambda kind: F.transform(own(kind), lambda x: x["value"])
    lists = hosts.select(
        "_host",
        own("page")[0]["first"]["_url"].alias("url"),
        F.array_join(values("error"), " ").alias("error"),
        F.transform(own("number"), lambda x: F.struct(x["value"].alias("e164"), x["first"]["more"].alias("region"))).alias("numbers"),
        values("mail").alias("mail"),
        F.transform(own("social"), lambda x: F.struct(x["first"]["more"].alias("kind"), x["value"].alias("url"))).alias("social"),
    )
    first_social = text_or_empty(F.get(F.filter("social", lambda s: s["kind"] == "instagram"), F.lit(0))["url"])
    with_first = lists.withColumn("social_url", first_social)
    rest = lambda values: F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    note = lambda label, values: F.when(F.size(values) > 0, F.concat(F.lit(label + ": "), F.array_join(values, " | ")))
    others = F.transform(F.filter("social", lambda s: s["url"] != F.col("social_url")), lambda s: F.concat(s["kind"], F.lit(": "), s["url"]))
    notes = F.concat_ws("; ", note("other phones", rest(F.transform("numbers", lambda n: n["e164"]))), note("other emails", rest(F.col("mail"))), note("other socials", others), F.when(F.col("error") != "", F.concat(F.lit("crawl_error: "), F.col("error"))))
    phone = text_or_empty(F.get("numbers", F.lit(0))["e164"])
    country = first_nonempty(text_or_empty(F.get("numbers", F.lit(0))["region"]), urls.country_of_host(F.col("_host")), F.lit(region))
    return with_first.select(F.col("_host").alias("name"), F.col("_host").alias("company_name"), phone.alias("phone"), phone.alias("whatsapp"), text_or_empty(F.get("mail", F.lit(0))).alias("email"), F.col("url").alias("website"), "social_url", country.alias("country"), F.lit(source).alias("source"), notes.alias("notes"), F.lit(as_of).alias("date")).select(*CSV_FIELDS)


def short_error(kind: Column, message: Column) -> Column:
    return F.left(collapse_blanks(F.concat(kind, F.lit(": "), message)), F.lit(300))


def useful_values(lead: DataFrame) -> Column:
    """How many values a lead has; one without any is not worth keeping."""
    return sum((F.size(c) for c in ("whatsapp", "emails", "social_links", "external_links")), F.size("phones"))


def with_manual_number(leads: DataFrame, source_url: str, typed: str) -> DataFrame:
    """The leads, with a number typed in for one of them unless it holds more or less than one, or the lead has it."""
    found = phones.candidates_in(F.lit(typed), "unknown", True)
    new = F.struct(F.lit(typed).alias("raw"), phones.normalized_number(F.lit(typed)).alias("normalized"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("string").alias("source"))
    fits = (F.col("source_url") == source_url) & (F.size(found) == 1) & ~F.exists("phones", lambda p: p["normalized"] == phones.normalized_number(F.lit(typed)))
    return leads.withColumn("phones", F.when(fits, F.concat("phones", F.array(new))).otherwise(F.col("phones")))


def first_page_per_host(pages: DataFrame, *, order_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The first page of each host, with ``host``; combined before the shuffle, however many pages a host has."""
    rows = pages.withColumn("host", urls.host_for_url(F.col(url_col)))
    first = rows.groupBy("host").agg(F.min_by(F.struct(*pages.columns), F.col(order_col)).alias("row"))
    return first.select("row.*", "host")
