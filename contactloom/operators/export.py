"""Exports: flat rows, and the CSV, JSON and text documents, written by Spark as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions import links, phones, urls
from contactloom.functions.text import first_nonempty, let, nonempty_distinct, text_or_empty, utrim
from contactloom.operators.store import cleared, numbered
from contactloom.schemas import EXPORT_FIELDS

SOURCE = "chrome extension"
BOM = "\ufeff"
#: Title of a text document, and how its file's name begins.
TITLE, PREFIX = "LEAD COLLECTION", "leads"
RULE = "=" * 50


class NothingToExport(ValueError):
    """The store is empty: no file is written."""


def phone_value(p: Column) -> Column:
    return first_nonempty(text_or_empty(p["normalized"]), text_or_empty(p["raw"]))


def phone_both(p: Column) -> Column:
    """``raw (normalized)``, or the one that there is, for a single lead."""
    both = (text_or_empty(p["raw"]) != "") & (text_or_empty(p["normalized"]) != "") & (p["raw"] != p["normalized"])
    return F.when(both, F.concat(p["raw"], F.lit(" ("), p["normalized"], F.lit(")"))).otherwise(phone_value(p))


def phone_provenance(p: Column) -> Column:
    facts = F.concat_ws(", ", F.when(text_or_empty(p["source"]) != "", F.concat(F.lit("source="), p["source"])), F.when(text_or_empty(p["context"]) != "", F.concat(F.lit("context="), p["context"])))
    return F.when(facts != "", F.concat(phone_value(p), F.lit(" ("), facts, F.lit(")")))


def iso_seconds(value: Column, otherwise: Column) -> Column:
    """A time to the second; ``otherwise`` in place of one that can't be read. The session's time zone is UTC."""
    shown = lambda v: F.date_format(F.try_to_timestamp(v), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.coalesce(shown(value), shown(otherwise), otherwise)


def _rest(values: Column) -> Column:
    return F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))


def flat_rows(leads: DataFrame) -> DataFrame:
    """The exported row of each lead, with ``seq``."""
    values = lambda c: F.filter(F.transform(c, phone_value), lambda x: x != "")
    rows = leads.withColumn("_phones", values("phones")).withColumn("_whatsapp", values("whatsapp"))
    rows = rows.withColumn("_link", text_or_empty(F.get(F.filter("social_links", lambda s: s["platform"] == "whatsapp"), F.lit(0))["url"]))
    whatsapp = first_nonempty(text_or_empty(F.get("_whatsapp", F.lit(0))), F.col("_link"))
    used = F.when(F.size("_whatsapp") == 0, F.col("_link")).otherwise("")
    candidates = F.filter("social_links", lambda s: (s["url"] != "") & (s["url"] != used))
    primary = F.coalesce(F.get(F.filter(candidates, lambda s: s["platform"] == "instagram"), F.lit(0))["url"], F.get(candidates, F.lit(0))["url"], F.lit(""))
    rows = rows.withColumn("_primary", primary)
    note = lambda label, value: F.when(text_or_empty(value) != "", F.concat(F.lit(label + ": "), value))
    listed = lambda label, v: note(label, F.array_join(v, " | "))
    details = lambda c: F.filter(F.transform(c, phone_provenance), lambda x: x.isNotNull())
    other_social = F.filter(F.transform(F.filter("social_links", lambda s: (s["url"] != F.col("_primary")) & (s["url"] != used)), links.social_line), lambda x: x != "")
    whatsapp_urls = F.transform(F.filter("social_links", lambda s: s["platform"] == "whatsapp"), lambda s: s["url"])
    domain = urls.lead_domain(F.col("hostname"), F.col("source_url"))
    notes = F.concat_ws(
        "; ",
        note("page title", utrim(F.col("page_title"))),
        note("captured at", utrim(F.col("captured_at"))),
        note("last updated at", utrim(F.col("last_updated_at"))),
        listed("other phones", _rest(F.col("_phones"))),
        listed("other WhatsApp", _rest(F.col("_whatsapp"))),
        listed("phone details", details("phones")),
        listed("WhatsApp details", details("whatsapp")),
        listed("other emails", _rest(F.col("emails"))),
        listed("other socials", other_social),
        listed("external links", F.transform("external_links", links.external_line)),
    )
    out = {
        "name": domain,
        "company_name": domain,
        "phone": text_or_empty(F.get("_phones", F.lit(0))),
        "whatsapp": whatsapp,
        "email": text_or_empty(F.get("emails", F.lit(0))),
        "website": utrim(text_or_empty(F.col("source_url"))),
        "social_url": F.col("_primary"),
        "country": phones.unanimous_country(F.concat("_phones", "_whatsapp", whatsapp_urls)),
        "source": F.lit(SOURCE),
        "notes": notes,
    }
    return rows.select(*(out[c].alias(c) for c in EXPORT_FIELDS), "seq")


def csv_value(value: Column) -> Column:
    v = text_or_empty(value)
    return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_lines(rows: DataFrame, fields: list[str] = EXPORT_FIELDS) -> DataFrame:
    """(seq, line); the header has seq -1."""
    head = rows.sparkSession.createDataFrame([(-1, ",".join(fields))], "seq long, line string")
    return head.unionByName(rows.select(F.col("seq").cast("long").alias("seq"), F.concat_ws(",", *(csv_value(F.col(f)) for f in fields)).alias("line")))


def list_lines(values: Column) -> Column:
    shown = F.filter(values, lambda x: text_or_empty(x) != "")
    return F.when(F.size(shown) == 0, F.lit("- None")).otherwise(F.array_join(F.transform(shown, lambda x: F.concat(F.lit("- "), x)), "\n"))


def _section(title: str, values: Column) -> Column:
    return F.concat(F.lit(f"{title}\n"), list_lines(values))


def lead_text() -> Column:
    """A single lead as text."""
    shown = lambda label, c, empty: F.concat(F.lit(f"{label}: "), first_nonempty(utrim(text_or_empty(F.col(c))), F.lit(empty)))
    head = F.concat_ws("\n", shown("Page Title", "page_title", "Untitled page"), shown("Source URL", "source_url", "None"), shown("Captured At", "captured_at", "Unknown"))
    return F.concat_ws(
        "\n\n",
        head,
        _section("Phones", F.transform("phones", phone_both)),
        _section("WhatsApp", F.transform("whatsapp", phone_both)),
        _section("Emails", F.col("emails")),
        _section("Social Links", F.transform("social_links", links.plain_social_line)),
        _section("External Links", F.transform("external_links", links.external_line)),
    )


def text_blocks(leads: DataFrame, exported_at: str) -> DataFrame:
    """(seq, line): a block for each lead, numbered from 1 in the order of ``seq``."""
    shown = lambda label, value: F.concat(F.lit(f"{label}:\n"), value)
    plain = lambda c, empty: first_nonempty(utrim(text_or_empty(F.col(c))), F.lit(empty))
    body = F.concat_ws(
        "\n\n",
        shown("Page Title", plain("page_title", "Untitled page")),
        shown("Source URL", plain("source_url", "None")),
        shown("Hostname", plain("hostname", "None")),
        shown("Captured At", iso_seconds(F.col("captured_at"), F.lit(exported_at))),
        _section("Phone Numbers:", F.transform("phones", phone_value)),
        _section("WhatsApp:", F.transform("whatsapp", phone_value)),
        _section("Emails:", F.col("emails")),
        _section("Social Links:", F.transform("social_links", links.social_line)),
        _section("External Links:", F.transform("external_links", links.external_line)),
    )
    framed = lambda x: F.concat(F.lit(RULE + "\n"), x, F.lit("\n" + RULE))
    block = F.concat_ws("\n\n", framed(F.concat(F.lit("LEAD "), F.col("index").cast("string"))), body, framed(F.lit("END LEAD")))
    return numbered(leads).select(F.col("seq").cast("long").alias("seq"), block.alias("line"))


def text_header(n: int, exported_at: str, title: str = TITLE) -> Column:
    return F.concat(F.lit(f"{title}\nExported At: "), iso_seconds(F.lit(exported_at), F.lit(exported_at)), F.lit(f"\nTotal Leads: {n}"))


def _ends(leads: DataFrame) -> tuple[int, int, int]:
    """Number of leads, and the least and greatest ``seq``."""
    facts = leads.agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last")).first()
    return facts["n"], facts["first"] or 0, facts["last"] or 0


def text_document(leads: DataFrame, exported_at: str, title: str = TITLE) -> DataFrame:
    """(seq, line): the header, then the blocks; ``write_lines`` puts an empty line between them."""
    n, first, _ = _ends(leads)
    head = leads.sparkSession.range(1).select(F.lit(first - 1).cast("long").alias("seq"), text_header(n, exported_at, title).alias("line"))
    blocks = text_blocks(leads, exported_at).select("seq", F.concat(F.lit("\n"), "line").alias("line"))
    return head.unionByName(blocks)


#: Texts that are their own JSON but for the quotes.
_JSON_PLAIN = r"\A[ !#-\[\]-~]*\z"


def _json_quoted(value: Column) -> Column:
    """A string as JSON, null for null; only one that has something to escape, or is not ASCII, goes through a JSON writer."""
    written = let(F.to_json(F.array(value)), lambda x: F.substr(x, F.lit(2), F.length(x) - 2))
    return F.when(value.isNotNull(), F.when(value.rlike(_JSON_PLAIN), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(written))


def _json_object(fields: dict[str, Column], indent: int, optional: tuple[str, ...] = ()) -> Column:
    """Already written values under their names, two spaces deeper; ``optional`` ones are left out where they are null."""
    pad = " " * (indent + 2)
    # a null pair is left out
    pairs = [F.concat(F.lit(f'{pad}"{k}": '), v if k in optional else F.coalesce(v, F.lit("null"))) for k, v in fields.items()]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *pairs), F.lit("\n" + " " * indent + "}"))


def _json_list(values: Column, written: Callable[[Column], Column], indent: int) -> Column:
    """The values, each written once; null is an empty list."""
    pad = " " * (indent + 2)
    return F.when(F.size(values) > 0, F.concat(F.lit(f"[\n{pad}"), F.array_join(F.transform(values, written), f",\n{pad}"), F.lit("\n" + " " * indent + "]"))).otherwise("[]")


def json_lead(indent: int = 4) -> Column:
    """A lead as an indented JSON object; the time of its last update, and a number's context and source, only where there are any."""
    each = lambda c, names, optional=(): _json_list(F.col(c), lambda x: _json_object({n: _json_quoted(x[n]) for n in names}, indent + 4, optional), indent + 2)
    number = (("raw", "normalized", "context", "source"), ("context", "source"))
    fields = {
        "id": _json_quoted(F.col("id")),
        "pageTitle": _json_quoted(F.col("page_title")),
        "sourceUrl": _json_quoted(F.col("source_url")),
        "hostname": _json_quoted(F.col("hostname")),
        "capturedAt": _json_quoted(F.col("captured_at")),
        "phones": each("phones", *number),
        "whatsapp": each("whatsapp", *number),
        "emails": _json_list(F.col("emails"), lambda x: F.coalesce(_json_quoted(x), F.lit("null")), indent + 2),
        "socialLinks": each("social_links", ("platform", "url")),
        "externalLinks": each("external_links", ("url", "text", "type")),
        "lastUpdatedAt": _json_quoted(F.col("last_updated_at")),
    }
    return _json_object(fields, indent, ("lastUpdatedAt",))



def json_document(leads: DataFrame, exported_at: str) -> DataFrame:
    """(seq, line): the collection as one indented JSON object, a lead a row; ``write_lines`` puts the rows in order, however many they are."""
    n, first, last = _ends(leads)
    spark = leads.sparkSession
    shown = leads.select(F.col("seq").cast("long").alias("seq"), F.concat(F.lit("    "), json_lead(), F.when(F.col("seq") == last, "").otherwise(",")).alias("line"))
    at = iso_seconds(F.lit(exported_at), F.lit(exported_at))
    head = F.concat(F.lit('{\n  "exportedAt": "'), at, F.lit(f'",\n  "totalLeads": {n},\n  "leads": ' + ("[" if n else "[]")))
    end = [(first - 1, 0), (last + 1, 1)]
    ends = spark.createDataFrame(end, "seq long, k int").select("seq", F.when(F.col("k") == 0, head).otherwise(F.lit("  ]\n}" if n else "}")).alias("line"))
    return shown.unionByName(ends)


def file_name(extension: str, at: Column, prefix: str = PREFIX) -> Column:
    return F.concat(F.lit(prefix + "-"), F.date_format(at, "yyyy-MM-dd-HHmm"), F.lit("." + extension))


def write_lines(lines: DataFrame, path: str, *, line_end: str = "\n", bom: bool = False) -> None:
    """Files of lines in the order of ``seq``, in as many parts as Spark makes; the first begins with the mark."""
    first = F.when(F.col("seq") == lines.agg(F.min("seq").alias("m")).first()["m"], F.concat(F.lit(BOM), "line")).otherwise(F.col("line")) if bom else F.col("line")
    lines.orderBy("seq").select(first.alias("value")).write.option("lineSep", line_end).text(path)


#: Line ends of each kind of document, and whether its first file begins with the byte-order mark.
KINDS = {"csv": ("\r\n", True), "txt": ("\n", True), "json": ("\n", False)}


def exported(leads: DataFrame, kind: str, path: str, exported_at: str, *, clear: bool = False, title: str = TITLE) -> DataFrame:
    """Writes the collection as ``csv``, ``txt`` or ``json`` and gives the store to keep: the same leads, or none (``clear``).

    An empty store is no document: nothing is written and NothingToExport is raised.
    """
    if leads.limit(1).count() == 0:
        raise NothingToExport("there are no stored leads to export")
    made = {"csv": lambda: csv_lines(flat_rows(leads)), "txt": lambda: text_document(leads, exported_at, title), "json": lambda: json_document(leads, exported_at)}[kind]()
    end, bom = KINDS[kind]
    write_lines(made, path, line_end=end, bom=bom)
    return cleared(leads) if clear else leads


def copied(values: Column) -> Column:
    """Text for the clipboard: trimmed values, each once, a line each."""
    return F.array_join(nonempty_distinct(F.transform(values, utrim)), "\n")


def copied_phones(values: Column) -> Column:
    return copied(F.transform(values, phone_value))


def copied_links(values: Column) -> Column:
    """Of social or external links: their URLs."""
    return copied(F.transform(values, lambda x: x["url"]))
