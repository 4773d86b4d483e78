"""Counts, search and paging over the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions.text import text_or_empty

PAGE = 50


def kpis(leads: DataFrame) -> DataFrame:
    """One row: leads, phones, WhatsApp numbers, e-mail addresses, profiles."""
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
    return leads.agg(F.count("*").alias("leads"), total("phones").alias("phones"), total("whatsapp").alias("whatsapp"), total("emails").alias("emails"), total("social_links").alias("social_links"))


def captured_ms(captured_at: Column) -> Column:
    """Milliseconds, 0 for a time that can't be read."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(captured_at)), F.lit(0))


def newest_first(leads: DataFrame) -> list[Column]:
    return [captured_ms(F.col("captured_at")).desc(), F.col("seq").asc()]


def page(leads: DataFrame, size: int = PAGE, number: int = 0) -> DataFrame:
    """The leads of a page, newest first."""
    return leads.orderBy(*newest_first(leads)).offset(size * number).limit(size)


def search_text() -> Column:
    phone = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(" ", p["raw"], p["normalized"], p["context"], p["source"])), " ")
    social = F.array_join(F.transform("social_links", lambda s: F.concat_ws(" ", s["platform"], s["url"])), " ")
    external = F.array_join(F.transform("external_links", lambda e: F.concat_ws(" ", e["url"], e["text"])), " ")
    return F.lower(F.concat_ws(" ", text_or_empty(F.col("page_title")), "source_url", "hostname", phone("phones"), phone("whatsapp"), F.array_join("emails", " "), social, external))


def search(leads: DataFrame, terms: str) -> DataFrame:
    """Leads that hold every term somewhere; no terms: all leads.

    A lead's text comes out of a generator: it is made once, whatever the terms, and no filter on it is written into the rules that the lead comes from.
    """
    words = [F.lit(w) for w in terms.lower().split()]
    if not words:
        return leads
    shown = leads.select("*", F.explode(F.array(search_text())).alias("_shown"))
    return shown.where(F.forall(F.array(*words), lambda t: F.contains("_shown", t))).drop("_shown")
