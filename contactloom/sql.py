"""The rules as SQL functions: ``register(spark)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from contactloom.functions import emails, html, links, phones, urls

#: Each name: its rule, as an expression of the argument ``x``.
RULES = {
    "host_for_url": urls.host_for_url,
    "url_problem": urls.url_problem,
    "normalized_url": urls.normalized_url,
    "comparable_url": urls.comparable_url,
    "country_of_host": urls.country_of_host,
    "phone_key": phones.phone_key,
    "cleaned_phone": phones.cleaned_phone,
    "normalized_number": phones.normalized_number,
    "looks_like_date": phones.looks_like_date,
    "whatsapp_number": phones.whatsapp_number,
    "calling_number": phones.calling_number,
    "normalized_email": emails.normalized_email,
    "emails_in": emails.emails_in,
    "social_platform": links.platform,
    "clean_social_url": links.clean_social_url,
}


def apply(df, name: str, column: str, to: str):
    """The table with a rule's value: for use beside SQL, where a rule's expression stays visible to the optimizer."""
    return df.withColumn(to, RULES[name](F.col(column)))


class _Elements:
    """The elements of a page that rules ask about, a row each."""

    def eval(self, page: str, url: str):
        read = html.read_page(page, url)
        for k, e in enumerate(read["elements"]):
            yield k, e["tag"], dict(e["attributes"]), read["buffer"][e["start"] : e["end"]], e["url"]


html_elements = F.udtf(_Elements, returnType="place int, tag string, attributes map<string,string>, text string, link string")


def register(spark: SparkSession) -> list[str]:
    """Registers ``html_page(html, url)`` and the table function ``html_elements(html, url)``; gives their names and those of the rules for ``apply``."""
    spark.udf.register("html_page", html.parsed)
    spark.udtf.register("html_elements", html_elements)
    return ["html_page", "html_elements", *RULES]
