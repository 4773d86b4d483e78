"""The shapes of leads, and the columns of the flat tables."""

from __future__ import annotations

from pyspark.sql import types as T

PHONE = "struct<raw:string,normalized:string,context:string,source:string>"
CANDIDATE = "struct<raw:string,context:string,source:string>"
SOCIAL = "struct<platform:string,url:string>"
EXTERNAL = "struct<url:string,text:string,type:string>"
LEAD = f"id string, page_title string, source_url string, hostname string, captured_at string, last_updated_at string, phones array<{PHONE}>, whatsapp array<{PHONE}>, emails array<string>, social_links array<{SOCIAL}>, external_links array<{EXTERNAL}>"
LEAD_FIELDS = [f.split()[0] for f in ("id x", "page_title x", "source_url x", "hostname x", "captured_at x", "last_updated_at x", "phones x", "whatsapp x", "emails x", "social_links x", "external_links x")]

#: Columns of an exported row; a crawled row has the date as well.
EXPORT_FIELDS = ["name", "company_name", "phone", "whatsapp", "email", "website", "social_url", "country", "source", "notes"]
CSV_FIELDS = [*EXPORT_FIELDS, "date"]
FLAT_LEAD = T.StructType([T.StructField(c, T.StringType(), False) for c in CSV_FIELDS])
