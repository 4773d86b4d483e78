"""URLs as Column expressions. A null or malformed URL gives empty parts; the row survives."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.dims import TLD_COUNTRY, TRACKING_PARAMETERS
from contactloom.functions.text import constants, let, nonempty_distinct, text_or_empty, utrim

_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_CUT = "\x01"


def with_parts(url: Column, then: Callable[[Column], Column]) -> Column:
    """``then(parts)``: scheme, authority, path and query of a URL, its host name and port, taken apart once."""

    def of_split(s: Column) -> Column:
        # most authorities are a host alone
        has = lambda sign: F.contains(s[1], F.lit(sign))
        bare = F.when(has("@"), F.regexp_replace(s[1], "^.*@", "")).otherwise(s[1])
        name = F.when(has("["), F.when(bare.rlike(r"^\[[^\]]*$"), "").otherwise(F.lower(F.regexp_replace(bare, ":[0-9]*$", "")))).when(has(":"), F.lower(F.regexp_replace(bare, ":[0-9]*$", ""))).otherwise(F.lower(bare))
        return F.struct(
            F.lower(s[0]).alias("scheme"), s[1].alias("authority"), s[2].alias("path"), s[3].alias("query"),
            name.alias("hostname"), F.when(has(":"), F.regexp_extract(bare, r":([^\]:]*)$", 1)).otherwise("").alias("port"),
        )

    cut = F.split(F.regexp_replace(F.replace(text_or_empty(url), F.lit(_CUT), F.lit("")), _SPLIT, _CUT.join(("$1", "$2", "$3", "$4"))), _CUT, -1)
    return let(let(cut, of_split), then)


def _part(name: str) -> Callable[[Column], Column]:
    return lambda url: with_parts(url, lambda p: p[name])


scheme, authority, path, query_string, hostname, port = map(_part, ("scheme", "authority", "path", "query", "hostname", "port"))


def plain_host(p: Column) -> Column:
    """Of parts: the host without dots at its end and one leading ``www.``."""
    return F.regexp_replace(F.regexp_replace(p["hostname"], r"\.+$", ""), r"^www\.", "")


def host_for_url(url: Column) -> Column:
    return with_parts(url, plain_host)


def is_web_url(url: Column) -> Column:
    return text_or_empty(url).rlike("(?i)^https?://")


def is_web(p: Column) -> Column:
    return p["scheme"].isin("http", "https") & (p["hostname"] != "")


def url_problem(value: Column) -> Column:
    """Why a seed is no URL to visit, or null; the first rule that it breaks."""

    def of(p: Column) -> Column:
        number = F.try_to_number(p["port"], F.lit("9999999999"))
        broken_port = (p["port"] != "") & ~p["port"].rlike("^[0-9]{1,10}$")
        return (
            F.when(value.rlike(r"(?U)\s"), "contains whitespace")
            .when(broken_port | p["authority"].rlike(r"^\[[^\]]*$"), "is malformed")
            .when(~p["scheme"].isin("http", "https"), "must use http or https")
            .when(p["hostname"] == "", "has no host")
            .when(F.contains(p["authority"], F.lit("@")), "must not contain credentials")
            .when(F.coalesce((number < 1) | (number > 65535), F.lit(False)), "has an invalid port")
        )

    return with_parts(value, of)


def pairs_of(p: Column) -> Column:
    """Of parts: the non-empty name=value pairs of the query."""
    return F.filter(F.split(p["query"], "&"), lambda x: x != "")


def parameters(url: Column) -> Column:
    return with_parts(url, pairs_of)


def value_of(p: Column, *names: str) -> Column:
    """Of parts: the decoded value of the first parameter of one of the names; null without one."""
    found = F.get(F.filter(F.split(p["query"], "&"), lambda x: F.substring_index(x, "=", 1).isin(*names)), F.lit(0))
    return let(F.regexp_replace(found, "^[^=]*=?", ""), lambda v: F.coalesce(F.try_url_decode(v), v))


def parameter(url: Column, name: str) -> Column:
    return with_parts(url, lambda p: value_of(p, name))


def is_tracking(pair: Column) -> Column:
    name = F.lower(F.substring_index(pair, "=", 1))
    return F.startswith(name, F.lit("utm_")) | name.isin(TRACKING_PARAMETERS)


def origin(p: Column) -> Column:
    usual = (p["port"] == "") | (F.concat(p["scheme"], p["port"])).isin("http80", "https443")
    return F.concat(p["scheme"], F.lit("://"), p["hostname"], F.when(usual, "").otherwise(F.concat(F.lit(":"), p["port"])))


def _shown(p: Column, path_: Column, pairs: Column) -> Column:
    search = let(pairs, lambda x: F.when(F.size(x) > 0, F.concat(F.lit("?"), F.array_join(x, "&"))).otherwise(""))
    return F.when(is_web(p), F.concat(origin(p), path_, search)).otherwise("")


def _kept(p: Column) -> Column:
    return F.filter(F.split(p["query"], "&"), lambda x: (x != "") & ~is_tracking(x))


def http_of(p: Column) -> Column:
    return _shown(p, F.when(p["path"] == "", "/").otherwise(p["path"]), _kept(p))


def normalized_http(url: Column) -> Column:
    """An absolute http(s) URL without fragment and tracking parameters; else empty."""
    return with_parts(url, http_of)


def normalized_url(url: Column) -> Column:
    """``normalized_http`` without the slashes that end the path; without a path, or if it has none at its end, without one that ends the query."""
    return with_parts(utrim(url), lambda p: let(F.regexp_replace(p["path"], "/+$", ""), lambda path: let(_shown(p, path, _kept(p)), lambda u: F.when(path == "", u).otherwise(F.regexp_replace(u, "/$", "")))))


def normalized_urls(urls: Column) -> Column:
    return nonempty_distinct(F.transform(urls, normalized_url))


def key_of(p: Column) -> Column:
    by_name = F.transform(F.sort_array(F.transform(_kept(p), lambda x, k: F.struct(F.substring_index(x, "=", 1), k, x.alias("x")))), lambda y: y["x"])
    path = F.when(F.length(p["path"]) > 1, F.regexp_replace(p["path"], "/+$", "")).otherwise("/")
    return _shown(p, path, by_name)


def comparable_url(url: Column) -> Column:
    """The key under which links are the same: sorted parameters, no slashes at the path's end."""
    return with_parts(url, key_of)


def is_current_page(url: Column, page: Column) -> Column:
    return let(comparable_url(url), lambda k: (k != "") & (k == comparable_url(page)))


def domain_matches(host: Column, domain: str) -> Column:
    return (host == domain) | F.endswith(host, F.lit("." + domain))


def _of_domains(domains) -> str:
    return r"(?:^|\.)(" + "|".join(d.replace(".", r"\.") for d in domains) + r")\z"


def any_domain(host: Column, domains: list[str]) -> Column:
    return host.rlike(_of_domains(domains))


def by_domain(host: Column, names: dict[str, str]) -> Column:
    """The name of the domain that a host is or belongs to, or null; none of the domains belongs to another."""
    return F.try_element_at(constants(names), F.regexp_extract(host, _of_domains(names), 1))


def country_of_host(host: Column) -> Column:
    """The country of the host's last label, or empty."""
    return text_or_empty(F.try_element_at(constants(TLD_COUNTRY), F.substring_index(host, ".", -1)))


def lead_domain(host: Column, source_url: Column) -> Column:
    own = F.regexp_replace(F.lower(utrim(text_or_empty(host))), r"^www\.", "")
    return let(own, lambda o: F.when(o != "", o).otherwise(F.regexp_replace(hostname(text_or_empty(source_url)), r"^www\.", "")))


def canonical(base: str, href: str) -> str | None:
    """href against a page's URL as browsers write it: host in lower case and ASCII, no dot segments; null if it is malformed."""
    try:
        found = urljoin(base, href.strip())
        parts = urlsplit(found)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            return found
        host = parts.hostname if parts.hostname.isascii() else parts.hostname.encode("idna").decode()
        authority = parts.netloc.rpartition("@")[0] + ("@" if "@" in parts.netloc else "") + (f"[{host}]" if ":" in host else host) + (f":{parts.port}" if parts.port else "")
        kept: list[str] = []
        segments = parts.path.split("/")[1:]
        for k, x in enumerate(segments):
            if x == "..":
                kept[-1:] = []
            if x in (".", ".."):
                kept += [""] if k == len(segments) - 1 else []
            else:
                kept.append(x)
        return urlunsplit((parts.scheme, authority, "/" + "/".join(kept) if segments else "", parts.query, parts.fragment))
    except ValueError:  # UnicodeError is one
        return None


@F.arrow_udf(T.StringType())
def resolved(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(base, href) -> ``canonical``; a null href gives null."""
    for bases, hrefs in parts:
        yield pa.array([None if b is None else canonical(a or "", b) for a, b in zip(bases.to_pylist(), hrefs.to_pylist())], pa.string())
