"""Links as Column expressions: networks, profiles, and what is no profile. URLs are absolute here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactloom import dims
from contactloom.functions import phones, urls
from contactloom.functions.folds import distinct_by, fold_by, nonempty_text, specific_platform, without
from contactloom.functions.text import collapse_blanks, constants, ellipsized, let, text_or_empty, utrim, whole_words

LINK_TEXT = 160


def _kind(p: Column) -> Column:
    return urls.by_domain(urls.plain_host(p), dims.CRAWL_SOCIAL)


def crawl_kind(url: Column) -> Column:
    """The network of a link when crawling, or null."""
    return urls.with_parts(url, _kind)


def clean_social_url(url: Column) -> Column:
    """The profile's URL, or null where the link is none: a front page, a post, a share action."""

    def of(p: Column) -> Column:
        first = F.lower(F.regexp_extract(p["path"], "^/*([^/]*)", 1))
        return let(F.struct(_kind(p).alias("kind"), first.alias("first"), F.concat(p["scheme"], F.lit("://"), p["authority"]).alias("base")), lambda k: cleaned(p, k["kind"], k["first"], k["base"]))

    def cleaned(p: Column, kind: Column, first: Column, base: Column) -> Column:
        shared = F.concat(kind, F.lit("/"), first).isin([f"{name}/{x}" for name, segments in dims.CRAWL_SHARE_PATHS.items() for x in segments])
        bare = F.regexp_replace(p["path"], "/+$", "")
        profile = let(urls.value_of(p, "id"), lambda i: F.when(text_or_empty(i) != "", F.concat(base, p["path"], F.lit("?id="), F.url_encode(i))))
        return (
            F.when(kind.isNull() | ~urls.is_web(p) | (first == "") | shared, None)
            .when(kind == "instagram", F.when(~first.isin(dims.INSTAGRAM_CONTENT), F.concat(base, F.lit("/"), first)))
            .when((kind == "facebook") & F.endswith(F.lower(p["path"]), F.lit("/profile.php")), profile)
            .otherwise(F.concat(base, bare))
        )

    return urls.with_parts(url, of)


_NETWORKS = {d: name for name, domains in dims.PLATFORM_DOMAINS.items() for d in domains} | dict.fromkeys(dims.OTHER_NETWORKS, "other")


def _platform(p: Column) -> Column:
    return F.when(p["scheme"] == "whatsapp", F.lit("whatsapp")).when(urls.is_web(p), urls.by_domain(p["hostname"], _NETWORKS))


def platform(url: Column) -> Column:
    """The network of a link when capturing, ``other`` for the lesser ones, or null."""
    return urls.with_parts(url, _platform)


def is_share_control(described: Column) -> Column:
    """``described``: class, id, label, title and text of an element."""
    return text_or_empty(described).rlike(whole_words(dims.SHARE_WORDS)) | text_or_empty(described).rlike("|".join(dims.SHARE_WORDS_AR))


def _any_of(words: list[str]) -> str:
    return "(?:" + "|".join(w.replace(".", r"\.") for w in words) + ")"


def _is_redirect(p: Column, host: Column, path: Column) -> Column:
    known = "|".join(rf"(?:^|\.){_any_of([domain])}{_any_of(paths)}/*\z" for domain, paths in dims.REDIRECT_PATHS.items())
    target = p["query"].rlike(f"(?:^|&){_any_of(dims.REDIRECT_TARGETS)}(?:=|&|$)")
    return host.isin(dims.REDIRECT_HOSTS) | F.concat(host, path).rlike(known) | path.rlike(f"/{_any_of(dims.REDIRECT_SEGMENTS)}(?:/|$)") & target


def _is_login(p: Column, path: Column) -> Column:
    named = path.rlike(f"(?:^|/)(?:{'|'.join(dims.LOGIN_SEGMENTS)})(?:/|$)")
    asks = p["query"].rlike("(?:^|&)client_id=") & p["query"].rlike("(?:^|&)(?:redirect_uri|response_type)=")
    return named | F.startswith(p["hostname"], F.lit("oauth.")) | asks


def _is_share(kind: Column, path: Column) -> Column:
    known = "|".join(f"{name}{_any_of(starts)}" for name, starts in dims.SHARE_ACTIONS.items())
    return F.concat(kind, path).rlike(f"^(?:{known})(?:/|$)")


def _is_empty(p: Column, kind: Column, path: Column) -> Column:
    facebook = (kind == "facebook") & path.rlike(r"^/profile\.php/?$") & ~p["query"].rlike("(?:^|&)id=[^&]")
    asks = (p["scheme"] == "whatsapp") | urls.domain_matches(p["hostname"], "wa.me") | path.rlike("^/send(?:/|$)")
    empty = urls.is_web(p) & path.rlike("^/*$") | facebook
    return (kind != "") & F.when((kind == "whatsapp") & asks, empty | ~phones.recipient_of(p)).otherwise(empty)


def _seen(p: Column) -> Column:
    """What the rules for links ask of one."""
    return F.struct(p["hostname"].alias("host"), F.lower(p["path"]).alias("path"), _platform(p).alias("platform"), urls.key_of(p).alias("key"), urls.is_web(p).alias("web"))


def _left_out(p: Column, k: Column, page_key: Column) -> Column:
    kind = text_or_empty(k["platform"])
    return ~(k["web"] | (p["scheme"] == "whatsapp")) | (k["key"] != "") & (k["key"] == page_key) | _is_redirect(p, k["host"], k["path"]) | _is_login(p, k["path"]) | _is_share(kind, k["path"]) | _is_empty(p, kind, k["path"])


def _excluded(p: Column, page_key: Column) -> Column:
    return let(_seen(p), lambda k: _left_out(p, k, page_key))


def is_excluded(url: Column, page: Column) -> Column:
    """Links that are neither profiles nor other sites worth keeping: redirects, log-ins, share actions, empty profiles, the page itself."""
    return let(urls.comparable_url(page), lambda key: urls.with_parts(url, lambda p: _excluded(p, key)))


def judged(anchors: Column, page: Column) -> Column:
    """Anchors (url, href, text, described, context) with their platform, whether they are left out, and how they are shown and told apart."""

    def of(a: Column, key: Column) -> Column:
        def shown(p: Column, k: Column) -> Column:
            return F.struct(
                a["context"].alias("context"),
                a["href"].alias("href"), a["text"].alias("text"), k["platform"].alias("platform"), p["hostname"].alias("hostname"),
                (_left_out(p, k, key) | (text_or_empty(a["url"]) == "")).alias("excluded"), is_share_control(a["described"]).alias("shares"), k["web"].alias("web"),
                F.when(k["web"], urls.http_of(p)).otherwise(a["url"]).alias("url"), F.when(k["web"], k["key"]).otherwise(a["url"]).alias("key"),
            )

        return urls.with_parts(a["url"], lambda p: let(_seen(p), lambda k: shown(p, k)))

    return let(urls.comparable_url(page), lambda key: F.transform(anchors, lambda a: of(a, key)))


def clean_link_text(text: Column) -> Column:
    return ellipsized(collapse_blanks(text_or_empty(text)), LINK_TEXT)


def social_links(links: Column) -> Column:
    """(platform, url) of judged anchors, first wins."""
    own = F.filter(links, lambda a: a["platform"].isNotNull() & ~a["shares"] & ~a["excluded"])
    return F.transform(distinct_by(own, lambda a: a["key"]), lambda a: F.struct(a["platform"], a["url"]))


def whatsapp_links(links: Column) -> Column:
    """The URLs of judged anchors that lead to a WhatsApp number or chat, each once."""
    return F.array_distinct(F.transform(F.filter(links, lambda a: (a["platform"] == "whatsapp") & ~a["shares"] & ~a["excluded"]), lambda a: a["url"]))


def external_links(links: Column, page: Column) -> Column:
    """(url, text, type) of judged anchors to other hosts that are no network."""
    host = urls.hostname(page)
    own = let(host, lambda h: F.filter(links, lambda a: a["web"] & ~a["shares"] & ~F.startswith(text_or_empty(a["href"]), F.lit("#")) & a["platform"].isNull() & ~a["excluded"] & (a["hostname"] != h)))
    each = F.transform(own, lambda a: F.struct(a["url"], clean_link_text(a["text"]).alias("text"), F.lit("website").alias("type"), a["key"].alias("key")))
    return F.transform(fold_by(F.filter(each, lambda e: e["url"] != ""), lambda e: e["key"], nonempty_text), lambda e: e.dropFields("key"))


def contact_links(anchors: Column, page: Column, limit: int, strict: bool = True) -> Column:
    """Up to ``limit`` links of the same host that speak of contact. Not strict: a limit of 0 still gives one."""

    def own(host: Column) -> Column:
        def speaks(a: Column) -> Column:
            return urls.with_parts(a["url"], lambda p: urls.is_web(p) & (urls.plain_host(p) == host) & F.concat(F.lower(p["path"]), F.lit(" "), F.lower(text_or_empty(a["text"]))).rlike("|".join(dims.CONTACT_TERMS)))

        return F.filter(anchors, speaks)

    found = F.array_distinct(F.transform(let(urls.host_for_url(page), own), lambda a: F.regexp_replace(a["url"], r"[?#].*$", "")))
    return F.slice(F.filter(found, lambda u: u != page), F.lit(1), F.lit(limit if strict else max(limit, 1)))


def normalized_platform(value: Column) -> Column:
    name = F.lower(text_or_empty(value))
    return F.when(name == "x", "twitter").when(name.isin(list(dims.PLATFORM_LABELS)), name).otherwise("other")


def normalized_social(values: Column) -> Column:
    each = F.transform(values, lambda s: F.struct(normalized_platform(s["platform"]).alias("platform"), F.when(urls.scheme(s["url"]) == "whatsapp", s["url"]).otherwise(urls.normalized_url(s["url"])).alias("url")))
    return fold_by(F.filter(each, lambda s: s["url"] != ""), lambda s: s["url"], specific_platform)


def normalized_external(values: Column) -> Column:
    each = F.transform(values, lambda e: F.struct(urls.normalized_url(e["url"]).alias("url"), clean_link_text(e["text"]).alias("text"), F.lit("website").alias("type")))
    return fold_by(F.filter(each, lambda e: e["url"] != ""), lambda e: e["url"], nonempty_text)


def external_of_strings(values: Column) -> Column:
    """Old records hold external links as strings."""
    return F.transform(values, lambda u: F.struct(u.alias("url"), F.lit("").alias("text"), F.lit("website").alias("type")))


def external_without_social(external: Column, social: Column) -> Column:
    return without(external, social, lambda e: e["url"], lambda s: s["url"])


def social_line(link: Column) -> Column:
    """``Network: url``; empty without a URL."""
    labels = constants(dims.PLATFORM_LABELS)
    name, url = F.lower(utrim(text_or_empty(link["platform"]))), utrim(text_or_empty(link["url"]))
    label = F.coalesce(F.try_element_at(labels, name), F.nullif(F.concat(F.upper(F.left(name, F.lit(1))), F.substr(name, F.lit(2))), F.lit("")), F.lit("Social"))
    return F.when(url != "", F.concat(label, F.lit(": "), url)).otherwise("")


def plain_social_line(link: Column) -> Column:
    """``network: url`` as they are stored, or the URL alone."""
    name, url = utrim(text_or_empty(link["platform"])), utrim(text_or_empty(link["url"]))
    return F.when(name != "", F.concat(name, F.lit(": "), url)).otherwise(url)


def external_line(link: Column) -> Column:
    """``text: url``, or the URL alone where the text is empty or says the same."""
    text, url = utrim(text_or_empty(link["text"])), utrim(text_or_empty(link["url"]))
    return F.when((text != "") & (text != url), F.concat(text, F.lit(": "), url)).otherwise(url)
