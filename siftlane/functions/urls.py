"""Links as columns: parts, registered root, class and multiplier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlane import config as c
from siftlane.functions.text import normalize

_SECOND_LEVEL = ("com", "gov", "org", "edu", "net")
_HOST_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_DESTINATION = rf"(?i)^https?://(?:{_HOST_LABEL}\.)+[A-Za-z]{{2,63}}(?::[0-9]+)?(?:[/?#].*)?$"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parts(url: Column) -> Column:
    """``struct(subdomains, sld, tld, path, query)``; no user info, no fragment, a port is dropped."""
    rest = F.regexp_replace(url, r"(?i)^https?://", "")
    query = F.when(F.contains(rest, F.lit("?")), F.regexp_replace(rest, r"(?s)^[^?]*\?", "")).otherwise(F.lit(""))
    rest = F.regexp_replace(rest, r"(?s)\?.*$", "")
    path = F.when(F.contains(rest, F.lit("/")), F.regexp_replace(rest, r"(?s)^[^/]*/", "")).otherwise(F.lit(""))
    host = F.regexp_replace(F.regexp_replace(rest, r"(?s)/.*$", ""), r":[0-9]{1,5}$", "")
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.struct(
        F.when(n > 2, F.slice(labels, F.lit(1), F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("subdomains"),
        F.when(n >= 2, F.try_element_at(labels, F.lit(-2))).otherwise(F.lit("")).alias("sld"),
        F.try_element_at(labels, F.lit(-1)).alias("tld"),
        path.alias("path"),
        query.alias("query"),
    )


def _labels(p: Column) -> Column:
    return F.transform(F.filter(F.concat(p["subdomains"], F.array(p["sld"], p["tld"])), lambda x: x != ""), lambda x: F.lower(x))


def root(p: Column) -> Column:
    """The registered root of a host: three labels behind a general second level, else two."""

    def of(labels: Column) -> Column:
        n = F.size(labels)
        second = F.try_element_at(labels, F.lit(-2))
        keep = F.when((n >= 3) & second.isin(*_SECOND_LEVEL), 3).otherwise(F.least(n, F.lit(2)))
        return F.when(n > 0, F.array_join(F.slice(labels, n - keep + 1, F.greatest(keep, F.lit(1))), ".")).otherwise(F.lit(""))

    return let(_labels(p), of)


def host(p: Column) -> Column:
    return F.lower(F.array_join(F.concat(p["subdomains"], F.array(p["sld"], p["tld"])), "."))


def is_under(name: Column, domains: tuple[str, ...]) -> Column:
    """Whether a host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (name == d) | F.endswith(name, F.lit("." + d))
    return out


def is_shortener(p: Column, cfg: c.EngineConfig) -> Column:
    return let(host(p), lambda h: is_under(h, cfg.shorteners))


def is_legitimate(p: Column, cfg: c.EngineConfig) -> Column:
    return root(p).isin(*cfg.legitimate)


def lookalike(root_domain: Column, cfg: c.EngineConfig) -> Column:
    """A brand of the dictionary inside a registered name that is not the brand's own."""
    brands = [cfg.norm(b) for category, b in cfg.dictionary if category in cfg.brand_category and b.lower() not in cfg.generic_brands]
    long = [b for b in brands if len(b) >= cfg.lookalike_chars]
    short = [b for b in brands if 0 < len(b) < cfg.lookalike_chars]

    def of(label: Column) -> Column:
        norm = normalize(label)
        out = F.exists(F.array(*map(F.lit, long)), lambda b: F.contains(norm, b)) if long else F.lit(False)
        if short:
            tokens = F.transform(F.filter(F.split(label, r"[^a-z0-9]+"), lambda x: x != ""), normalize)
            out = out | F.arrays_overlap(tokens, F.array(*map(F.lit, short)))
        return (label != "") & out

    return let(F.lower(F.substring_index(root_domain, ".", 1)), of)


def structure(p: Column, cfg: c.EngineConfig) -> Column:
    """The structural class of a link whose root is not verified, or null: the first pattern that hits decides."""
    norms = [n for n in cfg.norms if n]

    def by_pattern(x: Column) -> Column:
        def rank(n: Column) -> Column:
            return (
                F.when(F.exists(x["subs"], lambda s: F.contains(s, n)), F.lit("subdomain"))
                .when(F.contains(x["path"], n), F.lit("path"))
                .when(F.contains(x["query"], n), F.lit("query"))
                .when(F.contains(x["sld"], n), F.lit("sld"))
            )

        return F.try_element_at(F.filter(F.transform(F.array(*map(F.lit, norms)), rank), lambda r: r.isNotNull()), F.lit(1))

    made = F.struct(F.transform(p["subdomains"], normalize).alias("subs"), normalize(p["path"]).alias("path"), normalize(p["query"]).alias("query"), normalize(p["sld"]).alias("sld"))
    out = let(made, by_pattern) if norms else F.lit(None).cast("string")
    return F.when(lookalike(root(p), cfg), F.lit("lookalike")).otherwise(out) if cfg.flag_lookalikes else out


def multiplier(segment: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in c.MULTIPLIERS.items() for x in kv]), segment)


def unwrapped(url: Column) -> Column:
    """The destination inside a tracking link, up to three deep."""

    def once(u: Column) -> Column:
        values = F.transform(F.array(*map(F.lit, ("u", "url", "target", "destination"))), lambda key: F.try_url_decode(F.call_function("regexp_extract", u, F.concat(F.lit("[?&]"), key, F.lit("=([^&#]*)")), F.lit(1))))
        inner = F.try_element_at(F.filter(values, lambda v: F.coalesce(v.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))), F.lit(1))
        name = F.lower(F.regexp_extract(u, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
        return F.when(let(name, lambda h: is_under(h, c.TRACKERS)), F.coalesce(inner, u)).otherwise(u)

    for _ in range(3):
        url = let(url, once)
    return url


def valid_destination(url: Column) -> Column:
    """An http(s) link to a plausible public host name of 253 characters at most, without blanks."""
    name = F.regexp_extract(url, r"(?i)^https?://([^/?#:]+)", 1)
    return url.isNotNull() & ~url.rlike(r"[\s\p{Z}]") & url.rlike(_DESTINATION) & (F.length(name) <= 253)
