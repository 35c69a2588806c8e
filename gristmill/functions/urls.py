"""URL functions as columns. Nothing here raises on a malformed URL; nulls count as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.named import let

# Query parameters that only track, and what a funnel leaves out by default.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "referrer", "source", "igshid", "_ga", "yclid", "msclkid"]
BLOCKED_DOMAINS = ["youtube.com", "facebook.com", "reddit.com", "twitter.com", "pinterest.com", "instagram.com", "tiktok.com", "linkedin.com", "wikipedia.org"]
BLOCKED_PATHS = ["/articles/", "/article/", "/news/", "/blog-post", "/best-of", "/roundup", "/listicle", "/buying-guide"]

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_REST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?"


def _trimmed(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"^\s+|\s+$", "")


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def netloc_of(url: Column) -> Column:
    """Host and port, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _REST + r"([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def bare_host(url: Column) -> Column:
    """Host without one leading www. and without port."""
    return F.regexp_replace(F.regexp_replace(netloc_of(url), r"^www\.", ""), r":.*$", "")


def _form(x: Column) -> Column:
    """Decoded and encoded again the way web pages encode fields; what can't be decoded is taken as it is."""
    return F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(x), x)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def kept_query(query: Column, dropped: list[str]) -> Column:
    """The parameters in order, less those of the given names (whatever their case); blank values stay."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), F.regexp_extract(p, "=(.*)$", 1).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(F.coalesce(F.try_url_decode(p["k"]), p["k"])).isin(dropped))
    return F.array_join(F.transform(kept, lambda p: F.concat(_form(p["k"]), F.lit("="), _form(p["v"]))), "&")


def normalize_url(url: Column) -> Column:
    """One form for all spellings: lower-case scheme (https if none) and host, no leading www., no default port, no trailing slash, no path parameters, no tracking parameters, no fragment."""
    return let(_trimmed(url), lambda u: F.when(u == "", F.lit("")).otherwise(let(_parts(u), _whole)))


def _parts(u: Column) -> Column:
    scheme, host, path = scheme_of(u), F.regexp_replace(netloc_of(u), r"^www\.", ""), F.regexp_replace(path_of(u), r";[^/]*$", "")
    return F.struct(let(scheme, lambda x: F.when(x == "", F.lit("https")).otherwise(x)).alias("scheme"), host.alias("host"), path.alias("path"), kept_query(query_of(u), TRACKING).alias("query"))


def _whole(p: Column) -> Column:
    """A URL of its parts; each value that a step looks at more than once has a name, since every mention of an expression is worked out again."""
    scheme, host, query = p["scheme"], p["host"], p["query"]
    host = F.when((scheme == "http") & host.endswith(":80"), F.regexp_replace(host, ":80$", "")).when((scheme == "https") & host.endswith(":443"), F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])
    path = let(path, lambda x: F.when((F.length(x) > 1) & x.endswith("/"), F.regexp_replace(x, "/+$", "")).otherwise(x))
    path = let(path, lambda x: F.when((x != "") & ~x.startswith("/"), F.concat(F.lit("/"), x)).otherwise(x))
    return F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def root_domain(url: Column) -> Column:
    """The last two labels of the host, with no list of public suffixes; a single label is itself."""
    return F.array_join(F.slice(F.reverse(F.slice(F.reverse(F.split(bare_host(F.coalesce(url, F.lit(""))), r"\.")), 1, 2)), 1, 2), ".")


def url_variants(url: Column) -> Column:
    """The URL itself, then host with and without www. by path with and without trailing slash, each once."""
    host, path = netloc_of(url), F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    other_host = F.when(host.startswith("www."), F.substring(host, 5, 1 << 20)).otherwise(F.concat(F.lit("www."), host))
    other_path = F.when(path.endswith("/") & (F.length(path) > 1), F.regexp_replace(path, "/+$", "")).otherwise(F.concat(path, F.lit("/")))
    tail = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    variants = [F.concat(scheme_of(url), F.lit("://"), h, p, tail) for h in (host, other_host) for p in (path, other_path)]
    return F.when(host == "", F.array(url)).otherwise(F.array_distinct(F.array(url, *variants)))


def unwrapped(url: Column) -> Column:
    """The page that an archive's URL holds, normalised; any other URL normalised."""
    return normalize_url(F.regexp_replace(url, r"^.*web\.archive\.org/web/.*?/(http.*)$", "$1"))


def block_reason(url: Column, domains: list[str] = BLOCKED_DOMAINS, paths: list[str] = BLOCKED_PATHS) -> Column:
    """Why a funnel leaves a URL out, or null: its root domain, or else the first blocked fragment in sorted order."""
    root = root_domain(url)
    hit = F.filter(F.array(*[F.lit(p.lower()) for p in sorted(paths)]), lambda p: F.contains(F.lower(F.coalesce(url, F.lit(""))), p)) if paths else F.array().cast("array<string>")
    return F.when(root.isin([d.lower() for d in domains]), F.concat(F.lit("disallowed-domain:"), root)).when(F.size(hit) > 0, F.concat(F.lit("disallowed-path:"), F.try_element_at(hit, F.lit(1))))


def cleaned_link(url: Column, prefixes: list[str], names: list[str]) -> Column:
    """The URL without parameters of these names or prefixes, otherwise as it is."""
    kept = F.filter(F.split(query_of(url), "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(names) & ~(F.exists(F.array(*[F.lit(x) for x in prefixes]), lambda x: F.startswith(F.lower(p), x)) if prefixes else F.lit(False)))
    query, head, tail = F.array_join(kept, "&"), F.regexp_extract(url, "^([^?#]*)", 1), F.regexp_extract(url, "(#.*)$", 1)
    return F.concat(head, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), tail)


def absolute(link: Column, base: Column) -> Column:
    """A link as seen from a page: whole URLs stay, anything else is put onto the base's scheme, host or folder, with its dots resolved."""
    scheme, root = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    own, tail = F.regexp_extract(link, "^([^?#]*)", 1), F.regexp_extract(link, "^[^?#]*(.*)$", 1)
    whole = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "[^/]*$", ""), own))
    # a last segment of dots names a folder
    steps = F.split(F.regexp_replace(whole, r"(/\.\.?)$", "$1/"), "/")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda held, s: F.when(s == ".", held).when(s == "..", F.when(F.size(held) > 1, F.slice(held, F.lit(1), F.size(held) - 1)).otherwise(held)).otherwise(F.array_append(held, s)))
    joined = F.concat(root, F.array_join(kept, "/"), tail)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link == "", base)
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(link.startswith("?"), F.concat(root, path, link))
        .otherwise(joined)
    )


def site_exclusion(query: str, sites: list[str]) -> str:
    """A search query that leaves these sites out, in sorted order."""
    return " ".join([query, *(f"-site:{s}" for s in sorted(sites))])


def permalink(domain: str, key: Column) -> Column:
    return F.concat(F.lit(f"https://{domain}/r/"), key.cast("string"))


def is_self_host(url: Column, hosts: list[str]) -> Column:
    return bare_host(F.coalesce(url, F.lit(""))).isin([h.lower().removeprefix("www.") for h in hosts])


def is_private_host(url: Column, hosts: list[str] = ["localhost", "127.0.0.1", "0.0.0.0", "::1"], prefixes: list[str] = ["10.", "192.168.", "172.16.", "169.254."]) -> Column:  # noqa: B006
    """Hosts a fetcher must not reach: named ones and address prefixes."""
    host = F.regexp_replace(netloc_of(F.coalesce(url, F.lit(""))), r":\d*$", "")
    out = host.isin(hosts)
    for p in prefixes:
        out = out | host.startswith(p)
    return out


def title_from_url(url: Column) -> Column:
    """The last path segment without extension, decoded, underscores as spaces."""
    stem = F.regexp_replace(F.regexp_extract(path_of(url), r"([^/]*)/*$", 1), r"\.[^.]*$", "")
    return F.replace(F.coalesce(F.try_url_decode(stem), stem), F.lit("_"), F.lit(" "))


def title_from_file(name: Column, prefix: str = "context-") -> Column:
    """A file's stem without the prefix, cut at hyphens, underscores and blanks, or where there are none at its capitals; words in title case."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", ""), f"^{prefix}", "")
    runs = F.regexp_extract_all(stem, F.lit("([A-Z][a-z]*|[a-z]+)"))
    parts = F.when(stem.rlike(r"[-_\s]"), F.split(stem, r"[-_\s]+")).when(F.size(runs) > 0, runs).otherwise(F.array(stem))
    return F.array_join(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))), " ")


def slug(text: Column) -> Column:
    """Runs of anything but letters and digits as single hyphens, in lower case, none at the ends."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", "-")), "^-+|-+$", "")
