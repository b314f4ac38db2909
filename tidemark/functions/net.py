"""Hosts, URLs and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosting suffixes whose customers are parties of their own. Fixed values.
MANAGED = (".vercel.app", ".pages.dev", ".netlify.app", ".workers.dev", ".github.io", ".web.app", ".firebaseapp.com", ".glitch.me", ".replit.app", ".render.com", ".fly.dev")


def normalize_host(host: Column) -> Column:
    """Lower case, no outer white space or dots, no port; null becomes empty."""
    h = F.btrim(F.lower(F.trim(F.coalesce(host, F.lit("")))), F.lit("."))
    return F.when(h.contains(":") & ~h.startswith("["), F.substring_index(h, ":", 1)).otherwise(h)


def host_from_url(url: Column) -> Column:
    return normalize_host(F.try_parse_url(url, F.lit("HOST")))


def _managed(host: Column) -> Column:
    out = F.lit(False)
    for s in MANAGED:
        out = out | host.endswith(s)
    return out


def registrable_domain(host: Column) -> Column:
    """The last two labels; the whole host below a managed suffix."""
    h = normalize_host(host)
    return F.when((F.size(F.split(h, r"\.")) <= 2) | _managed(h), h).otherwise(F.substring_index(h, ".", -2))


def is_first_party(host: Column, primary: Column) -> Column:
    h, p = normalize_host(host), normalize_host(primary)
    same = (h == p) | h.endswith(F.concat(F.lit("."), p))
    return F.when((h == "") | (p == ""), False).when(same, True).when(_managed(p), False).otherwise(registrable_domain(h) == registrable_domain(p))


def host_parts(hosts: Column) -> Column:
    """Non-empty hosts of a pipe-separated list."""
    return F.filter(F.transform(F.split(F.coalesce(hosts, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def matches_any(hosts: Column, patterns: list[str]) -> Column:
    """Whether any host of a pipe-separated list matches any pattern."""
    return F.exists(host_parts(hosts), lambda h: h.rlike("|".join(f"(?:{p})" for p in patterns)))


#: What masked path parts are called, and what they are: within a segment, then of whole segments, first match wins. Fixed values.
PATH_MASKS = (("{addr}", "0x[a-f0-9]{40}"), ("{hex}", "[a-f0-9]{32,64}"), ("{uuid}", "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"))
NUMBER_MASKS = (("{num}", 3), ("{n}", 1))


def _segment(x: Column) -> Column:
    """One segment of a path: what it holds masked, or the name of a number of at least so many digits."""
    for name, pattern in PATH_MASKS:
        x = F.regexp_replace(x, pattern, name)
    digits = F.when(x.rlike("^[0-9]+$"), F.length(x)).otherwise(0)
    out = F.when(digits >= NUMBER_MASKS[0][1], NUMBER_MASKS[0][0])
    for name, least in NUMBER_MASKS[1:]:
        out = out.when(digits >= least, name)
    return out.otherwise(x)


def mask_path(path: Column) -> Column:
    """A path with each segment masked; empty segments go, and there is no slash at the end."""
    segments = F.filter(F.split(F.lower(F.trim(F.coalesce(path, F.lit("")))), "/"), lambda x: x != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(segments, _segment), "/"))


def query_names(query: Column) -> Column:
    """Sorted distinct parameter names of a query string, at most 12."""
    names = F.transform(F.split(F.coalesce(query, F.lit("")), "&"), lambda x: F.lower(F.substring_index(x, "=", 1)))
    return F.slice(F.array_sort(F.array_distinct(F.filter(names, lambda x: x != ""))), 1, 12)


#: Suffixes of files that are no endpoints, paths that are landing pages, schemes that are no requests, and hosts that any page may call. Fixed values.
STATIC = ".js .mjs .css .png .jpg .jpeg .gif .webp .svg .ico .woff .woff2 .ttf .otf .map .mp4 .webm .txt .xml".split()
LANDING = ("/", "/index.html", "/index.php", "/home", "/main")
NO_REQUEST = ("data:", "blob:", "javascript:", "mailto:", "tel:")
UTILITY = ".infura.io .alchemy.com .alchemyapi.io .ankr.com .walletconnect.com .google-analytics.com .googletagmanager.com .gstatic.com .googleapis.com .cloudflare.com .cloudflareinsights.com .sentry.io .datadoghq.com".split()
COMMON_HOSTS = "www.w3.org fonts.googleapis.com fonts.gstatic.com cdn.jsdelivr.net cdnjs.cloudflare.com unpkg.com ajax.googleapis.com www.google-analytics.com www.googletagmanager.com www.gstatic.com connect.facebook.net browser-intake-datadoghq.com static.cloudflareinsights.com cdn.tailwindcss.com".split()


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def is_public_utility(host: Column) -> Column:
    h = normalize_host(host)
    return (h != "") & (h.isin(*COMMON_HOSTS) | _any([h.endswith(s) for s in UTILITY]))


def canonical_endpoint(url: Column, primary: Column) -> Column:
    """host + masked path (path alone below the primary host) with parameter names.

    Empty for what is no endpoint: other schemes, static files, public
    utilities and landing pages.
    """
    host, owner = host_from_url(url), normalize_host(primary)
    raw = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("/"))
    names = query_names(F.try_parse_url(url, F.lit("QUERY")))
    full = F.concat(mask_path(raw), F.when(F.size(names) > 0, F.concat(F.lit("?"), F.array_join(names, "&"))).otherwise(""))
    no_request = F.coalesce(_any([F.lower(F.trim(url)).startswith(s) for s in NO_REQUEST]), F.lit(True))
    none = no_request | _any([F.lower(raw).endswith(s) for s in STATIC]) | is_public_utility(host) | full.isin(*LANDING)
    own = (host == "") | (host == owner) | host.endswith(F.concat(F.lit("."), owner))
    return F.when(none, "").otherwise(F.concat(F.when(own, "").otherwise(host), full))


def safe_id(text: Column) -> Column:
    """Letters, digits, dot, underscore and dash, others runs as one underscore, none of them at the ends."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
