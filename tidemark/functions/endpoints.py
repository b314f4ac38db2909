"""Endpoints, scripts and field names of pages as evidence: what counts, and how it is written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.markup import normalize_text, unescape
from tidemark.functions.net import COMMON_HOSTS, normalize_host

#: Parts of script names that many sites share. Fixed values.
COMMON_SCRIPTS = "jquery bootstrap react react-dom web3.min.js ethers sweetalert sentry chunk polyfill runtime main.js app.js index.js pre-load.js ./common- ./ui- ./scripts/lockdown ./scripts/policy-load ./scripts/snow.js ./scripts/use-snow.js".split()
#: What of an endpoint differs from visit to visit, and its mask. Fixed values.
RANDOM_PARTS = (("/{rand}", "(?i)/[a-z0-9]{7,}(?=/api(?:/|\\?| |$))"), ("/{js_sentinel}", r"(?i)/\+\(__(?:globalobject|uint8array)[^)]+\)\+"), ("/index_{n}", r"(?i)/index_[0-9]+(?=\.html|$)"))
#: A field's name parts that speak of accounts and money, and the longest name. Fixed values.
FIELD_PARTS = "num amount money balance asset assets token symbol chain invite auth address wallet account signature password email otp seed mnemonic code msg".split()
LONG_FIELD, PREFIXED = 42, ("auth_", "wallet_", "chain_", "invite_")


def url_token(url: Column, primary: Column) -> Column:
    """host + path in lower case, the path alone on the primary host; empty for data, blob and hosts that all pages use."""
    u = F.trim(unescape(F.coalesce(url, F.lit(""))))
    host, path = normalize_host(F.try_parse_url(u, F.lit("HOST"))), F.lower(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")))
    alone = F.when(path != "", path).otherwise(F.lower(u))
    return F.when((u == "") | u.startswith("data:") | u.startswith("blob:") | host.isin(*COMMON_HOSTS), "").when(host == "", alone).when(host == normalize_host(primary), path).otherwise(F.concat(host, path))


def useful_script(src: Column) -> Column:
    """Whether a script's source may tell sites apart."""
    s = F.lower(F.coalesce(src, F.lit("")))
    out = ~s.isin("", "/", "#")
    for token in COMMON_SCRIPTS:
        out = out & ~s.contains(token)
    return out


def steady_token(token: Column) -> Column:
    """An endpoint without what differs from visit to visit."""
    t = F.lower(F.coalesce(token, F.lit("")))
    for name, pattern in RANDOM_PARTS:
        t = F.regexp_replace(t, pattern, name)
    return t


def strip_host(endpoint: Column) -> Column:
    """The path of host/path; what begins with a slash, or has none, as it is."""
    at = F.instr(endpoint, "/")
    return F.when(at > 1, F.substring(endpoint, at, F.length(endpoint))).otherwise(endpoint)


def is_infrastructure(endpoint: Column, pattern: str) -> Column:
    """Whether an endpoint is of a wallet's or a vendor's own calls: it names a project id, or matches the caller's pattern."""
    return F.lower(endpoint).contains("projectid") | endpoint.rlike(pattern)


def own_tokens(endpoints: Column, schemas: Column, pattern: str, clip: int = 120) -> Column:
    """Sorted distinct tokens of arrays of endpoints and request schemas that are no infrastructure."""
    ep = F.transform(F.filter(endpoints, lambda x: ~is_infrastructure(x, pattern)), lambda x: F.concat(F.lit("ep:"), strip_host(x)))
    sc = F.transform(F.filter(schemas, lambda x: ~is_infrastructure(x, pattern)), lambda x: F.concat(F.lit("sc:"), F.substring(x, 1, clip)))
    return F.array_sort(F.array_distinct(F.concat(ep, sc)))


def field_name(name: Column, ignore: tuple[str, ...] = ()) -> Column:
    """A field's words joined by single underscores, 64 characters at most; empty if it is to be ignored."""
    words = F.filter(F.split(F.replace(normalize_text(name), F.lit(" "), F.lit("_")), "_"), lambda x: x != "")
    clean = F.substring(F.array_join(words, "_"), 1, 64)
    return F.when(clean.isin(*ignore), "").otherwise(clean) if ignore else clean


def is_schema_signal(field: Column) -> Column:
    """Whether a clean field name speaks of accounts or money and is no long phrase."""
    phrase = (F.size(F.split(field, "_")) > 6) & ~F.substring_index(field, "_", 1).isin(*[p[:-1] for p in PREFIXED])
    told = F.arrays_overlap(F.split(field, "_"), F.array(*map(F.lit, FIELD_PARTS)))
    return (field != "") & (F.length(field) <= LONG_FIELD) & ~field.contains("$") & ~phrase & told
