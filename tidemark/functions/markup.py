"""Evidence from HTML and scripts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The entities that pages use most, the ampersand last. Fixed values.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&"}


def unescape(text: Column) -> Column:
    for e, c in ENTITIES.items():
        text = F.replace(text, F.lit(e), F.lit(c))
    return text


#: What texts and scripts are masked with before they are hashed: hashes agree only if these patterns, names and their order do. Fixed values.
TEXT_MASKS = (("ADDR", "0x[a-fA-F0-9]{40}"), ("HEX", "(?i)[a-f0-9]{16,64}"), ("URL", "https?://[^\\s\"'<>]+"), ("NUM", r"\b\d+(?:[.,]\d+)*\b"))
SCRIPT_MASKS = (("ADDR", "0x[a-fA-F0-9]{40}"), ("HEX", "(?i)[a-f0-9]{24,64}"), ("URL", "https?://[^\\s\"'<>]+"), ("STR", "['\"][^'\"]{0,240}['\"]"), ("NUM", r"\b\d+(?:\.\d+)?\b"))
#: Longest script that is hashed, in characters. Fixed value.
MOST_SCRIPT = 300_000


def masked(text: Column, masks) -> Column:
    """text with each mask's matches replaced by its name between spaces."""
    for name, pattern in masks:
        text = F.regexp_replace(text, pattern, f" {name} ")
    return text


def normalize_text(text: Column) -> Column:
    """The words of a text, masked and in lower case; a word is letters, digits, CJK and dollar signs."""
    words = F.regexp_extract_all(masked(unescape(F.coalesce(text, F.lit(""))), TEXT_MASKS), F.lit("[a-zA-Z0-9一-鿿$]+"), F.lit(0))
    return F.lower(F.array_join(words, " "))


def without_elements(html: Column, *names: str) -> Column:
    """A page without the elements of these names and what they hold."""
    return F.regexp_replace(html, rf"(?is)<({'|'.join(names)})\b.*?</\1>", " ")


def without_tags(html: Column) -> Column:
    """What stands between tags; a ``<`` that no ``>`` follows is text."""
    between = F.transform(F.split(html, "<", -1), lambda x, i: F.when((i > 0) & x.contains(">"), F.substring(x, F.instr(x, ">") + 1, F.length(x))).otherwise(x))
    return F.array_join(between, " ")


def visible_text(html: Column) -> Column:
    return normalize_text(without_tags(without_elements(F.coalesce(html, F.lit("")), "script", "style")))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))


def script_sources(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<script[^>]+src=["']([^"']+)["']"""), F.lit(1))


def inline_scripts(html: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<script(?![^>]*\ssrc=)[^>]*>(.*?)</script>"), F.lit(1))
    return F.filter(found, lambda x: F.trim(x) != "")


def without_comments(script: Column) -> Column:
    """A script without block comments, and each line without what follows two slashes that no colon precedes."""
    lines = F.split(F.regexp_replace(script, r"(?s)/\*.*?\*/", " "), "\n", -1)
    return F.array_join(F.transform(lines, lambda x: F.when(x.contains("//"), F.regexp_replace(x, "(?<!:)//.*", " ")).otherwise(x)), "\n")


def normalize_script(text: Column) -> Column:
    """A script for hashing: without comments, masked, with single spaces."""
    parts = F.split(masked(without_comments(unescape(F.coalesce(text, F.lit("")))), SCRIPT_MASKS), r"\s+")
    return F.substring(F.array_join(F.filter(parts, lambda x: x != ""), " "), 1, MOST_SCRIPT)


def tag_sequence(html: Column, most: int = 1000) -> Column:
    """The opening tags' names in order, at most so many."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))
    return F.slice(F.transform(tags, F.lower), 1, most)


def short_hash(text: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
