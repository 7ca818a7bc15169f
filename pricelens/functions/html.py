"""Reading stored HTML with regular expressions, as Column expressions over the whole text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import col, let
from .text import grab

LD_JSON = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script\s*>"
SCRIPT = r"(?is)<script\b[^>]*>(.*?)</script\s*>"
DROPPED = r"(?is)<(script|style|svg|noscript|iframe|canvas|video|audio|picture)\b[^>]*>.*?</\1\s*>|<(?:source|iframe)\b[^>]*>|<!--.*?-->"
TAG = r"(?s)<[^>]*>"


def unescape(c: Column) -> Column:
    out = c
    for code, ch in {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&euro;": "€", "&middot;": "·", "&copy;": "©", "&amp;": "&"}.items():
        out = F.replace(out, F.lit(code), F.lit(ch))
    return out


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def inner_text(c: Column) -> Column:
    return squeeze(unescape(F.regexp_replace(c, TAG, "")))


def element_text(html, tag: str) -> Column:
    """Text of the first element of that name; null when empty."""
    raw = F.regexp_extract(col(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.nullif(inner_text(raw), F.lit(""))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute inside one opening tag; null when missing."""
    pre = rf"(?is)[\s\"'<]{re.escape(name)}\s*=\s*"
    return F.coalesce(grab(tag, pre + r'"([^"]*)"'), grab(tag, pre + r"'([^']*)'"), grab(tag, pre + r"([^\s\"'>]+)"))


def first_tag(html, pattern: str) -> Column:
    return grab(col(html), pattern, 0)


def meta(html, name: str) -> Column:
    """``content`` of a meta tag with that property or name."""
    n = re.escape(name)
    tag = first_tag(html, rf"(?is)<meta\b[^>]*\b(?:property|name)\s*=\s*[\"']{n}[\"'][^>]*>")
    return let(tag, lambda x: unescape(attribute(x, "content")))


def body(html) -> Column:
    inside = F.regexp_extract(col(html), r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)", 1)
    return F.coalesce(F.nullif(inside, F.lit("")), col(html))


def visible_lines(html) -> Column:
    """Non-empty lines of the visible body text, as they stand in the source."""
    text = unescape(F.regexp_replace(F.regexp_replace(body(html), DROPPED, ""), TAG, ""))
    lines = F.transform(F.split(text, r"\r?\n"), squeeze)
    return F.filter(lines, lambda x: x != "")


def element_lines(html) -> Column:
    """Non-empty texts between tags: in a fragment without line breaks the elements part what belongs apart."""
    text = unescape(F.regexp_replace(F.regexp_replace(col(html), DROPPED, ""), TAG, "\n"))
    return F.filter(F.transform(F.split(text, r"\r?\n"), squeeze), lambda x: x != "")


def visible_text(html) -> Column:
    return squeeze(unescape(F.regexp_replace(F.regexp_replace(body(html), DROPPED, ""), TAG, "")))


def anchors(html) -> Column:
    return F.regexp_extract_all(col(html), F.lit(r"(?is)<a\b[^>]*>"), F.lit(0))


def language(html) -> Column:
    tag = first_tag(html, r"(?is)<html\b[^>]*>")
    raw = F.coalesce(F.nullif(F.trim(attribute(tag, "lang")), F.lit("")), meta(html, "og:locale"))
    return F.lower(F.regexp_extract(raw, r"^([^_.-]*)", 1))
