"""Feeds of RSS, Atom and CDF to entries."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import by_row

ENTRY = "array<struct<title: string, link: string, published: string, content: string, categories: array<string>, enclosures: array<string>>>"
ALLOWED = {"a", "b", "blockquote", "br", "code", "em", "i", "li", "ol", "p", "pre", "strong", "ul"}


def sanitized(html: str) -> str:
    """Without scripts and styles, tags that aren't allowed, and attributes but href."""
    html = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", html)

    def tag(m: re.Match) -> str:
        name = m[2].lower()
        if name not in ALLOWED:
            return ""
        href = re.search(r"""(?i)\bhref\s*=\s*["'](https?://[^"']*)["']""", m[3]) if name == "a" and not m[1] else None
        return f'<{m[1]}{name}{f" href={chr(34)}{href[1]}{chr(34)}" if href else ""}>'

    return re.sub(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>", tag, html)


def parse_feed(text: str | None) -> list[dict]:
    """Entries in order; of text that isn't well-formed XML none."""
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return []
    for node in root.iter():
        node.tag = node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""
    out = []
    for item in [n for n in root.iter() if n.tag.lower() in ("item", "entry")]:
        said = lambda *names: next((" ".join("".join(n.itertext()).split()) for name in names for n in item.findall(name) if "".join(n.itertext()).strip()), None)  # noqa: B023, E731
        links = [n for n in item.findall("link") if n.get("rel", "alternate") == "alternate"]
        link = next((n.get("href") or (n.text or "").strip() for n in links), None) or item.get("HREF") or said("guid", "id")
        content = said("encoded", "content", "description", "summary", "abstract", "ABSTRACT")
        out.append({
            "title": said("title", "TITLE"), "link": link, "published": said("pubDate", "published", "date", "updated", "issued"),
            "content": content and sanitized(content),
            "categories": [n.get("term") or (n.text or "").strip() for n in item.findall("category") + item.findall("subject")],
            "enclosures": [u for n in item.findall("enclosure") + [x for x in item.findall("link") if x.get("rel") == "enclosure"] if (u := n.get("url") or n.get("href"))],
        })
    return out


def entries(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(parse_feed)

    return F.pandas_udf(run, ENTRY)(text)


def absolute(base: Column, link: Column) -> Column:
    """The link as seen from a page."""
    from urllib.parse import urljoin

    def run(bases: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([urljoin(b, k) if isinstance(b, str) and isinstance(k, str) else None for b, k in zip(bases, links)], dtype=object)

    return F.pandas_udf(run, "string")(base, link)


def sanitize(html: Column) -> Column:
    return by_row(lambda page: None if page is None else sanitized(page), "string")(html)


def decoded(raw: Column) -> Column:
    """Bytes as text: by their mark, the encoding that an XML declaration or meta tag names, UTF-8, else Latin-1."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
            if b.startswith(mark):
                return b.decode(name, "replace")
        named = re.search(rb"""(?i)(?:encoding|charset)\s*=\s*["']?([a-z0-9_-]+)""", b[:1024])
        for name in ([named[1].decode()] if named else []) + ["utf-8", "latin-1"]:
            try:
                return b.decode(name)
            except (LookupError, UnicodeDecodeError):
                continue
        return None

    def run(values: pd.Series) -> pd.Series:
        return values.map(one)

    return F.pandas_udf(run, "string")(raw)
