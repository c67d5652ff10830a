"""HTML: regular-expression forms in the JVM, and a parser in Python where a tree is needed."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import by_row


def hrefs(html: Column) -> Column:
    """Targets of anchors, whatever other attributes they have."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?\shref="([^"]*)"'), F.lit(1))


def meta_attributes(html: Column) -> Column:
    """array<struct<name, value>> of the attributes of the first meta tag."""
    tag = F.regexp_extract(html, r"(?i)<meta\s([^>]*)>", 1)
    whole = F.regexp_extract_all(tag, F.lit(r'([a-zA-Z:-]+="[^"]*")'), F.lit(1))
    return F.transform(whole, lambda a: F.struct(F.regexp_extract(a, '^([^=]*)="(.*)"$', 1).alias("name"), F.regexp_extract(a, '^([^=]*)="(.*)"$', 2).alias("value")))


def blocks(html: Column) -> Column:
    """Paragraphs and block quotes with all that is in them, each from its start tag to the next end tag of its kind."""
    return F.regexp_extract_all(html, F.lit(r"(?is)(<p(?:\s[^>]*)?>.*?</p>|<blockquote(?:\s[^>]*)?>.*?</blockquote>)"), F.lit(1))


_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Skipping(HTMLParser):
    """Leaves out script, style, rdf and form with all in them; one that is never closed ends where its parent does."""

    DROPPED = {"script", "style", "rdf", "form"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []  # tags that are open, outermost first

    @property
    def hidden(self) -> bool:
        return any(t in self.DROPPED for t in self.open)

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.open.append(tag)
        if not self.hidden:
            self.begin(tag, dict(attrs), self.get_starttag_text() or "")

    def handle_endtag(self, tag):
        known = tag in self.open
        if known:
            hidden = self.hidden
            while self.open.pop() != tag:
                pass
            if not hidden:
                self.finish(tag)

    def handle_data(self, data):
        if not self.hidden:
            self.say(data)

    def begin(self, tag, attrs, source):
        pass

    def finish(self, tag):
        pass

    def say(self, data):
        pass


class _Nodes(_Skipping):
    def __init__(self):
        super().__init__()
        self.nodes: list[str] = []

    def say(self, data):
        if data.strip():
            self.nodes.append(data.strip())


class _Clean(_Skipping):
    def __init__(self):
        super().__init__()
        self.out: list[str] = []

    def begin(self, tag, attrs, source):
        self.out.append(source)

    def finish(self, tag):
        self.out.append(f"</{tag}>")

    def say(self, data):
        self.out.append(escape(data, quote=False))


def _fed(parser: HTMLParser, html: str | None):
    parser.feed(html or "")
    parser.close()
    return parser


def parse_nodes(html: str | None) -> list[str]:
    return _fed(_Nodes(), html).nodes


def clean_html(html: str | None) -> str:
    return "".join(_fed(_Clean(), html).out)


def cleaned(html: Column) -> Column:
    """The page without script, style, rdf, form, comments and declarations, end tags put right."""

    return by_row(clean_html, "string")(html)


def text_nodes(html: Column) -> Column:
    """Text nodes outside script, style, rdf and form, entities resolved."""

    return by_row(parse_nodes, "array<string>")(html)


def keyword_nodes(html: Column, term: str) -> Column:
    """The text nodes that hold the term in any case."""
    return F.filter(text_nodes(html), lambda n: F.contains(F.lower(n), F.lit(term.lower())))


class _Markdown(_Skipping):
    MARKS = {"em": "_", "i": "_", "b": "**", "strong": "**"}

    def __init__(self):
        super().__init__()
        self.out: list[str] = []
        self.links: list[str] = []
        self.hrefs: list[str | None] = []  # of open anchors
        self.lists: list[int | None] = []  # next number of open lists; None: bullets

    def begin(self, tag, attrs, source):
        if tag in self.MARKS:
            self.out.append(self.MARKS[tag])
        elif tag[:1] == "h" and tag[1:].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1:]) + " ")
        elif tag in ("ul", "ol"):
            self.out.append("" if self.lists else "\n")
            self.lists.append(1 if tag == "ol" else None)
        elif tag in ("p", "div"):
            self.out.append("\n\n")
        elif tag == "li":
            number = self.lists[-1] if self.lists else None
            self.out.append("\n" + "  " * max(1, len(self.lists)) + ("* " if number is None else f"{number}. "))
            if number is not None:
                self.lists[-1] = number + 1
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n* * *\n\n")
        elif tag == "pre":
            self.out.append("\n\n    ")
        elif tag == "blockquote":
            self.out.append("\n\n" + "> " * self.open.count("blockquote"))
        elif tag == "a":
            self.hrefs.append(attrs.get("href"))
            if attrs.get("href"):
                self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{attrs.get('alt') or ''}]({attrs.get('src') or ''})")

    def finish(self, tag):
        if tag in self.MARKS:
            self.out.append(self.MARKS[tag])
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "a" and self.hrefs and (href := self.hrefs.pop()):
            self.links.append(href)
            self.out.append(f"][{len(self.links)}]")

    def say(self, data):
        if "pre" in self.open:
            self.out.append(data.replace("\n", "\n    "))
        elif data.strip():
            before, after = data[0].isspace(), data[-1].isspace()
            self.out.append(" " * before + " ".join(data.split()) + " " * after)
        elif data:
            self.out.append(" ")


def to_markdown(html: str | None) -> str:
    parser = _fed(_Markdown(), html)
    lines = "".join(parser.out).strip()
    return lines + "".join(f"\n   [{i}]: {url}" for i, url in enumerate(parser.links, 1))


def markdown(html: Column) -> Column:
    return by_row(to_markdown, "string")(html)
