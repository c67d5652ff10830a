"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme, authority after //, path, query and fragment; every string matches.
PARTS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def parts(url: Column) -> dict[str, Column]:
    """scheme (lower-case), host, path, query and fragment, '' where absent; any of them may be."""
    out = {name: F.regexp_extract(url, PARTS, k) for k, name in enumerate(("scheme", "host", "path", "query", "fragment"), 1)}
    return out | {"scheme": F.lower(out["scheme"])}


def recompose(p: dict[str, Column]) -> Column:
    """The URL of its parts; // stands before a host, and after file: also without one."""
    some = lambda c, text: F.when(c != "", text).otherwise("")
    host = F.when((p["host"] != "") | (p["scheme"] == "file"), F.concat(F.lit("//"), p["host"])).otherwise("")
    return F.concat(some(p["scheme"], F.concat(p["scheme"], F.lit(":"))), host, p["path"], some(p["query"], F.concat(F.lit("?"), p["query"])), some(p["fragment"], F.concat(F.lit("#"), p["fragment"])))


def unwrap_cached(url: Column) -> Column:
    """The page behind a cached result (q=cache:id:host/path+terms), else the URL itself."""
    inner = F.regexp_extract(url, "q=cache:[^:]*:([^+&]*)", 1)
    return F.when(inner != "", F.concat(F.lit("http://"), inner)).otherwise(url)


def status(url: Column, rules: list[tuple[str, str]]) -> Column:
    """Reason of the first rule whose text the URL holds, else 'ok'."""
    out = F.lit("ok")
    for text, reason in reversed(rules):
        out = F.when(url.contains(text), reason).otherwise(out)
    return out


def good(url: Column, fragments: list[str]) -> Column:
    """Starts with http in any case and holds no fragment after its first character; all are good without fragments."""
    if not fragments:
        return F.lit(True)
    out = F.lower(F.substring(url, 1, 4)) == "http"
    for fragment in fragments:
        out = out & ~(F.locate(fragment, url) > 1)
    return out


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, "[.]html?$", "")


def unquoted(url: Column) -> Column:
    """Without one pair of double quotes around it."""
    return F.regexp_replace(url, '^"(.*)"$', "$1")


def in_text(line: Column) -> Column:
    """The URL that a line of free text is, or null: lines with http: as they are, with www. or a common ending
    after http:// is put before them."""
    bare = line.contains("www.") | line.contains(".com") | line.contains(".net") | line.contains(".org")
    return F.when(line.contains("http:"), line).when(bare, F.concat(F.lit("http://"), line))


def links_in(page: Column) -> Column:
    """Targets of href attributes; of a page without any, bare http addresses. Style sheets are left out."""
    quoted = F.regexp_extract_all(page, F.lit(r"""href="([^"\s]*)\""""), F.lit(1))
    plain = F.regexp_extract_all(page, F.lit(r"""(https?://[^\s"'<>]+)"""), F.lit(1))
    return F.filter(F.when(F.size(quoted) > 0, quoted).otherwise(plain), lambda u: ~u.contains(".css"))
