"""HTML bodies and entities: the parts that need a parser, as Arrow-batched functions."""

from __future__ import annotations

import html
import html.entities
import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Y

# Tags whose text is not content, and tags whose text is preferred.
SKIPPED = {"script", "style", "noscript", "svg", "nav", "header", "footer", "aside", "form", "menu"}
PREFERRED = {"article", "main"}

KINDS = dict.fromkeys(SKIPPED, ("aside",)) | dict.fromkeys(PREFERRED, ("content",))


class _Pieces(HTMLParser):
    """A page as (kinds of the listed tags around it, text without outer blanks), piece by piece. An end tag closes the innermost open tag of its kind."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.found: list[tuple[frozenset[str], str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.open += KINDS.get(tag, ())

    def handle_endtag(self, tag: str) -> None:
        for kind in KINDS.get(tag, ()):
            if kind in self.open:
                self.open.reverse()
                self.open.remove(kind)
                self.open.reverse()

    def handle_data(self, data: str) -> None:
        if text := data.strip():
            self.found.append((frozenset(self.open), text))


def body_text(source: str | None) -> str | None:
    """The text of article or main where a page has it, else of all but navigation and code."""
    if source is None:
        return None
    page = _Pieces()
    page.feed(source)
    page.close()
    content = [(kinds, text) for kinds, text in page.found if "aside" not in kinds]
    best = max((len(kinds) for kinds, _ in content), default=0)
    return " ".join(text for kinds, text in content if len(kinds) == best)


def plain(source: str | None, limit: int = 0) -> str | None:
    """Without tags, entities resolved, squeezed, cut at limit."""
    if source is None:
        return None
    text = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", source)).strip()).strip()
    return text[:limit].rstrip() if 0 < limit < len(text) else text


@F.arrow_udf(Y.StringType())
def body(source: pa.Array) -> pa.Array:
    return pa.array([body_text(x.as_py()) for x in source], pa.string())


# The references that html.unescape resolves, and what it makes of them.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_LEGACY = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def _table(names: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _numbered(digits: Column) -> Column:
    """The sign of a number as html.unescape reads it; digits are decimal, without leading zeros."""
    odd = {str(n): c for n, c in html._invalid_charrefs.items()} | {str(n): "" for n in html._invalid_codepoints if n not in html._invalid_charrefs}
    n = F.when(F.length(digits) <= 7, digits.cast("int")).otherwise(0x110000)
    sign = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(_table(odd), digits), F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").otherwise(sign))


def resolved(reference: Column) -> Column:
    """What html.unescape makes of one REFERENCE: a number's sign, a name's, or that of the longest name it begins with."""
    name = F.substr(reference, F.lit(2))
    begun = F.regexp_extract(name, f"^(?:{_LEGACY})", 0)
    named = F.coalesce(F.try_element_at(_table(html.entities.html5), name), F.when(begun != "", F.concat(F.try_element_at(_table(html.entities.html5), begun), F.substr(name, F.length(begun) + 1))), reference)
    bare = lambda pattern: F.regexp_replace(name, pattern, "")
    hexed = F.regexp_replace(bare(r"^#[xX]0*|;$"), r"^$", "0")
    decimal = F.when(F.length(hexed) <= 6, F.conv(hexed, 16, 10)).otherwise("99999999")
    number = F.when(name.rlike("^#[xX]"), decimal).otherwise(F.regexp_replace(bare(r"^#0*|;$"), r"^$", "0"))
    return F.when(reference == "&amp;", "&").when(name.startswith("#"), _numbered(number)).otherwise(named)


def content(source: Column | str) -> Column:
    """plain() of a column, without leaving the JVM: the pieces between references and what these stand for."""
    text = F.regexp_replace(source, "<[^>]+>", "")
    signs = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), resolved)
    whole = F.array_join(F.zip_with(F.split(text, REFERENCE), signs, lambda piece, sign: F.concat(piece, F.coalesce(sign, F.lit("")))), "")
    return F.trim(F.regexp_replace(whole, r"(?U)[\s\x1c-\x1f]+", " "))
