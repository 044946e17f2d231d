"""Regex forms for flat markup, without Python."""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST_BARE = max(len(n) for n in html5 if not n.endswith(";"))


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str]:
    """The standard names as JSON: those with a semicolon by first letter, and those that need none."""
    by_letter: dict[str, dict[str, str]] = {}
    bare = {}
    for name, char in html5.items():
        char = char.replace("\u00a0", " ")
        if name.endswith(";"):
            by_letter.setdefault(name[0], {})[name[:-1]] = char
        else:
            bare[name] = char
    return json.dumps(by_letter), json.dumps(bare)


def _named(piece: Column) -> Column:
    """What follows ``&``: the character of its name and the rest, or all as it was."""
    by_letter, bare = _tables()
    names = F.from_json(F.lit(by_letter), "map<string,map<string,string>>")
    name = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]+);", 1)
    char = F.try_element_at(F.try_element_at(names, F.substring(name, 1, 1)), name)
    rest = F.substr(piece, F.length(name) + 2)
    out = F.when(char.isNotNull(), F.concat(char, rest))
    # A few old names are also read without their semicolon, the longest first.
    old = F.from_json(F.lit(bare), "map<string,string>")
    word = F.regexp_extract(piece, f"^[A-Za-z0-9]{{2,{LONGEST_BARE}}}", 0)
    for n in range(LONGEST_BARE, 1, -1):
        char = F.try_element_at(old, F.substring(word, 1, n))
        out = out.when((F.length(word) >= n) & char.isNotNull(), F.concat(char, F.substr(piece, F.lit(n + 1))))
    return out.otherwise(F.concat(F.lit("&"), piece))


def _numeric(piece: Column) -> Column:
    """What follows ``&#``: the character of its number and the rest, or all as it was."""
    digits = F.regexp_extract(piece, r"^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6})(?=[^0-9a-fA-F]|$)", 1)
    is_hex = F.lower(F.substring(digits, 1, 1)) == "x"
    code = F.when(is_hex, F.substring(digits, 2, 9)).otherwise(F.hex(digits.try_cast("bigint")))
    point = F.conv(code, 16, 10).try_cast("bigint")
    known = (digits != "") & (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    rest = F.regexp_replace(piece, r"^[0-9a-zA-Z]+;?", "")
    space = F.when(point == 160, F.lit(" ")).otherwise(char)
    return F.when(known, F.concat(space, rest)).otherwise(F.concat(F.lit("&#"), piece))


def decode_entities(text: Column) -> Column:
    """Numeric and named entities as characters, from one split; a hard space becomes a plain one."""
    pieces = F.split(text, "&", -1)

    def decoded(piece: Column) -> Column:
        return F.when(F.startswith(piece, F.lit("#")), _numeric(F.substr(piece, F.lit(2)))).otherwise(_named(piece))

    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decoded)
    return F.when(F.contains(text, F.lit("&")), F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))).otherwise(text)


def strip_tags(html: Column) -> Column:
    """Visible text: no scripts, styles, comments or tags, white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[/!?a-zA-Z][^>]*>", " ")
    return F.trim(F.regexp_replace(decode_entities(text), r"\s+", " "))


def first_heading(html: Column) -> Column:
    """Text of the first h1, empty when absent."""
    return strip_tags(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))


def list_items(html: Column) -> Column:
    """Texts of the li elements; empty ones are dropped."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1))
    return F.filter(F.transform(raw, strip_tags), lambda x: x != "")
