"""Sections, facts and lists of crawled pages.

Which text belongs to a heading depends on nesting, which regular expressions cannot follow.
Only that step runs in Python, once per page on Arrow batches, and returns one small array;
everything after it is an expression on the array.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Executors need not have this package installed: the parser travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SECTION = T.ArrayType(
    T.StructType(
        [
            T.StructField("level", T.IntegerType()),
            T.StructField("heading", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("block", T.StringType()),
            T.StructField("body", T.StringType()),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
)

PAGES_TOGETHER = 64
# Elements without an end tag, and elements whose text is not shown.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style"}
HEADINGS = {"h1": 1, "h2": 2, "h3": 3}
# What a heading looks for behind it: a fact, a text of any kind, a list.
KINDS = {"block": {"p", "div"}, "body": {"div", "p", "ul", "ol"}, "list": {"ul"}}
BLOCKS = set().union(*KINDS.values())

# Sections of the assembled description and labels of the fact list.
DESCRIPTION_SECTIONS = [
    ("Description", ["overview", "description"]),
    ("Evaluation", ["evaluation"]),
    ("Dataset Description", ["dataset description"]),
    ("Submission File", ["submission file"]),
]
FACT_LABELS = ["Files", "Size", "Type", "License"]


class _Sections(HTMLParser):
    """Collects, per heading, the text of its following siblings and its next filled block of every kind.

    Open elements form a stack of scopes. A block's scope gathers its texts and, for a list, the paragraphs of its
    items; when it closes with text, the headings before it that still wait take it. An outer block closes
    after its inner ones and comes first in the page, so it takes their place.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.found: list[dict] = []
        self.live: list[dict] = []
        self.blocks: list[dict] = []
        self.waiting: dict[str, list[dict]] = {k: [] for k in KINDS}
        self.current: dict | None = None
        self.order = 0

    def handle_starttag(self, tag, attrs):
        depth = len(self.open)
        self.order += 1
        if tag in HEADINGS:
            self.live = [s for s in self.live if s["depth"] != depth]
            self.current = {"level": HEADINGS[tag], "depth": depth, "order": self.order, "heading": [], "text": []} | dict.fromkeys(KINDS)
            self.found.append(self.current)
            for waiting in self.waiting.values():
                waiting.append(self.current)
        elif tag in BLOCKS and (any(self.waiting[k] for k in KINDS if tag in KINDS[k]) or any(b["tag"] == "ul" for b in self.blocks)):
            self.blocks.append({"tag": tag, "depth": depth, "order": self.order, "text": [], "items": []})
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while True:
            closed = self.open.pop()
            self._closed(closed, len(self.open))
            if closed == tag:
                break

    def _closed(self, tag, depth):
        self.live = [s for s in self.live if s["depth"] <= depth]
        if self.current is not None and depth == self.current["depth"]:
            self.live.append(self.current)
            self.current = None
        while self.blocks and self.blocks[-1]["depth"] >= depth:
            self._settle(self.blocks.pop())

    def _settle(self, block):
        if not block["text"]:
            return
        if block["tag"] == "p":
            for outer in self.blocks:
                if outer["tag"] == "ul" and "li" in self.open[outer["depth"] + 1 : block["depth"]]:
                    outer["items"].append((block["order"], "".join(block["text"])))
        for kind, tags in KINDS.items():
            if block["tag"] not in tags:
                continue
            still = []
            for s in self.waiting[kind]:
                if s["order"] < block["order"]:
                    s[kind] = block
                # A block that is still open and began behind the heading comes before this one.
                if s["order"] > block["order"] or any(b["order"] > s["order"] and b["tag"] in tags for b in self.blocks):
                    still.append(s)
            self.waiting[kind] = still

    def handle_data(self, data):
        text = data.strip()
        if not text or (self.open and self.open[-1] in HIDDEN):
            return
        if self.current is not None:
            self.current["heading"].append(text)
        for s in self.live:
            s["text"].append(text)
        for b in self.blocks:
            b["text"].append(text)

    def result(self) -> list[dict]:
        while self.open:
            self._closed(self.open.pop(), len(self.open))
        return [
            {
                "level": s["level"],
                "heading": "".join(s["heading"]),
                "text": " ".join(" ".join(s["text"]).split()),
                "block": "".join(s["block"]["text"]) if s["block"] else None,
                "body": "\n".join(s["body"]["text"]) if s["body"] else None,
                "items": [text for _, text in sorted(s["list"]["items"])] if s["list"] else [],
            }
            for s in self.found
        ]


def page_sections(html: str | None) -> list[dict]:
    parser = _Sections()
    parser.feed(html or "")
    parser.close()
    return parser.result()


def parsed(html: pa.Array) -> pa.Array:
    """The sections of a batch; only PAGES_TOGETHER pages at a time are Python objects."""
    kind = to_arrow_type(SECTION)
    starts = range(0, len(html), PAGES_TOGETHER)
    done = [pa.array([page_sections(x) for x in html.slice(s, PAGES_TOGETHER).to_pylist()], kind) for s in starts]
    return pa.concat_arrays(done) if done else pa.array([], kind)


@F.arrow_udf(SECTION)
def sections(html: pa.Array) -> pa.Array:
    return parsed(html)


def section_text(found: Column, names: Sequence[str]) -> Column:
    """Text of the first section per name, the first name with text wins; empty when none has."""
    texts = []
    for name in names:
        hits = F.filter(found, lambda s: F.startswith(F.lower(s["heading"]), F.lit(name.lower())))
        texts.append(F.nullif(F.try_element_at(hits, F.lit(1))["text"], F.lit("")))
    return F.coalesce(*texts, F.lit(""))


def description(found: Column) -> Column:
    """The named sections as Markdown; sections without text are left out."""
    parts = []
    for title, names in DESCRIPTION_SECTIONS:
        text = section_text(found, names)
        parts.append(F.when(text != "", F.concat(F.lit(f"## {title}\n\n"), text)))
    return F.concat_ws("\n\n", *parts)


def _first(found: Column, wanted) -> Column:
    return F.try_element_at(F.filter(found, lambda s: (s["level"] == 2) & wanted(s["heading"])), F.lit(1))


def facts(found: Column, labels: Sequence[str] = FACT_LABELS, described: str = "dataset description") -> Column:
    """Map of ``dataset_description`` and the lower-case labels to the block that follows their heading.

    The description is the next text of any kind behind the first heading that holds its name, line by line; a
    fact is the next paragraph or division behind the heading of that very name. Absent ones have no entry.
    """
    body = _first(found, lambda h: F.contains(F.lower(h), F.lit(described)))["body"]
    entries = [F.struct(F.lit("dataset_description").alias("k"), body.alias("v"))]
    for label in labels:
        block = _first(found, lambda h, label=label: h == F.lit(label))["block"]
        entries.append(F.struct(F.lit(label.lower()).alias("k"), block.alias("v")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))


def listed(found: Column, name: str = "data explorer") -> Column:
    """The paragraphs of the items of the list behind the first heading that holds ``name``; empty when absent."""
    items = _first(found, lambda h: F.contains(F.lower(h), F.lit(name)))["items"]
    return F.coalesce(items, F.array().cast("array<string>"))
