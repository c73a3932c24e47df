"""Pages as trees in columns: elements as intervals, selected by containment.

`with_tree` parses each landed page once, in Arrow batches, and adds a column: nodes, in the order of their start tags,
each with its tag, attributes, depth and the interval [start, stop) of its inside in characters; and the runs of text
with their places, entities decoded, white space collapsed, those of scripts, styles and templates left out. An end tag
closes its nearest open element and all within it, or nothing where none is open; elements left open end with what
holds them; void elements hold nothing. A node is within another if its interval is, so descendants need no parent links, and
selections, texts and nested scopes are array functions over the column, page by page, without a shuffle.

Selectors are those of style sheets as far as tags, classes, ids, attributes (named, equal to or holding a value),
descent and alternatives go. Defined cases: a null page has a null tree and no nodes; text outside of any element is there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NODE = "struct<tag:string,attributes:map<string,string>,start:int,stop:int,depth:int>"
TREE = f"struct<nodes:array<{NODE}>,texts:array<struct<at:int,text:string>>>"
# Elements without an end, and those whose text isn't shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template".split())
BLOCKS = "h1, h2, h3, p, li, blockquote, pre"


class _Parser(HTMLParser):
    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.lines = [0, *(m.end() for m in re.finditer("\n", page))]
        self.nodes, self.texts, self.open, self.hidden = [], [], [], 0
        self.feed(page)
        self.close()
        self._shut(0, len(page))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _shut(self, keep: int, at: int) -> None:
        for i in self.open[keep:]:
            self.nodes[i]["stop"] = at
            self.hidden -= self.nodes[i]["tag"] in HIDDEN
        del self.open[keep:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        start = self._at() + len(self.get_starttag_text() or "")
        self.nodes.append({"tag": tag, "attributes": dict(reversed([(k, v or "") for k, v in attrs])), "start": start, "stop": start, "depth": len(self.open)})
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)
            self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._shut(len(self.open) - 1, self.nodes[-1]["start"])

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]]["tag"] == tag:
                return self._shut(k, self._at())

    def handle_data(self, data: str) -> None:
        if not self.hidden and (text := " ".join(data.split())):
            self.texts.append({"at": self._at(), "text": text})


def parse(page: str | None) -> dict | None:
    if page is None:
        return None
    p = _Parser(page)
    return {"nodes": [n | {"attributes": list(n["attributes"].items())} for n in p.nodes], "texts": p.texts}


def with_tree(pages: DataFrame, html: str = "body", name: str = "tree") -> DataFrame:
    """pages with the column `name`."""
    schema = StructType([f for f in pages.schema.fields if f.name != name]).add(name, StructType.fromDDL(f"t {TREE}")["t"].dataType)
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):  # pages are long, trees longer
                part = batch.slice(at, 64)
                trees = pa.array([parse(p) for p in part.column(html).to_pylist()], kind.field(name).type)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in schema.fields[:-1]), trees], names=schema.names)

    return pages.select(*(f"`{f.name}`" for f in schema.fields[:-1])).mapInArrow(run, schema)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once, also where f is a function of array elements."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


_SIMPLE = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*)|\.(?P<class>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<name>[\w-]+)(?:(?P<how>\*?=)["']?(?P<value>[^"'\]]*)["']?)?\]""", re.VERBOSE)


def _matches(part: str) -> Callable[[Column], Column]:
    """A condition on nodes of one simple selector, such as a.b[href*="/c/"]."""

    def holds(x: Column) -> Column:
        out = F.lit(True)
        for m in _SIMPLE.finditer(part):
            attribute = lambda k: F.try_element_at(x["attributes"], F.lit(k))
            if m["tag"]:
                out = out & (x["tag"] == m["tag"].lower())
            elif m["class"]:
                out = out & F.array_contains(F.split(F.coalesce(attribute("class"), F.lit("")), r"\s+"), m["class"])
            elif m["id"]:
                out = out & F.coalesce(attribute("id") == m["id"], F.lit(False))
            else:
                a = attribute(m["name"].lower())
                out = out & F.coalesce(a.isNotNull() if m["how"] is None else a == m["value"] if m["how"] == "=" else F.contains(a, F.lit(m["value"])), F.lit(False))
        return out

    return holds


def within(x: Column, scope: Column) -> Column:
    """Whether a node lies in the scope's inside. A void or empty node at the very end of a scope lies outside of what follows."""
    return (x["start"] > scope["start"]) & (x["stop"] <= scope["stop"])


def select(tree: Column, selector: str, scope: Column | None = None) -> Column:
    """The nodes that match, in order; with `scope`, those in its inside (the rest of the selector may lie outside of it)."""

    def among(parts: list[str], more: list[list[str]], conditions: list[Callable[[Column], Column]]) -> Column:
        holds = _matches(parts[-1])
        if len(parts) > 1:  # what the part before selects is found once
            return let(among(parts[:-1], [], []), lambda outer: go(more, [*conditions, lambda x: holds(x) & F.exists(outer, lambda y: within(x, y))]))
        return go(more, [*conditions, holds])

    def go(more: list[list[str]], conditions: list[Callable[[Column], Column]]) -> Column:
        if more:
            return among(more[0], more[1:], conditions)
        return F.filter(tree["nodes"], lambda x: reduce(or_, (c(x) for c in conditions)))

    alternatives = [a.split() for a in selector.split(",")]
    out = go(alternatives, [])
    return out if scope is None else let(scope, lambda s: F.filter(out, lambda x: within(x, s)))


def first(tree: Column, selector: str, scope: Column | None = None) -> Column:
    return F.get(select(tree, selector, scope), F.lit(0))


def attribute(node: Column, name: str) -> Column:
    return F.try_element_at(node["attributes"], F.lit(name))


def text(tree: Column, node: Column) -> Column:
    """A node's runs of text, joined by a space."""
    return let(node, lambda n: F.array_join(F.transform(F.filter(tree["texts"], lambda t: (t["at"] >= n["start"]) & (t["at"] < n["stop"])), lambda t: t["text"]), " "))


def block_text(tree: Column, node: Column, without: str | None = None) -> Column:
    """The texts of headings, paragraphs, list items, quotes and such in a node, an empty line between two, no space before
    punctuation; an element within another such counts in both. Null without a node or text. without: a selector of what is left out."""
    gone = select(tree, without) if without else None
    runs = tree["texts"] if gone is None else let(gone, lambda g: F.filter(tree["texts"], lambda t: ~F.exists(g, lambda y: (t["at"] >= y["start"]) & (t["at"] < y["stop"]))))

    def one(kept: Column) -> Column:
        inner = lambda b: F.array_join(F.transform(F.filter(kept, lambda t: (t["at"] >= b["start"]) & (t["at"] < b["stop"])), lambda t: t["text"]), " ")
        blocks = F.transform(select(tree, BLOCKS, node), lambda b: F.regexp_replace(inner(b), r"(?U)\s+([,.;:!?])", "$1"))
        return F.array_join(F.filter(blocks, lambda b: b != ""), "\n\n")

    out = let(runs, one)
    return F.when(node.isNotNull() & (out != ""), out)


#: Everything, as a scope.
def whole(tree: Column) -> Column:
    return F.when(tree.isNotNull(), F.struct(F.lit(None).cast("string").alias("tag"), F.lit(None).cast("map<string,string>").alias("attributes"), F.lit(-1).alias("start"), F.lit((1 << 31) - 1).alias("stop"), F.lit(0).alias("depth")))
