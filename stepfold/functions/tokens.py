"""JSON as a flat array of tokens, and searches over it as column expressions.

The logs have no schema, and key order in a document matters: a search for a key looks at all keys of an
object before it goes into their values, in order. `tokens` writes one struct for each object entry or
list item, with a `place` that sorts in that order, so a search is a filter and a minimum. Key order and
repeated keys (the last one counts) rule out VARIANT, which sorts keys.

Fields of a token: path (its own), node (that of what it stands in), place (sorts in search order), ord
(document order), name (compacted key, null for list items), key, kind (dict, list, string, int, float,
bool, null), text (the value, trimmed), under_cell (whether a key of digits stands above it).
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from stepfold.functions.text import compact

TOKEN = "struct<path:string,node:string,place:string,ord:int,name:string,key:string,kind:string,text:string,under_cell:boolean>"
_FIELDS = ["path", "node", "place", "ord", "name", "key", "kind", "text", "under_cell"]
_KINDS = {dict: "dict", list: "list", str: "string", bool: "bool", int: "int", float: "float", type(None): "null"}
_WIDE = 9  # digits of an entry's number in its object or list
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]


def _shown(value: object) -> str:
    return "" if value is None else " ".join(str(value).split())


def _name(key: str) -> str:
    return re.sub("[^a-z0-9]+", "", key.lower())


def flatten(document: object) -> list[tuple]:
    """The tokens of a parsed document, in document order."""
    out: list[tuple] = []
    # what is left to visit, the next one last: value, path, place of its hops, whether below a cell
    left = [(document, "", "", False)]
    entries: dict[str, tuple] = {}
    while left:
        value, path, hops, below = left.pop()
        if path:
            out.append((*entries.pop(path), len(out)))
        inner = list(value.items()) if isinstance(value, dict) else [(None, x) for x in value] if isinstance(value, list) else []
        todo = []
        for i, (key, item) in enumerate(inner):
            at = f"{i:0{_WIDE}d}"
            own = f"{path}/{at}"
            name = None if key is None else _name(key)
            entries[own] = (own, path, f"{hops}0{at}", name, None if key is None else _shown(key), _KINDS[type(item)], _shown(item), below)
            todo.append((item, own, f"{hops}1{at}", below or bool(name and name.isdigit())))
        left += todo[::-1]
    return [(path, node, place, i, name, key, kind, text, below) for path, node, place, name, key, kind, text, below, i in out]


def _parsed(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):  # deeper than the parser goes: as if it were no JSON
        return None


def _tokens(texts: pa.Array) -> pa.Array:
    rows = [flatten(_parsed(t)) for t in texts.to_pylist()]
    flat = [r for row in rows for r in row]
    columns = [pa.array([r[i] for r in flat], kind) for i, kind in enumerate(_TYPES)]
    offsets = [0]
    for row in rows:
        offsets.append(offsets[-1] + len(row))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, _FIELDS))


def tokens(text: Column) -> Column:
    """The tokens of JSON texts, in Arrow batches; what is no JSON has none."""
    return F.arrow_udf(_tokens, f"array<{TOKEN}>")(text)


def first(doc: Column, *names: str, within: Column | None = None) -> Column:
    """The token that a search for the names finds, or null; within: below that token only.

    Of an object's entries, the first with one of the names counts; if its value is null, the object is
    left as if it were not there, with all below it.
    """
    hit = F.filter(doc, lambda t: t["name"].isin(*names) & (F.lit(True) if within is None else F.startswith(t["path"], F.concat(within["path"], F.lit("/")))))
    dead = F.filter(hit, lambda t: (t["kind"] == "null") & ~F.exists(hit, lambda o: (o["node"] == t["node"]) & (o["ord"] < t["ord"])))
    live = F.filter(hit, lambda t: (t["kind"] != "null") & ~F.exists(dead, lambda d: (t["node"] == d["node"]) | F.startswith(t["node"], F.concat(d["node"], F.lit("/")))))
    by_place = F.array_min(F.transform(live, lambda t: F.struct(t["place"].alias("place"), t.alias("t"))))
    return by_place["t"]


def strings(doc: Column) -> Column:
    """All keys and string values: an object's keys, then what its values hold, in order."""
    keys = F.transform(F.filter(doc, lambda t: t["name"].isNotNull()), lambda t: F.struct(t["place"].alias("place"), t["key"].alias("s")))
    # a value is visited by a hop into it, after all keys of its object
    visited = lambda t: F.concat(F.left(t["place"], F.length(t["place"]) - (_WIDE + 1)), F.lit("1"), F.right(t["place"], F.lit(_WIDE)))
    leaves = F.transform(F.filter(doc, lambda t: t["kind"] == "string"), lambda t: F.struct(visited(t).alias("place"), t["text"].alias("s")))
    return F.transform(F.array_sort(F.concat(keys, leaves)), lambda x: x["s"])


def cells(doc: Column) -> Column:
    """The table cells: entries with a key of digits that stand below no other; of a column, the last one."""
    found = F.filter(doc, lambda t: t["name"].rlike("^[0-9]+$") & ~t["under_cell"])
    last = F.filter(found, lambda t: ~F.exists(found, lambda o: (o["name"] == t["name"]) & (o["ord"] > t["ord"])))
    return F.transform(last, lambda t: F.struct(t["name"].alias("column"), t["kind"].alias("kind"), t["text"].alias("text")))


def requested_columns(doc: Column) -> Column:
    """The columns of all ranges; starts and ends are paired by their order, and a start without an end is one column."""

    def numbers(name: str) -> Column:
        t = F.filter(doc, lambda t: (t["name"] == name) & t["kind"].isin("int", "string", "bool", "float"))
        n = F.transform(F.array_sort(F.transform(t, lambda t: F.struct(t["place"].alias("place"), _whole(t).alias("n")))), lambda x: x["n"])
        return F.filter(n, lambda x: x.isNotNull())

    starts, ends = numbers("startcolumn"), numbers("endcolumn")
    ranges = F.transform(starts, lambda s, i: F.struct(s.alias("s"), F.coalesce(F.get(ends, i), s).alias("e")))
    every = F.flatten(F.transform(F.filter(ranges, lambda r: r["e"] >= r["s"]), lambda r: F.sequence(r["s"], r["e"])))
    return F.array_distinct(F.transform(every, lambda n: n.cast("string")))


def _whole(t: Column) -> Column:
    """The whole number that a cell holds, if it does."""
    return F.when(t["kind"] == "float", F.regexp_replace(t["text"], r"\..*$", "").try_cast("int")).when(t["kind"] == "bool", F.when(t["text"] == "True", 1).otherwise(0)).otherwise(t["text"].try_cast("int"))


def cellblock_invalid(doc: Column) -> Column:
    """Whether the first object with both `startColumn` and `endColumn` ends before it starts, or has no whole numbers."""
    start = F.filter(doc, lambda t: t["key"] == "startColumn")
    pairs = F.flatten(F.transform(start, lambda s: F.transform(F.filter(doc, lambda e: (e["key"] == "endColumn") & (e["node"] == s["node"])), lambda e: F.struct(s["node"].alias("node"), _whole(s).alias("s"), _whole(e).alias("e")))))
    first_ = F.array_min(pairs)
    return F.when(F.size(pairs) == 0, False).otherwise(F.coalesce(first_["e"] < first_["s"], F.lit(True)))


def repeated_columns(doc: Column) -> Column:
    """Whether the rows of a `values` list name a column twice."""
    held = first(doc, "values", "rowvalues")
    rows = F.filter(doc, lambda t: (t["node"] == held["path"]) & (t["kind"] == "dict"))
    columns = F.filter(doc, lambda t: t["name"].rlike("^[0-9]+$") & F.exists(rows, lambda r: r["path"] == t["node"]))
    names = F.transform(columns, lambda t: t["name"])
    return F.coalesce((held["kind"] == "list") & (F.size(names) != F.size(F.array_distinct(names))), F.lit(False))


def empty_below(doc: Column, top: Column) -> Column:
    """Whether a token is missing, null, empty text, or holds nothing else."""
    leaf = lambda t: (~t["kind"].isin("dict", "list", "null")) & ~((t["kind"] == "string") & (t["text"] == ""))
    below = F.filter(doc, lambda t: (t["path"] == top["path"]) | F.startswith(t["path"], F.concat(top["path"], F.lit("/"))))
    return top.isNull() | ~F.exists(below, leaf)


def text_of(t: Column) -> Column:
    return F.coalesce(t["text"], F.lit(""))


def compact_of(t: Column) -> Column:
    return compact(t["text"])
