"""Text and protocol-value functions over columns; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(x: Column) -> Column:
    """Trimmed, with runs of white space as one space; null is empty."""
    return F.coalesce(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), F.lit(""))


def lowered(x: Column) -> Column:
    return F.lower(norm(x))


def compact(x: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "")


def contains_text(strings: Column, needle: str) -> Column:
    """Whether any of the strings holds the needle, both compacted."""
    want = "".join(c for c in needle.lower() if c.isascii() and c.isalnum())
    return F.exists(strings, lambda s: F.contains(compact(s), F.lit(want)))


def ids_equivalent(a: Column, b: Column) -> Column:
    """Equal when compacted, or as hexadecimal numbers of any length (an 0x may lead)."""
    x, y = compact(a), compact(b)
    bare = lambda v: F.regexp_replace(v, "^0x", "")
    is_hex = lambda v: bare(v).rlike("^[0-9a-f]+$")
    digits = lambda v: F.ltrim(bare(v), F.lit("0"))
    return (x != "") & (y != "") & ((x == y) | (is_hex(x) & is_hex(y) & (digits(x) == digits(y))))


def challenge_malformed(challenge: Column) -> Column:
    """A challenge in hex must have 64 digits, any other 4 characters; none at all is well-formed."""
    c = F.regexp_replace(F.coalesce(challenge, F.lit("")), r"(?U)\s+", "")
    return F.when(c == "", False).when(c.rlike("^[0-9a-fA-F]+$"), F.length(c) != 64).otherwise(F.length(c) < 4)


def bool_invalid(kind: Column, text: Column) -> Column:
    """Whether a cell (its JSON type and text) is no known spelling of a boolean."""
    return ~F.when(kind == "bool", True).when(kind == "int", text.isin("0", "1")).otherwise(compact(text).isin("0", "1", "t", "f", "true", "false"))


def bool_truthy(kind: Column, text: Column) -> Column:
    return F.when(kind == "int", text == "1").otherwise(compact(text).isin("1", "t", "true"))


def payloads_equivalent(actual: Column, expected: Column) -> Column:
    a, e = compact(actual), compact(expected)
    return (a != "") & (e != "") & ((a == e) | (a == F.concat(F.lit("pattern"), e)))


def unique(items: Column) -> Column:
    """Distinct non-empty items in the order of their first appearance."""
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def trailing_index(name: Column) -> Column:
    return F.regexp_extract(name, r":(\d+)$", 1).try_cast("int")


def relation_name(name: Column) -> Column:
    """The second of the parts between colons, or the whole name without one."""
    return F.when(F.contains(name, F.lit(":")), F.split_part(name, F.lit(":"), F.lit(2))).otherwise(name)


def case_number(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"^(?:tc)?(\d+)", 1).try_cast("int")


def event_signature(method: Column, invoking: Column, status: Column) -> Column:
    shown = lambda x: F.when(F.coalesce(x, F.lit("")) == "", "?").otherwise(x)
    return F.format_string("%s(%s) -> %s", shown(method), shown(invoking), shown(status))


def truncated(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def is_subset(inner: Column, outer: Column | Sequence[str]) -> Column:
    outer = outer if isinstance(outer, Column) else F.array(*[F.lit(x) for x in outer]).cast("array<string>")
    return F.size(F.array_except(inner, outer)) == 0


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


# --- scores ------------------------------------------------------------------------------------


def p_fail(pass_logit: Column, fail_logit: Column) -> Column:
    """The softmax share of the second of two logits."""
    return 1 / (1 + F.exp(pass_logit - fail_logit))


def two_way_label(pass_logit: Column, fail_logit: Column) -> Column:
    return F.when(p_fail(pass_logit, fail_logit) > 0.5, "fail").otherwise("pass")


def answer_label(answer: Column) -> Column:
    """The label that a written answer names; `fail` wins, and none means pass."""
    return F.when(F.contains(F.lower(answer), F.lit("fail")), "fail").otherwise("pass")


def binary_entropy(p: Column) -> Column:
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log(p) + (1 - p) * F.log(1 - p)))
