"""Personal data, also where it is disguised: offset-preserving deobfuscation.

Identifiers are first found in the text as it stands (the base spans, by the fixed patterns below).
All texts then pass through rewriting transducers, each of which keeps for every character that it
writes the source characters it stands for:
  1. look-alikes of ASCII characters become these, invisible characters go;
  2. spelled digits in a row (English, German, French or Spanish) become digits, and `plus` before a digit a plus sign;
  3. `[at]`, `(dot)` and the like, and the bare words in `name at host dot org`, become @ and full stops.
A disguise may go over the end of a line.
Where that changes a text, the same detectors run over the rewritten one, and what they find is mapped
back to source characters. Found spans that overlap a base span of their kind add nothing; base spans always stay.

The counts and base_sha256 are of base spans; `spans` has all, and n_hidden says how many were added.

Defined cases: a null text is empty; an empty text has no spans, counts of 0 and the hash of the empty
string; whole texts are read, however long; equal texts get equal results; a null id passes through;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import lean

KINDS = ("email", "ip", "card", "phone")
Spans = list[tuple[int, int]]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9][0-9.]*")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Spans:
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((start, host.end()))
            pos = host.end()
        at = text.find("@", max(at + 1, pos))
    return out


def ips(text: str) -> Spans:
    out = []
    for chain in _NUMBERS.finditer(text):
        if chain.end() - chain.start() > 6:
            for m in _QUAD.finditer(text, chain.start(), chain.end()):
                parts = [p.lstrip("0") for p in m.group().split(".")]
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                    out.append(m.span())
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str) -> Spans:
    out = []
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> Spans:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15] if "+" in text else []


DETECT: dict[str, Callable[[str], Spans]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# Letters of other scripts that look like ASCII letters, and the names of digits.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ɡ": "g",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ѕ": "S", "Ј": "J",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ω": "w", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ⅼ": "l", "∂": "d", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "。": ".", "·": ".",
}
# The names of the digits, and of plus, at and dot, in English, German, French and Spanish.
NAMES = {
    "0": "zero oh null zéro cero", "1": "one eins un une uno", "2": "two zwei deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf fuenf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
PLUS = "plus|más|mas"
AT = "at|ät|arroba|arobase"
DOT = "dot|punkt|point|punto"
DIGITS = {w: d for d, words in NAMES.items() for w in words.split()}

_NAMES = "|".join(sorted(DIGITS, key=len, reverse=True))
#: White space within a disguise: on a line, or over the end of one.
_S = r"(?:[ \t]+(?:\r?\n[ \t]*)?|\r?\n[ \t]*)"
_ODD = re.compile("[­²³·¹ıɑ-ʯͰ-ԯ​-‍‐-–․⁠⁰-₟℀-↏∂−①-⓿。﻿！-～\U0001d400-\U0001d7ff]")
_INVISIBLE = frozenset("­​‌‍⁠﻿")


@lru_cache(4096)
def plain(c: str) -> str:
    """The ASCII character that `c` looks like, none for an invisible one, or `c` itself."""
    if c in _INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and n.isascii() else c


class Rewritten:
    """A text and, for each of its characters, the start and end of the source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, [], []
        self.changed = False

    def rewrite(self, pattern: re.Pattern, become: Callable[[re.Match], str | None], before: str = "") -> None:
        """Replace each match, and characters of `before` ahead of it, by what `become` gives for it; None, or the same again, leaves it."""
        text, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = become(m)
            if new is None or new == m.group():
                continue
            if not self.changed:
                self.changed, n = True, len(self.text)
                self.start, self.end = list(range(n)), list(range(1, n + 1))
            i, j = m.span()
            while i > at and self.text[i - 1] in before:
                i -= 1
            text += [self.text[at:i], new]
            start += self.start[at:i] + [self.start[i]] * len(new)
            end += self.end[at:i] + [self.end[j - 1]] * len(new)
            at = j
        if at:
            self.text, self.start, self.end = "".join([*text, self.text[at:]]), start + self.start[at:], end + self.end[at:]

    def source(self, span: tuple[int, int]) -> tuple[int, int]:
        return self.start[span[0]], self.end[span[1] - 1]


_NAME = rf"(?:{_NAMES})(?![^\W_])"
_RUN = re.compile(rf"(?i)(?<![^\W_])(?:(?:(?:{PLUS})(?:-|{_S}))?{_NAME}(?:(?:{_S}?[-,]{_S}?|{_S}){_NAME})*|(?:{PLUS}){_S}(?=[0-9]))")
_PLUS = re.compile(f"(?i)(?:{PLUS})")
_TOKEN = re.compile(rf"(?i)(?<![^\W_])(?:{_NAMES})(?![^\W_])")
_BRACKETED = re.compile(rf"(?i)[\[({{<][ \t]*({AT}|{DOT})[ \t]*[\])}}>][ \t]*")
_LABEL = "[A-Za-z0-9-]++"
_BARE = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++(?:{_S}(?:{DOT}){_S}[A-Za-z0-9_%+-]++)*+)(?:{_S}(?:{AT}){_S}|[ \t]*@[ \t]*)({_LABEL}(?:(?:{_S}(?:{DOT}){_S}|\.){_LABEL})++)")
_DOT = re.compile(rf"(?i){_S}(?:{DOT}){_S}")
_QUAD_WORDS = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?:(?:[ \t]*\.[ \t]*|{_S}(?:{DOT}){_S})[0-9]{{1,3}}){{3}}(?![0-9])")
_TOP = re.compile(r"[A-Za-z]{2,}")


def _digits(m: re.Match) -> str | None:
    said = _TOKEN.findall(m.group())
    plus = "+" if _PLUS.match(m.group()) else ""
    if not said:
        return plus or None
    return plus + "".join(DIGITS[w.lower()] for w in said)


def _bare(m: re.Match) -> str | None:
    host = _DOT.sub(".", m.group(2))
    told = _DOT.search(m.group()) and _TOP.fullmatch(host.rpartition(".")[2])
    return _DOT.sub(".", m.group(1)) + "@" + host if told else None


def deobfuscate(text: str) -> Rewritten:
    r = Rewritten(text)
    if not text.isascii():
        r.rewrite(_ODD, lambda m: None if (p := plain(m.group())) == m.group() else p)
    r.rewrite(_RUN, _digits)
    r.rewrite(_BRACKETED, lambda m: "@" if m.group(1).lower() in AT.split("|") else ".", before=" \t")
    r.rewrite(_BARE, _bare)
    r.rewrite(_QUAD_WORDS, lambda m: ".".join(re.findall("[0-9]+", m.group())))
    return r


def find(text: str | None) -> tuple[dict[str, Spans], dict[str, Spans]]:
    """The base spans of each kind, and those that deobfuscation adds."""
    text = text or ""
    base = {k: f(text) for k, f in DETECT.items()}
    more: dict[str, Spans] = {k: [] for k in KINDS}
    r = deobfuscate(text)
    if r.changed:
        for k, f in DETECT.items():
            held = sorted(base[k])
            for i, j in map(r.source, f(r.text)):
                if not any(a < j and i < b for a, b in held):
                    more[k].append((i, j))
                    held.append((i, j))
    return base, more


def _joined(spans: dict[str, Spans]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k in KINDS for i, j in sorted(spans[k]))


_OUT = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_hidden"]


def digest(text: str | None) -> tuple:
    base, more = find(text)
    every = {k: base[k] + more[k] for k in KINDS}
    return (*(len(base[k]) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), sum(map(len, more.values())))


def _digests(text: pa.Array) -> pa.Array:
    rows = [digest(t) for t in text.to_pylist()]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _OUT)


def report(docs: DataFrame) -> DataFrame:
    lean(docs.sparkSession)
    kind = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_hidden long"
    return docs.select("doc_id", F.arrow_udf(_digests, kind)(F.col("text")).alias("r")).select("doc_id", *[f"r.{c}" for c in _OUT])


def mask(text: str | None) -> str | None:
    """The text with each found span replaced by the name of its kind."""
    if text is None:
        return None
    base, more = find(text)
    out, at = [], 0
    for i, j, k in sorted((i, j, k) for k in KINDS for i, j in base[k] + more[k]):
        if i >= at:
            out += [text[at:i], f"<{k}>"]
            at = j
    return "".join([*out, text[at:]])
