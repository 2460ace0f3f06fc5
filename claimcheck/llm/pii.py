"""Find personal data, disguised or not, and report it where it stands in the source text.

A transducer rewrites disguises (look-alike characters, spelled digits, "at" and "dot") and
records for every rewritten piece where it came from. The same detectors run over the source
and over the rewritten text; spans of the latter are mapped back to source characters.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructField, StructType

from claimcheck.llm.byte_bpe import slices

KINDS = ["email", "ip", "card", "phone"]

# Letters of other scripts that look like ASCII ones.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ӏ": "l", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "г": "r", "п": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ɑ": "a", "ⅼ": "l", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
    "。": ".", "·": ".", "•": ".", "∙": ".",
}
INVISIBLE = "\xad​‌‍‎‏⁠﻿"
DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits can only match from its first digit on, so no other start is tried.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_WORD = "(?:" + "|".join(DIGIT_WORDS) + ")"
_DOT_AHEAD = r"(?=[A-Za-z0-9-]{1,63}(?:\.[A-Za-z]{2}|[ \t]{1,3}dot[ \t]|[ \t]{0,3}[\[({<][ \t]{0,3}(?:dot|\.)[ \t]{0,3}[\])}>]))"
DISGUISE = re.compile(
    r"(?P<at>[ \t]{0,3}[\[({<][ \t]{0,3}(?:at|@)[ \t]{0,3}[\])}>][ \t]{0,3}|[ \t]{1,3}at[ \t]{1,3}" + _DOT_AHEAD + r")"
    r"|(?P<dot>[ \t]{0,3}[\[({<][ \t]{0,3}(?:dot|\.)[ \t]{0,3}[\])}>][ \t]{0,3}|(?<=[A-Za-z0-9])[ \t]{1,3}dot[ \t]{1,3}(?=[A-Za-z0-9]))"
    rf"|(?P<digits>\b(?:plus[ -]{{1,3}})?{_WORD}(?:[ -]{{1,3}}{_WORD})*\b)",
    re.I,
)


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; every match has an @, so only the characters around each @ are read."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of everything the base patterns find, in order of start, then kind."""
    found = [(s, e, "email") for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=_place)


def _place(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


@functools.cache
def look_alike(char: str) -> str | None:
    """The ASCII character that `char` stands for, '' for an invisible one, None for itself."""
    if char in INVISIBLE:
        return ""
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    decimal = unicodedata.decimal(char, None)
    if decimal is not None:
        return str(decimal)
    plain = unicodedata.normalize("NFKC", char)
    return plain if len(plain) == 1 and plain.isascii() else None


@dataclass
class Rewritten:
    """Rewritten text as runs: run i begins at out[i] there and at source[i] here; a `changed` run is one piece."""

    text: str
    out: list[int]
    source: list[int]
    changed: list[bool]

    def back(self, start: int, end: int) -> tuple[int, int] | None:
        """The source span of a rewritten span, None if nothing in it was rewritten."""
        first, last = bisect_right(self.out, start) - 1, bisect_right(self.out, end - 1) - 1
        if not any(self.changed[first : last + 1]):
            return None
        begin = self.source[first] if self.changed[first] else self.source[first] + start - self.out[first]
        stop = self.source[last + 1] if self.changed[last] else self.source[last] + end - self.out[last]
        return begin, stop


def _rewrite(text: str, pieces: Iterator[tuple[int, int, str]]) -> Rewritten | None:
    """Replace the pieces (start, end, replacement), which come in order."""
    parts, out, source, changed = [], [], [], []
    at = length = 0
    for start, end, new in pieces:
        for begin, stop, content, is_new in ((at, start, text[at:start], False), (start, end, new, True)):
            if begin < stop:
                parts.append(content)
                out.append(length)
                source.append(begin)
                changed.append(is_new)
                length += len(content)
        at = end
    if not any(changed):
        return None
    parts.append(text[at:])
    return Rewritten("".join(parts), [*out, length], [*source, at], [*changed, False])


def unmasked(text: str) -> Rewritten | None:
    """First transducer: look-alike and invisible characters."""
    if text.isascii():
        return None
    stand_ins = {c: look_alike(c) for c in set(text) if c > "\x7f"}
    stand_ins = {c: new for c, new in stand_ins.items() if new is not None}
    if not stand_ins:
        return None
    found = re.finditer("[" + re.escape("".join(stand_ins)) + "]", text)
    return _rewrite(text, ((m.start(), m.end(), stand_ins[m[0]]) for m in found))


def _disguises(text: str) -> Iterator[tuple[int, int, str]]:
    for m in DISGUISE.finditer(text):
        if m["at"]:
            yield m.start(), m.end(), "@"
        elif m["dot"]:
            yield m.start(), m.end(), "."
        else:
            plus = m[0][:4].lower() == "plus"
            at = m.start()
            for word in re.finditer(_WORD, m[0], re.I):
                # A capital I with its dot counts as an i, and leaves the dot behind in lower case.
                new = str(DIGIT_WORDS.index(word[0].lower().replace("\u0307", "")))
                yield at, m.start() + word.end(), "+" + new if plus and at == m.start() else new
                at = m.start() + word.end()


def spelled_out(text: str) -> Rewritten | None:
    """Second transducer: at, dot and digits in words. A digit takes the gap to the digit word before it."""
    return _rewrite(text, _disguises(text))


def hidden(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that appear only in rewritten text, as source spans; none that the base patterns have."""
    first = unmasked(text)
    second = spelled_out(first.text if first else text)
    known, found = set(base), set()
    for rewritten in (first, second):
        if rewritten is None:
            continue
        for start, end, kind in detect(rewritten.text):
            span = rewritten.back(start, end)
            if rewritten is second and first is not None:
                inner = (start, end) if span is None else span
                if span is None:
                    inner = _plain_back(second, start, end)
                span = first.back(*inner) or (None if span is None else _plain_back(first, *inner))
            if span and (*span, kind) not in known:
                found.add((*span, kind))
    return sorted(found, key=_place)


def _plain_back(rewritten: Rewritten, start: int, end: int) -> tuple[int, int]:
    """The source span of a rewritten span in which no piece was rewritten."""
    run = bisect_right(rewritten.out, start) - 1
    shift = rewritten.source[run] - rewritten.out[run]
    return start + shift, end + shift


def find_pii(docs: DataFrame) -> DataFrame:
    """`docs` with base_spans and hidden_spans: arrays of (start, end, kind), in code points, end exclusive.

    Null text has no spans. Other columns pass through; columns of the two names are replaced.
    """
    docs = docs.drop("base_spans", "hidden_spans")
    span = StructType().add("start", "integer").add("end", "integer").add("kind", "string")
    schema = StructType([*docs.schema, StructField("base_spans", ArrayType(span)), StructField("hidden_spans", ArrayType(span))])
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda found: [dict(zip(("start", "end", "kind"), x)) for x in found]
        for batch in slices(batches, "text"):
            base, more = [], []
            for text in batch.column("text").to_pylist():
                plain = detect(text or "")
                base.append(named(plain))
                more.append(named(hidden(text or "", plain)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(base, spans), pa.array(more, spans)],
                [*batch.schema.names, "base_spans", "hidden_spans"],
            )

    return docs.mapInArrow(run, schema)


def redacted(text: str) -> str:
    """`text` with every found span replaced by its kind in angle brackets; overlapping spans become one."""
    base = detect(text)
    parts, at = [], 0
    for start, end, kind in sorted({*base, *hidden(text, base)}):
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with redacted texts. Null text stays null; all other columns, whatever their names, pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = pa.array([t and redacted(t) for t in batch.column("text").to_pylist()], pa.string())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)

    return docs.mapInArrow(run, docs.schema)
