"""Personal data in whole texts, disguised or not, with spans in the source's own code points.

Plain identifiers are found on the text itself. Then a chain of transducers rewrites disguises: look-alike letters and
wide forms to ASCII, invisible characters to nothing, spelled digits to digits, written-out at and dot signs to the
signs. Each output character keeps the source span it came from, so an identifier found in the rewritten text maps back
to the source characters that spell it. Found spans are added unless they lie within a span of their kind.

Kinds, in order: email, ip, card, phone. A match that fails its check (parts at most 255; 16 to 19 digits and Luhn; 8 to
15 digits) is dropped and not tried again from elsewhere.

Defined cases: a null text counts as empty and has no spans; a null id stays null; repeated rows are searched each; an
empty table gives no rows; other columns are kept by mask() and not read by find().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workdir import prepare

KINDS = ("email", "ip", "card", "phone")
FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# an email is sought from its sign: the part before it is the whole run of its characters, back to the last match's end
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a match can only start where a run of digits does; said outright, long runs cost no second look
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """(kind, start, end) of undisguised identifiers, by kind and start."""
    out: list[Span] = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = at = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                last = m.end()
    if not (digit := _DIGIT.search(text)):
        return out
    first = digit.start()
    out += [(1, *m.span()) for m in _IP.finditer(text, first) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text, first):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


# Characters that look like an ASCII one.
_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "ı": "i", "ɡ": "g", "ɑ": "a", "ℓ": "l",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "․": ".", "。": ".", "｡": ".", "•": ".", "∙": ".", "⋅": ".", "﹫": "@",
    " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
}
_INVISIBLE = "​‌‍⁠﻿­"
_WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_OTHER_DIGITS = {chr(base + d): str(d) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_LETTERS = {**_ALIKE, **_WIDE, **_OTHER_DIGITS}
_ODD = re.compile("[" + "".join(map(re.escape, [*_LETTERS, *_INVISIBLE])) + "]")

# Digits as words, by language.
_SPELLED = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_VALUE = {w: str(d) for words in _SPELLED.values() for d, w in enumerate(words.split())} | {"oh": "0"}
_DIGIT_WORD = "|".join(sorted(_VALUE, key=len, reverse=True))
_ITEM, _SAID_DOT = rf"(?:{_DIGIT_WORD}|[0-9]++)", "(?:dot|point|punkt|punto)"
# at least seven digits, some of them spelled, with marks between them
_MARKED = rf"(?:plus[ ]+)?(?:{_ITEM}(?:[ ]*[-,][ ]*|[ ]+(?:{_SAID_DOT}[ ]+)?|[ ]*\.[ ]*)){{6,}}{_ITEM}"
# or four groups of up to three with dots between them
_GROUP = rf"{_ITEM}(?:(?:[ ]*-[ ]*|[ ]++){_ITEM}){{0,2}}"
_QUAD = rf"{_GROUP}(?:(?:[ ]++{_SAID_DOT}[ ]++|\.|[ ]*+[\[({{<][ ]*+(?:{_SAID_DOT}|\.)[ ]*+[\])}}>][ ]*+){_GROUP}){{3}}"
_RUN = re.compile(rf"(?<![^\W_])(?:{_MARKED}|{_QUAD})(?![^\W_])", re.IGNORECASE)
_IN_RUN = re.compile(rf"({_DIGIT_WORD})|(plus)|(dot|point|punkt|punto|\.)|([0-9])", re.IGNORECASE)
# runs of spaces and of name characters are taken whole and from their start, so that long ones cost one look
_OPEN, _CLOSE = r"(?<![ ])[ ]*+[\[({<][ ]*+", r"[ ]*+[\])}>][ ]*+"
_AT = re.compile(rf"{_OPEN}(?:at|@|arroba|arobase|ät){_CLOSE}", re.IGNORECASE)
_DOT = re.compile(rf"{_OPEN}(?:dot|\.|punkt|punto|point){_CLOSE}", re.IGNORECASE)
# bare words count only together: name at host dot end
_BARE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:[ ]++at[ ]++|@)[A-Za-z0-9-]+(?:(?:[ ]+dot[ ]+|\.)[A-Za-z0-9-]+)*[ ]+dot[ ]+[A-Za-z]{2,}|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:[ ]++at[ ]++)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:com|net|org|edu|gov|io|co|de|fr|es|uk|eu|info)\b", re.IGNORECASE)
_BARE_DOT = re.compile(r"[ ]+dot[ ]+", re.IGNORECASE)
_BARE_AT = re.compile(r"[ ]+at[ ]+", re.IGNORECASE)
_IP_SIGN = re.compile(r"[ ]*(?:dot|\[\.\]|\(\.\)|\[dot\]|\(dot\))[ ]*", re.IGNORECASE)
_IP_DOT = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_IP_SIGN.pattern}[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
# what the patterns above can't match without, and dear ones are spared by: a bracketed sign, " at " before a known end
_BRACKETED = re.compile(r"[\[({<][ ]*+(?:at|@|arroba|arobase|ät|dot|\.|punkt|punto|point)[ ]*+[\])}>]", re.IGNORECASE)
_END = re.compile(r"\.(?:com|net|org|edu|gov|io|co|de|fr|es|uk|eu|info)\b", re.IGNORECASE)


class Rewritten:
    """A text under rewriting, and for each of its characters the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)
        self.changed = False

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits (start, end, new text), in order and apart; each new character stands for the whole of what it replaces
        but where one character replaces one."""
        if not edits:
            return
        parts, starts, ends, last = [], [], [], 0
        for s, e, new in edits:
            parts += [self.text[last:s], new]
            starts += self.start[last:s]
            ends += self.end[last:s]
            if new:
                starts += [self.start[s]] * len(new)
                ends += [self.end[e - 1]] * len(new)
            last = e
        self.text = "".join([*parts, self.text[last:]])
        self.start, self.end = [*starts, *self.start[last:]], [*ends, *self.end[last:]]
        self.changed = True


def _spelled_run(m: re.Match) -> list[tuple[int, int, str]]:
    """A run of spelled digits, written without what stood between them; its first character takes the run's start."""
    edits, at = [], m.start()
    for x in _IN_RUN.finditer(m.string, m.start(), m.end()):
        if x.start() > at:
            edits.append((at, x.start(), ""))
        new = _VALUE[x[1].casefold().replace("\u0307", "")] if x[1] else "+" if x[2] else "." if x[3] else x[4]
        edits.append((x.start(), x.end(), new))
        at = x.end()
    return edits


def rewritten(text: str) -> Rewritten | None:
    """The text without its disguises, or None if it shows none."""
    out = Rewritten(text)
    if not text.isascii() and _ODD.search(text):
        out.replace([(m.start(), m.end(), _LETTERS.get(m[0], "")) for m in _ODD.finditer(text)])
    low = out.text.lower()
    if "dot" in low:  # addresses in digits first: a list of them is no run of digits
        out.replace([(x.start(), x.end(), ".") for m in _IP_DOT.finditer(out.text) for x in _IP_SIGN.finditer(out.text, m.start(), m.end())])
    out.replace([e for m in _RUN.finditer(out.text) if any(c.isalpha() for c in m[0]) for e in _spelled_run(m)])
    if "dot" in low or " at " in low and _END.search(out.text) or _BRACKETED.search(out.text):
        out.replace([(m.start(), m.end(), "@") for m in _AT.finditer(out.text)])
        out.replace([(m.start(), m.end(), ".") for m in _DOT.finditer(out.text)])
        bare = [(x.start(), x.end(), new) for m in _BARE.finditer(out.text) for p, new in ((_BARE_AT, "@"), (_BARE_DOT, ".")) for x in p.finditer(out.text, m.start(), m.end())]
        apart, last = [], 0
        for s, e, new in sorted(set(bare)):
            if s >= last:
                apart.append((s, e, new))
                last = e
        out.replace(apart)
    return out if out.changed else None


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and plain and disguised ones together; both by kind and start."""
    base = plain_spans(text)
    other = rewritten(text)
    if other is None:
        return base, base
    found = sorted((k, other.start[s], other.end[e - 1]) for k, s, e in plain_spans(other.text))
    # both lists are in order: a span lies within another of its kind if one that starts no later ends no sooner
    every, i, reach, of = list(base), 0, -1, -1
    for k, s, e in found:
        if k != of:
            of, reach = k, -1
            while i < len(base) and base[i][0] < k:
                i += 1
        while i < len(base) and base[i][0] == k and base[i][1] <= s:
            reach = max(reach, base[i][2])
            i += 1
        if reach < e:
            every.append((k, s, e))
            reach = e
    return base, sorted(every)


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """Counts of plain identifiers by kind, a digest of their spans, and the list of all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column(1):
                base, every = all_spans(text.as_py() or "")
                for k in range(4):
                    out[k].append(sum(x[0] == k for x in base))
                out[4].append(hashlib.sha256(spelled(base).encode()).hexdigest())
                out[5].append(spelled(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:4]), *(pa.array(c, pa.string()) for c in out[4:])], [c.split()[0] for c in FOUND.split(", ")])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


def mask(text: str | None) -> str | None:
    """The text with every found span, overlapping ones as one, replaced by its kind in angle brackets."""
    if not text:
        return text
    spans = sorted((s, e, k) for k, s, e in all_spans(text)[1])
    if not spans:
        return text
    parts, last = [], 0
    for i, (s, e, k) in enumerate(spans):
        if s >= last:
            parts += [text[last:s], f"<{KINDS[k].upper()}>"]
        last = max(last, e)
    return "".join([*parts, text[last:]])


def masked(docs: DataFrame) -> DataFrame:
    """The same columns and rows with identifiers masked in text, and n_chars, if there, counted anew."""
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = [mask(t) for t in columns[at].to_pylist()]
            columns[at] = pa.array(texts, columns[at].type)
            if counted is not None:
                columns[counted] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, schema)
