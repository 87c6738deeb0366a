"""Personal data in plain and disguised form, with spans in the source text.

Detectors look for e-mail addresses, IP addresses, payment cards and phone
numbers.  Disguises are undone by a chain of transducers.  Each rewrites a text
from left to right and records, for every character it writes, the stretch of
source characters that it stands for:

* ``glyphs`` turns look-alikes and wide forms into ASCII and drops characters of
  no width;
* ``digits`` turns spelled digits next to others, figures or dots between them
  into figures;
* ``marks`` turns "(at)", "[dot]" and their kind into "@" and ".", and bare words
  "at" and "dot" where the whole looks like an address or figures with dots.

The detectors run again on what each link wrote, and the records of all links
compose, so a span found there maps back to the source characters.  A span that
lies within another of its kind is left out.  Texts in which no transducer finds
anything to rewrite are not rewritten.

Cases: a null or empty text has no spans; a long text is scanned whole, in
linear time; ties of start cannot occur within a kind; repeated rows are scanned
each; an empty table gives none; other columns pass through, and one that has
the result's name is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import slices
from ._store import table

KINDS = ("email", "ip", "card", "phone")

# A start within a run of digits cannot succeed where the run's own start fails, so only run starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_FIGURE = re.compile("[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses: each is the run of local characters before an "@" that a domain follows."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Spans by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _FIGURE.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdecimal() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


#: Letters of other scripts that look like the ASCII letter they stand beside.
LOOK_ALIKES = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іıɩ", "j": "јϳ", "k": "κ", "l": "ӏⅼ", "m": "ⅿ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г",
    "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ѡԝ", "x": "хⅹ", "y": "уγ", "z": "ᴢ", "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν",
    "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ", ".": "․。．｡", "@": "＠﹫", "-": "‐‑‒–−", "+": "＋﹢",
}

#: Characters of no width.
NO_WIDTH = "­​‌‍⁠﻿"

#: The digits' names.
DIGIT_NAMES = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}


def _glyph_table() -> dict[str, str]:
    out = {c: ascii_ for ascii_, alike in LOOK_ALIKES.items() for c in alike} | dict.fromkeys(NO_WIDTH, "")
    out |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for c in range(0x80, 0x20000):
        value = unicodedata.digit(chr(c), None)
        if value is not None and chr(c) not in "¹²³":
            out.setdefault(chr(c), str(value))
    return out


_GLYPHS = _glyph_table()
_NAMES = {name: str(i) for names in DIGIT_NAMES.values() for i, name in enumerate(names.split())} | {"oh": "0"}
_NAME = "(?:" + "|".join(sorted(_NAMES, key=len, reverse=True)) + ")"


def _folded(text: str) -> str:
    """Lower case, in which letters that a pattern without case takes for each other are the same."""
    return text.lower() if text.isascii() else text.casefold().replace("ı", "i").replace("\u0307", "")


class Transducer:
    """Replaces each match of ``pattern`` by what ``write`` says; None leaves it. needs: gives whether a text is worth the search."""

    def __init__(self, pattern: str, write: Callable[[re.Match], list[tuple[int, int, str]] | None], needs: Callable[[str], bool]) -> None:
        self.pattern, self.write, self.needs = re.compile(pattern, re.IGNORECASE), write, needs

    def edits(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, what stands for it), in order."""
        if not self.needs(text):
            return []
        return [e for m in self.pattern.finditer(text) for e in self.write(m) or ()]


_GLYPH_SET = frozenset(_GLYPHS)


_OPEN, _CLOSE = r"[\[({<]\s?", r"\s?[\])}>]"
_WORD = r"[\w.%+-]"
_MARK = rf"\s?{_OPEN}(?:(?P<at>at|ät|arroba|arobase)|(?P<dot>dot|punkt|point|punto)){_CLOSE}\s?|\s(?:(?P<at2>at|arroba)|(?P<dot2>dot|punto)|(?P<dot3>punkt|point))\s|(?P<sign>@)"
_ANY_MARK = re.sub(r"\?P<\w+>", "?:", _MARK)
_MARKS_OF = re.compile(rf"(?:{_MARK})(?={_WORD})", re.IGNORECASE)

#: Words before a bare "dot" that make it a noun.
_NOUN = frozenset("the a an this that these those each every any some no another my your his her its our their el la un una este ese cada".split())
#: Words of prose after a bare "dot". None is a top-level domain.
_PROSE = frozenset("on and or of the that which was were are from with has had have will when where for if than then but que con por para cuando dot punto".split())


def _last_label(word: str) -> bool:
    """Whether a domain may end with ``word``: two letters or more, or a punycode label."""
    label = word.rstrip("._%+-").rpartition(".")[2].lower()
    return label.startswith("xn--") or (len(label) > 1 and label.isascii() and label.isalpha())


def _disguised(m: re.Match) -> list[tuple[int, int, str]]:
    """What a run of words and marks between them stands for.

    Marks in brackets are always rewritten.  A bare "dot" is, between two figures
    or within the name or domain of an address, and a bare "at" before a domain
    with a disguised dot, whose end looks like a domain's.  A domain that is only
    "the dot" and one label is prose.
    """
    text = m.string
    marks = list(_MARKS_OF.finditer(text, m.start(), m.end()))
    words = [text[a:b] for a, b in zip([m.start(), *(x.end() for x in marks)], [*(x.start() for x in marks), m.end()], strict=True)]
    keep = [bool(x["at"] or x["dot"]) for x in marks]
    ats = [i for i, x in enumerate(marks) if x["at"] or x["at2"] or x["sign"]]
    dots = [x["dot"] or x["dot2"] for x in marks]

    def prose(i: int) -> bool:
        return bool(marks[i]["dot2"]) and words[i + 1].partition(".")[0].lower() in _PROSE

    end, taken = len(marks), False  # taken: what is before ``end`` belongs to the name of a later address
    for i in reversed(ats):
        stop = i + 1
        while not taken and stop < end and dots[stop] and not prose(stop):
            stop += 1
        while stop > i + 1 and marks[stop - 1]["dot2"] and not _last_label(words[stop]):
            stop -= 1
        noun = stop == i + 2 and marks[i + 1]["dot2"] and words[i + 1].lower() in _NOUN
        address = not marks[i]["at2"] or (stop > i + 1 and not noun)
        if address:
            keep[i] = not marks[i]["sign"]
            keep[i + 1 : stop] = [True] * (stop - i - 1)
            k = i
            while k and dots[k - 1] and not prose(k - 1) and not (marks[k - 1]["dot2"] and words[k - 1].lower() in _NOUN):
                k -= 1
                keep[k] = True
        end, taken = i, address
    for i, x in enumerate(marks):
        if (x["dot2"] or x["dot3"]) and words[i][-1:].isdecimal() and words[i + 1][:1].isdecimal():
            keep[i] = True
    return [(x.start(), x.end(), "@" if x["at"] or x["at2"] else ".") for x, k in zip(marks, keep, strict=True) if k]


_FIGURES = r"[0-9]++"
_DOT_WORD = rf"\s?{_OPEN}(?:dot|punkt|point|punto){_CLOSE}\s?|\s(?:dot|punto|punkt|point)\s"
_DOT_WORDS = frozenset(("dot", "punkt", "point", "punto"))
_ITEM = rf"(?:{_NAME}|{_FIGURES})(?!\w)"
_ITEMS_OF = re.compile(rf"(?<!\w){_ITEM}", re.IGNORECASE)


def _is_octet(figures: str) -> bool:
    return 0 < len(figures) <= 3 and int(figures) <= 255


def _spelled(m: re.Match) -> list[tuple[int, int, str]] | None:
    """In a run of names and figures, names become figures, each standing for its name.

    What is between two names, or a name and a figure, goes, but dots stay: those in words always, and "."
    where four octets are joined by it, or between a name and a figure.
    """
    text, begin = m.string, m.start() + len(m["plus"] or "")
    items = [(x.start(), x.end(), _NAMES.get(_folded(x[0]))) for x in _ITEMS_OF.finditer(text, begin, m.end())]
    if all(figure is None for _, _, figure in items):
        return None
    between = [text[x[1] : y[0]] for x, y in zip(items, items[1:])]
    dots = [len(gap.strip()) > 1 and gap.strip(" .,-") != "" or gap.strip(" ") == "." for gap in between]
    # Groups are what stands between dots; a dot before a blank alone ends a sentence, and the octets with it.
    octets = [False] * len(between)
    start = 0
    for k in range(len(items)):
        if k < len(between) and between[k] != ". ":
            continue
        ends = [i for i in range(start, k) if dots[i]]
        if len(ends) == 3:
            groups = [items[a : b + 1] for a, b in zip([start, *(e + 1 for e in ends)], [*ends, k], strict=True)]
            if all(_is_octet("".join(figure or text[a:b] for a, b, figure in group)) for group in groups):
                octets[start:k] = dots[start:k]
        start = k + 1
    out = [(m.start(), begin, "+")] if m["plus"] else []
    for k, (a, b, figure) in enumerate(items):
        if k:
            last, gap = items[k - 1], between[k - 1]
            bare = gap.strip(" .,-") == ""
            if octets[k - 1]:
                if bare and gap != ".":
                    out.append((last[1], a, "."))
            elif bare and not (gap == ". " and any(octets[max(k - 2, 0) : k + 1])) and (last[2] is not None and figure is not None or "." not in gap and (last[2] is not None or figure is not None)):
                out.append((last[1], a, ""))
        if figure is not None:
            out.append((a, b, figure))
    return out


_WORDS = re.compile(r"\w+")


def _has_names(text: str) -> bool:
    """Whether a name of a digit stands next to another or a figure, but for what is between words and a dot in words."""
    words = _WORDS.findall(_folded(text))
    if _NAMES.keys().isdisjoint(words):
        return False
    rest = [w for w in words if w not in _DOT_WORDS]
    digits = [w in _NAMES or w.isdecimal() for w in rest]
    return any(x and y and (v in _NAMES or w in _NAMES) for x, y, v, w in zip(digits, digits[1:], rest, rest[1:]))


_BRACKETED_AT = re.compile(rf"{_OPEN}(?:at|ät|arroba|arobase)", re.IGNORECASE)


def _marked(text: str) -> bool:
    """Whether a mark may need rewriting: a bare "at" does only beside a dot in words."""
    folded = _folded(text)
    return any(x in folded for x in ("dot", "punkt", "point", "punto")) or bool(_BRACKETED_AT.search(text))


GLYPHS = Transducer("[" + re.escape("".join(_GLYPHS)) + "]", lambda m: [(m.start(), m.end(), _GLYPHS.get(m[0], m[0]))], lambda t: not t.isascii() and not _GLYPH_SET.isdisjoint(t))
DIGITS = Transducer(rf"(?<!\w)(?P<plus>plus\s|\+\s?)?{_ITEM}(?:(?:{_DOT_WORD}|[\x20,.-]{{1,3}}){_ITEM})+", _spelled, _has_names)
MARKS = Transducer(
    rf"(?<!{_WORD}){_WORD}++(?:(?:{_ANY_MARK}){_WORD}++)+",
    _disguised,
    _marked,
)
CHAIN = (GLYPHS, DIGITS, MARKS)


class Mapped:
    """A rewritten text and, by segments, where its characters come from."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.out, self.src, self.end, self.copied = [0], [0], [len(text)], [True]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        pieces, out, src, end, copied = [], [], [], [], []
        done = length = 0

        def segment(a: int, b: int, new: str | None) -> None:
            nonlocal length
            text = self.text[a:b] if new is None else new
            if new is not None:
                out.append(length), src.append(self.source(a, True)), end.append(self.source(b, False)), copied.append(False)
            elif a < b:
                k = self._at(a)
                while k < len(self.out) and self.out[k] < b:
                    lo, hi = max(a, self.out[k]), min(b, self.out[k + 1] if k + 1 < len(self.out) else len(self.text))
                    if lo < hi:
                        shift = lo - self.out[k]
                        out.append(length + lo - a), copied.append(self.copied[k])
                        src.append(self.src[k] + shift if self.copied[k] else self.src[k])
                        end.append(self.src[k] + shift + hi - lo if self.copied[k] else self.end[k])
                    k += 1
            pieces.append(text)
            length += len(text)

        for a, b, new in edits:
            segment(done, a, None)
            if new:
                segment(a, b, new)
            done = b
        segment(done, len(self.text), None)
        self.text, self.out, self.src, self.end, self.copied = "".join(pieces), out or [0], src or [0], end or [0], copied or [True]

    def _at(self, place: int) -> int:
        return max(0, bisect_left(self.out, place + 1) - 1)

    def source(self, place: int, start: bool) -> int:
        """The source place at which the character at ``place`` starts, or the one before it ends."""
        k = self._at(place if start else place - 1)
        if not self.copied[k]:
            return self.src[k] if start else self.end[k]
        return self.src[k] + place - self.out[k]


def rewritten(text: str) -> Iterator[Mapped]:
    """What the text is after each link of the chain that changes it: one object, rewritten further when the next is asked for."""
    mapped = None
    for transducer in CHAIN:
        edits = transducer.edits(mapped.text if mapped else text)
        if edits:
            mapped = mapped or Mapped(text)
            mapped.rewrite(edits)
            yield mapped


def normalised(text: str) -> Mapped | None:
    """What the chain writes; None if it changes nothing."""
    mapped = None
    for mapped in rewritten(text):  # noqa: B007
        pass
    return mapped


def outermost(spans: set[Span]) -> list[Span]:
    """The spans that lie within no other of their kind, by kind and start."""
    out: list[Span] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[0], s[1], -s[2])):
        if not out or out[-1][0] != kind or end > out[-1][2]:
            out.append((kind, start, end))
    return out


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and those that only a rewritten text shows."""
    base = detect(text)
    found = set()
    for mapped in rewritten(text):
        found.update((kind, mapped.source(a, True), mapped.source(b, False)) for kind, a, b in detect(mapped.text))
    if not found:
        return base, []
    plain = set(base)
    # One name beside a whole number is prose ("+1 555 123 4567 un"): it adds nothing to a span found without it.
    ends: dict[tuple, list[int]] = {}
    for kind, start, end in found | plain:
        ends.setdefault((kind, start, False), []).append(end)
        ends.setdefault((kind, end, True), []).append(start)
    for kind, start, end in list(found):
        beyond = [text[b:end] for b in ends[kind, start, False] if b < end] + [text[start:a] for a in ends[kind, end, True] if a > start]
        if any(_folded(x).strip(" .,-") in _NAMES for x in beyond):
            found.discard((kind, start, end))
    return base, [s for s in outermost(found | plain) if s not in plain]


SPANS = "array<struct<kind:string,start:int,end:int,disguised:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())]))


def scan(docs: DataFrame, text: str = "text", into: str = "private") -> DataFrame:
    """``docs`` with its spans, by kind and start in code points, as a further column."""
    rest = docs.drop(into)
    schema = rest.select("*", F.lit(None).cast(SPANS).alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                rows = []
                for value in part.column(part.schema.get_field_index(text)).to_pylist():
                    base, more = spans_of(value) if value else ([], [])
                    every = sorted([(*s, False) for s in base] + [(*s, True) for s in more])
                    rows.append([{"kind": KINDS[k], "start": a, "end": b, "disguised": d} for k, a, b, d in every])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, _ARROW)], names=[*part.schema.names, into])

    return rest.mapInArrow(run, schema)


def op2_offset_preserving(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "private", F.expr("filter(private, x -> not x.disguised)").alias("base"))
    joined = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.expr(f"sha2(cast({joined.format('base')} as binary), 256)").alias("base_sha256"), F.expr(joined.format("private")).alias("spans"))
