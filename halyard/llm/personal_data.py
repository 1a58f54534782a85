"""Operator 6: personal data in texts, also where it is disguised, at its place in the source.

Base: addresses, numbers and phones as they stand. Disguises: a chain of transducers rewrites look-alike characters,
invisible ones, spelled digits, and at and dot written out or in brackets; each keeps for every character it makes
which source characters it came from. Detection on the rewritten text finds what the base cannot, and the spans go back
to source positions. An added span must hold a rewritten character, and of the base spans it touches it must
hold each and reach beyond it; those stay, too.

Whole texts are read, each by itself, without a shuffle. Patterns never look at a run of characters twice, so long
runs cost in proportion to their length.

Cases: a null text counts as empty and has no spans; repeated rows are read each for itself; spans with one start are
ordered by kind as listed, then end; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import batched, id_and_text, id_type, rows_of

KINDS = ["email", "ip", "card", "phone"]

# -- base

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @: what stands before it up to the last match is the local part."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1  # no match can begin before this @ any more
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of what stands undisguised in a text, by start, then kind."""
    out = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


# -- disguises

#: Letters and signs that look like an ASCII character but don't normalise to it.
LOOK_ALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝАВЕКМНОРСТХЅІЈαορνικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ‐‑‒–—−。｡․·∙•",
        "aeopcyxijshdqwABEKMHOPCTXSIJaopviktuABEZHIKMNOPTYX------.......",
        strict=False,
    )
)
INVISIBLE = "­​‌‍⁠﻿"


def _table() -> dict[str, str]:
    """Characters with one ASCII character that they stand for: look-alikes, and by rule those that normalise to one."""
    out = {}
    for point in range(0x80, sys.maxunicode + 1):
        c = chr(point)
        if (plain := unicodedata.normalize("NFKC", c)) != c and len(plain) == 1 and " " <= plain <= "~":
            out[c] = plain
        elif unicodedata.category(c) == "Nd":
            out[c] = str(unicodedata.digit(c))
    return out | LOOK_ALIKES | dict.fromkeys(INVISIBLE, "")


_PLAIN = _table()
_ODD = frozenset(_PLAIN)

#: The digits' names in four languages.
DIGIT_NAMES = {
    "0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
_DIGIT_OF = {name: d for d, names in DIGIT_NAMES.items() for name in names.split()}
_NAME = "(?:" + "|".join(sorted(_DIGIT_OF, key=lambda n: (-len(n), n))) + ")"
_DOT_WORD, _AT_WORD = "(?:dot|punkt|punto|point)", "(?:at|arroba|arobase|ät)"
#: What stands between spelled digits, and a row of them with digits and dots between; what follows its last name is cut off.
_BETWEEN = r"(?=[ ,-])[ ,]{0,3}+-*+[ ,]{0,3}+(?:-[ ,]{0,2}+)?+"
_SPELLED = re.compile(rf"(?i)\b(?:plus[ -]++)?+{_NAME}\b(?:{_BETWEEN}(?:{_NAME}|[0-9]++|{_DOT_WORD})\b)*+")
_SPELLED_PART = re.compile(rf"(?i)\b(?:({_NAME})|{_DOT_WORD}|plus|[0-9]++)\b")
_PLUS_DIGITS = re.compile(r"(?i)\bplus[ ]++(?=[0-9])")
_DOTTED_DIGITS = re.compile(rf"(?i)(?<=[0-9])[ ]*+(?:[\[({{<][ ]*+)?+{_DOT_WORD}[ ]*+(?:[\])}}>][ ]*+)?+(?=[0-9])")
_IN_BRACKETS = re.compile(rf"(?i)[ ]?[\[({{<][ ]*+(?:({_AT_WORD}|@)|({_DOT_WORD}|\.))[ ]*+[\])}}>][ ]?")
_ENTITY = re.compile(r"(?i)&(?:#0*64|#x0*40|commat);|%40|(&(?:#0*46|#x0*2e|period);|%2e)")
#: Top-level domains that words around a written dot may always end in, and longer ones; besides these, any
#: ending of two to four letters that isn't a frequent word, and domains that are words, too, unless the dot is "point".
TOP_LEVEL = "com|org|net|edu|gov|info|biz|io|co|de|fr|es|uk|it|eu|us|ch|nl|ru"
LONGER = "online|store|cloud|email|agency|museum|travel|digital|network|company|academy|media|world|group|today|studio|design|global|health|space|website|solutions|services|systems|technology|international|finance|energy|berlin|paris|london|madrid|swiss|quebec"
WORDS = (
    "the|and|for|was|were|with|that|this|from|they|them|then|than|when|what|who|whom|how|why|had|has|have|are|his|her|its|our|your|you|she|he|we|if|or|on|of|an|up|out|off|but|not|all|any|can|will|may|did|does|said|just|also|only|over|into|some|more|"
    "und|der|die|das|den|dem|ein|eine|ist|war|mit|von|vom|zum|zur|auf|aus|bei|bis|wie|wir|sie|er|es|ich|nach|nur|noch|que|los|las|una|por|con|sin|sus|del|el|y|les|des|une|qui|pas|est|par|sur|sous|dans|pour|elle|il|ils|on|ou|et|ne|ce"
)
WORDS_AND_DOMAINS = "in|at|be|is|to|no|so|me|my|am|as|by|do|la|ma|sa|se|si|su|tu|une|un|re|ad|al|im|pm|here|like|now|one|red|care|work|best|fun|live|new|next|page|pay|plus|safe|save|team|tips|top|win|you"
#: Words before a written dot that make it part of a sentence.
SENTENCE = "this|that|some|any|the|a|an|which|what|every|each|no|my|your|his|her|our|their|its|one|another|gun|knife|der|dem|den|diesem|cette|ce|este|ese|un|una"
_NOT_WORD = lambda words: rf"(?!(?:{words})(?![A-Za-z0-9]))"
_ENDING = rf"{_NOT_WORD(WORDS)}(?:[A-Za-z]{{2,4}}|{LONGER})"
_DOT_APART = rf"[ _]++{_DOT_WORD}[ _]++"
_SURE_DOT, _POINT = r"[ _]++(?:dot|punkt|punto)[ _]++", r"[ _]++point[ _]++"
_NOT_SENTENCE = "".join(rf"(?<![ _]{w})" for w in SENTENCE.split("|"))
_LAST = rf"(?:{_DOT_APART}(?:{TOP_LEVEL})|(?=[ _]){_NOT_SENTENCE}(?:{_SURE_DOT}{_ENDING}|{_POINT}{_NOT_WORD(WORDS_AND_DOMAINS)}{_ENDING}))(?![A-Za-z0-9])"
#: With at and at least the last dot as words: the at, and what follows it.
_AT_WORDS = re.compile(rf"(?i)(?<=[ _]){_AT_WORD}(?=[ _])")
_AFTER_AT = re.compile(rf"(?i)[ _]++[A-Za-z0-9-]++(?:(?:{_DOT_APART}|\.)[A-Za-z0-9-]++)*{_LAST}")
#: With an @ and perhaps blanks around it and the dots.
_OPEN_AT = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[ ]?@[ ]?[A-Za-z0-9-]++(?:(?:{_DOT_APART}|[ ]\.[ ]|\.)[A-Za-z0-9-]++)*(?:{_LAST}|(?:[ ]\.[ ]|\.)(?:{TOP_LEVEL}|{_NOT_WORD(WORDS_AND_DOMAINS)}{_ENDING})(?![A-Za-z0-9]))")
_PART = re.compile(rf"(?i)((?<![ _])[ _]++{_AT_WORD}[ _]++|[ ]?@[ ]?)|(?<![ _]){_DOT_APART}|[ ]\.[ ]|\.")
#: What has to be there for the dearer patterns to find anything; the first two read lower case.
_HAS_SPELLED = re.compile(rf"(?<![a-z]){_NAME}[ ,-]{{1,3}}(?:{_NAME}|[0-9]|{_DOT_WORD})")
_HAS_DOT_WORD = re.compile(rf"[ _]{_DOT_WORD}[ _]")
_HAS_OPEN_AT = re.compile(r"[ ]@|@[ ]|@[A-Za-z0-9-]+[ ]\.[ ]")
#: Letters between digits that stand for digits.
_LETTER_DIGIT = re.compile(r"(?<=[0-9])([ -]?)([OoIl])(?=[ -]?[0-9])")


class Rewritten:
    """A text and, for each character, which source characters it came from and whether it was rewritten."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.begin, self.end, self.new = list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text))

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, instead) in the present text, in order, without overlaps."""
        text, begin, end, new, at = [], [], [], bytearray(), 0
        for s, e, instead in edits:
            text += [self.text[at:s], instead]
            begin += self.begin[at:s] + [self.begin[s]] * len(instead)
            end += self.end[at:s] + [self.end[e - 1]] * len(instead)
            new += self.new[at:s] + b"\1" * len(instead)
            at = e
        self.begin, self.end, self.new = begin + self.begin[at:], end + self.end[at:], new + self.new[at:]
        self.text = "".join([*text, self.text[at:]])

    def source(self, start: int, end: int) -> tuple[int, int] | None:
        """Where a span came from; None if nothing in it was rewritten or left out."""
        s, e = self.begin[start], self.end[end - 1]
        return (s, e) if 1 in self.new[start:end] or e - s != end - start else None


def _spelled(found: re.Match) -> tuple[int, int, str] | None:
    """What a row of spelled digits says, up to its last name; None if it says less than three digits or has one name."""
    out, names, kept, end = [], 0, 0, 0
    for part in _SPELLED_PART.finditer(found.string, found.start(), found.end()):
        word = part.group().lower()
        out.append(_DIGIT_OF[word] if part.group(1) else word if word[0].isdigit() else "+" if word == "plus" else ".")
        if part.group(1):
            names, kept, end = names + 1, len(out), part.end()
    said = "".join(out[:kept])
    return (found.start(), end, said) if names > 1 and sum(c.isdigit() for c in said) >= 3 else None


def _addresses_in_words(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses around an at that is a word. What has been walked back over for one at is not for the next."""
    done = known_from = known_to = 0  # text[known_from:known_to] are local characters, and none stands before them
    for at in _AT_WORDS.finditer(text):
        if at.start() < done:
            continue
        end = at.start()
        while end > done and text[end - 1] in " _":
            end -= 1
        start = end
        while start > known_to and text[start - 1] in _LOCAL:
            start -= 1
        known_from, known_to = known_from if start == known_to else start, end
        if known_from < end and (rest := _AFTER_AT.match(text, at.end())):
            yield known_from, rest.end()
            done = known_from = known_to = rest.end()


def _transducers(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """Sends the edits of each transducer; is sent the text that they made."""
    if not text.isascii() and (odd := _ODD.intersection(text)):
        text = yield [(m.start(), m.end(), _PLAIN[m.group()]) for m in re.finditer("[" + "".join(map(re.escape, odd)) + "]", text)]
    if "&" in text or "%" in text:
        text = yield [(m.start(), m.end(), "." if m.group(1) else "@") for m in _ENTITY.finditer(text)]
    text = yield [(m.start(), m.end(), "@" if m.group(1) else ".") for m in _IN_BRACKETS.finditer(text)]
    if _HAS_SPELLED.search(text.lower()):
        text = yield [said for m in _SPELLED.finditer(text) if (said := _spelled(m))]
    low = text.lower()
    if "plus" in low:
        text = yield [(m.start(), m.end(), "+") for m in _PLUS_DIGITS.finditer(text)]
    if dotted := _HAS_DOT_WORD.search(low) is not None:
        text = yield [(m.start(), m.end(), ".") for m in _DOTTED_DIGITS.finditer(text)]
    text = yield [(m.start(2), m.end(2), "0" if m.group(2) in "Oo" else "1") for m in _LETTER_DIGIT.finditer(text)]
    for needed, found in ((dotted, _addresses_in_words), ("@" in text and (dotted or _HAS_OPEN_AT.search(text)), lambda t: (m.span() for m in _OPEN_AT.finditer(t)))):
        if needed:
            parts = [part for span in found(text) for part in _PART.finditer(text, *span)]
            text = yield [(p.start(), p.end(), "@" if p.group(1) else ".") for p in parts if len(p.group()) > 1]


_TOP = re.compile(r"[A-Za-z0-9].*@.*\.[A-Za-z]{2,24}", re.S)


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """(kind, start, end) of what is disguised in a text, at its place in the source."""
    rewritten: Rewritten | None = None
    chain = _transducers(text)
    edits = next(chain, None)
    while edits is not None:
        if edits:
            rewritten = rewritten or Rewritten(text)
            rewritten.edit(edits)
        try:
            edits = chain.send(rewritten.text if rewritten else text)
        except StopIteration:
            break
    if rewritten is None:
        return []
    out: list[Span] = []
    of_kind = [([a for k, a, _ in base if k == kind], [b for k, _, b in base if k == kind]) for kind in KINDS]  # each without overlaps, so both are in order
    for kind, s, e in base_spans(rewritten.text):
        place = rewritten.source(s, e)
        if place and (kind != "email" or _TOP.fullmatch(rewritten.text, s, e)) and all(_holds(place, starts, ends) for starts, ends in of_kind):
            out.append((kind, *place))
    return out


def _holds(place: tuple[int, int], starts: list[int], ends: list[int]) -> bool:
    """True if a place holds each span that it touches and reaches beyond it; only the first and the last can reach out of it."""
    first, last = bisect_right(ends, place[0]), bisect_left(starts, place[1]) - 1
    return first > last or (place[0] <= starts[first] and ends[last] <= place[1] and (first < last or ends[last] - starts[first] < place[1] - place[0]))


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): for every text its spans as an array of (kind, start, end, added), code points, end exclusive."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches):
            out = []
            for text in texts:
                base = base_spans(text)
                found = [(*x, False) for x in base] + [(*x, True) for x in added_spans(text, base)]
                found.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
                out.append([{"kind": k, "start": s, "end": e, "added": a} for k, s, e, a in found])
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, kind)], names=["id", "spans"])

    schema = f"id {id_type(df, id_col)}, spans array<struct<kind:string,start:long,end:long,added:boolean>>"
    return batched(id_and_text(df, id_col, text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_ of each kind in the base, base_sha256, spans, n_added) from the result of spans()."""
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: ~x["added"])
    of_kind = lambda kind: F.filter("spans", lambda x: ~x["added"] & (x["kind"] == kind))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        id_col, *counts,
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
        F.size(F.filter("spans", lambda x: x["added"])).cast("long").alias("n_added"),
    )
