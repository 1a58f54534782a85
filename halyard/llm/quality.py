"""Operator 2: quality rules on the fertility of public tokenizers.

Two public vocabularies measure each text: a piece model gives characters per token, the share of tokens that are bytes
for want of a piece, and the entropy of the tokens; a byte-level BPE gives characters per token of its own. A text is
rejected where a measure lies outside the band of its language, or of its script if the language has too few texts.

A band reaches REACH times the width of the shortest half of its language's texts that pass the base rules beyond that
half, and LEAST of the measure's own scale at least, so a group full of copies does not shut out its neighbours. The
shortest half stays with the bulk while junk is less than half; a script, which may hold several languages, has its
middle half instead. Where three sources or more are there, each has an equal say, so one large source does not move a
band. Of the languages in FIXED, no band passes the limits there; a measure whose half lies beyond them has the limits.
Groups are also cut by powers of two of the token count, because entropy grows with length. Texts with equal measures
count once. Quantiles are exact over the whole table; only measures are shuffled. Measures are rounded to three or four
digits, so a partition hands on a count for each value of a group, some ten thousand at most, and no group gathers rows.

A class with less than MIN_TEXTS texts takes the band of a class of half or twice the length, else that of all lengths,
each of the language and then of the script, and at last FIXED; every text has a band.

Base rules come first: too few words, or too many words in repeated three-word windows.

Cases: a null text has no words and fails the base; a null language, or a table without that column, is judged by script;
repeated rows get the same verdict each, and ties at a band's end are kept; a null or missing source counts as one more
source; texts may have any length; an empty table gives an empty result. Columns of the input stay where the function says
so, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm import vocabularies
from halyard.llm.common import batched, checkpointed
from halyard.llm.pretokens import KEPT_CHARS, AfterSpace, Cut, Kept, splits_at_spaces
from halyard.llm.token_counts import cut

MIN_WORDS = 50
#: Of 100 words, how many may be in repeated windows.
MAX_REPEATED = 50
REACH = 3.0
#: Texts that a band must rest on.
MIN_TEXTS = 100
#: Steps of a distribution, of which a half is half.
STEPS = 20
#: Sources from which on each has an equal say, and texts from which on a source has its whole say.
MIN_SOURCES, MIN_OF_SOURCE = 3, 10
#: measure -> (the least reach of its band as a share of the median, and absolutely)
LEAST = {"chars_per_token": (0.08, 0.0), "chars_per_byte_token": (0.08, 0.0), "fallback_share": (0.0, 0.03), "token_entropy": (0.08, 0.0)}
#: Limits of each measure by language, for the four that were measured (sf0.1, base passed: characters per
#: token 1.97 to 2.99 and 1.90 to 2.96, bytes 0 to 0.044, entropy 4.98 to 7.13), and for other texts by script, wider.
_MEASURED = {"chars_per_token": (1.8, 8.0), "chars_per_byte_token": (1.7, 8.0), "fallback_share": (0.0, 0.1), "token_entropy": (3.0, 14.0)}
FIXED = {
    "lang": dict.fromkeys(("de", "en", "es", "fr"), _MEASURED),
    "script": {"Latin": {"chars_per_token": (1.0, 8.0), "chars_per_byte_token": (1.0, 8.0), "fallback_share": (0.0, 0.5), "token_entropy": (3.0, 14.0)}},
    "other": {"": {"chars_per_token": (0.2, 8.0), "chars_per_byte_token": (0.2, 8.0), "fallback_share": (0.0, 1.0), "token_entropy": (2.0, 14.0)}},
}
#: First code points of the scripts told apart, and their names.
SCRIPTS = [
    (0x0000, "Common"), (0x0041, "Latin"), (0x005B, "Common"), (0x0061, "Latin"), (0x007B, "Common"), (0x00C0, "Latin"),
    (0x0250, "Common"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Common"), (0x2E80, "Han"), (0x3000, "Common"), (0x3040, "Kana"), (0x3100, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
]
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, chars_per_byte_token double, fallback_share double, token_entropy double, script string"
_FIELDS = [tuple(x.split()) for x in MEASURES.split(", ")]
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
_STARTS = np.array([start for start, _ in SCRIPTS], np.uint32)
_NAMES = [name for _, name in SCRIPTS]


def words_of(text: str) -> list[bytes]:
    """What lies between the six ASCII blanks, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def repeated_words(words: list) -> int:
    """Words that lie in three-word windows found twice or more, the first one included."""
    n = len(words)
    number = dict(zip(dict.fromkeys(words), range(n), strict=False))
    if n - len(number) < 3:
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 21:  # their cube would not fit
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows)
    same = np.diff(windows[order]) == 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def counts_of(ids: np.ndarray) -> np.ndarray:
    """How often each id occurs that does."""
    ordered = np.sort(ids)
    return np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])))


def script_of(text: str) -> str:
    """The script of most letters; Latin goes first among equals, Common if there is no letter."""
    if text.isascii():
        return "Latin" if any(c.isalpha() for c in text) else "Common"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    per_range = np.bincount(np.searchsorted(_STARTS, points, side="right") - 1, minlength=len(_NAMES))
    totals: dict[str, int] = {}
    for name, n in zip(_NAMES, per_range.tolist(), strict=True):
        totals[name] = totals.get(name, 0) + n
    totals.pop("Common")
    best = max(totals, key=lambda name: (totals[name], name == "Latin", name))
    return best if totals[best] else "Common"


class Meter:
    """Measures texts by two vocabularies, with kept pre-tokens."""

    def __init__(self, model: str, ranks: str) -> None:
        self.model, self.pieces = model, vocabularies.pieces_model(model)
        self.after_space = AfterSpace(ranks)
        self.plain = self.after_space.plain
        self.kept = Kept(self._encoded)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])

    def _encoded(self, pieces: list[str]) -> Iterator[tuple[bytes, int]]:
        """Of each piece the model's ids, and how many tokens the ranks make of it after a space."""
        ids = [array("I", x).tobytes() for x in self.pieces.encode(pieces, num_threads=1)] if pieces else []
        return zip(ids, [len(x) // 4 for x in self.after_space(pieces)], strict=True)

    def __call__(self, texts: list[str]) -> list[tuple]:
        by_model, by_ranks = [cut(t, self.model) is not None for t in texts], [splits_at_spaces(t) for t in texts]
        pieces = Cut([t if a or b else "" for t, a, b in zip(texts, by_model, by_ranks, strict=True)])
        self.kept.load(pieces.distinct)
        found = list(map(self.kept.__getitem__, pieces.distinct))
        for p in pieces.distinct:
            if len(p) > KEPT_CHARS:
                self.kept.pop(p, None)
        self.kept.trim()
        ids, stops = pieces.ids([x for x, _ in found], pieces.which)
        later = pieces.sums(np.fromiter((n for _, n in found), np.int64, len(found))).tolist()
        out = []
        for k, text in enumerate(texts):
            coded = ids[stops[k] : stops[k + 1]] if by_model[k] else np.array(self.pieces.encode(text, num_threads=1), np.uint32)
            out.append(self._measured(text, coded, len(self.plain(pieces.firsts[k])) + later[k] if by_ranks[k] else len(self.plain(text))))
        return out

    def _measured(self, text: str, coded: np.ndarray, n_byte_tokens: int) -> tuple:
        words = words_of(text)
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        n, chars = len(coded), len(text)
        share = counts_of(coded) / n if n else np.zeros(0)
        return (
            len(words), chars - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), n,
            round(chars / n, 3) if n else None, round(chars / n_byte_tokens, 3) if n_byte_tokens else None,
            round(int(self.is_byte[coded].sum()) / n, 4) if n else None, round(float(-(share * np.log2(share)).sum()) + 0.0, 3) if n else None, script_of(text),
        )


def meter(model: str, ranks: str) -> Meter:
    return vocabularies.held(Meter, model, ranks)


def measured(df: DataFrame, text_col: str = "text", model: str = vocabularies.PIECE_BPE, ranks: str = vocabularies.BYTE_BPE_RANKS, keep: list[str] | None = None) -> DataFrame:
    """keep's columns of df (all if None) as a struct `row`, and the measures of its text."""
    kept = F.struct(*[df[c] for c in (df.columns if keep is None else keep)])
    packed = df.select(kept.alias("row"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = meter(model, ranks)
        for batch in batches:
            columns = list(zip(*measure(batch.column(1).to_pylist()), strict=True)) or [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, _ARROW[kind]) for x, (_, kind) in zip(columns, _FIELDS, strict=True))], names=["row", *(name for name, _ in _FIELDS)])

    return batched(packed).mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, {MEASURES}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _limit(kind: str, name: Column, measure: str, end: int) -> Column:
    """What FIXED says for a name of a kind, or null."""
    return reduce(lambda e, x: e.when(name == x[0], F.lit(x[1][measure][end])), FIXED[kind].items(), F.when(F.lit(False), F.lit(0.0)))


def bands(measures: DataFrame) -> DataFrame:
    """(kind, name, size, n, and low_ and high_ of each measure): the bands that all texts which pass the base make.

    measures: with a column lang, and perhaps source, besides the measures. kind is lang or script; size is the power of
    two of n_tokens, or -1 for all.
    """
    names, group = list(LEAST), ["kind", "name", "size"]
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in measures.columns else F.lit("")
    each = (
        measures.filter(~base_failed())
        .select("lang", "script", source.alias("source"), F.floor(F.log2("n_tokens")).alias("size"), *names)
        .groupBy("lang", "script", "size", *names)
        .agg(F.min("source").alias("source"))
    )
    classes = [F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("name"), size.alias("size")) for kind in ("lang", "script") for size in (F.col("size"), F.lit(-1).cast("long"))]
    classed = each.select(F.explode(F.array(*classes)).alias("c"), "source", *names).select("c.*", "source", *names).filter("name is not null")
    by_source = classed.groupBy(*group, "source").agg(F.count(F.lit(1)).alias("of_source"))
    by_class = by_source.groupBy(*group).agg(F.count(F.lit(1)).alias("sources"), F.sum("of_source").alias("n")).filter(F.col("n") >= MIN_TEXTS)
    say = F.when(F.col("sources") >= MIN_SOURCES, F.ceil(F.lit(float(1 << 30)) / F.greatest("of_source", F.lit(MIN_OF_SOURCE)))).otherwise(F.lit(1)).cast("long")
    weighed = classed.join(by_source.join(by_class, group).select(*group, "source", "n", say.alias("say")), [*group, "source"])
    steps = F.array(*[F.lit(k / STEPS) for k in range(STEPS + 1)])
    groups = weighed.groupBy(*group).agg(F.first("n").alias("n"), *[F.percentile(m, steps, F.col("say")).alias(m) for m in names])
    half = lambda m, i: F.struct((F.col(m)[i + STEPS // 2] - F.col(m)[i]).alias("width"), F.col(m)[i].alias("low"), F.col(m)[i + STEPS // 2].alias("high"))
    groups = groups.select(*group, "n", *[F.when(F.col("kind") == "lang", F.array_min(F.array(*[half(m, i) for i in range(STEPS // 2 + 1)]))).otherwise(half(m, STEPS // 4)).alias(m) for m in names])
    ends = []
    for m, (share, least) in LEAST.items():
        low, high, middle = F.col(m)["low"], F.col(m)["high"], (F.col(m)["low"] + F.col(m)["high"]) / 2
        reach = F.greatest(REACH * F.col(m)["width"], share * F.abs(middle), F.lit(least))
        lowest, highest = [F.when(F.col("kind") == "lang", _limit("lang", F.col("name"), m, end)) for end in (0, 1)]
        beyond = (middle < lowest) | (middle > highest)
        ends += [F.when(beyond, lowest).otherwise(F.greatest(low - reach, lowest)).alias(f"low_{m}"), F.when(beyond, highest).otherwise(F.least(high + reach, highest)).alias(f"high_{m}")]
    return groups.select(*group, "n", *ends)


def bands_everywhere(found: DataFrame) -> DataFrame:
    """bands() for every size of the names in it: its own, else the larger neighbour's, else that of all sizes."""
    ends = [c for c in found.columns if c not in ("kind", "name", "size", "n")]
    at = lambda size, far: F.struct(size.cast("long").alias("size"), F.lit(far).alias("far"))
    near = F.array(at(F.col("size"), 0), at(F.col("size") - 1, 1), at(F.col("size") + 1, 1))
    places = F.when(F.col("size") >= 0, near).otherwise(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda k: at(k, 2)))
    spread = found.withColumn("place", F.explode(places)).withColumn("band", F.struct("place.far", (-F.col("n")).alias("less"), *ends))
    return spread.groupBy("kind", "name", F.col("place.size").alias("size")).agg(F.min("band").alias("band")).select("kind", "name", "size", *[F.col(f"band.{c}") for c in ends])


def verdicts(measures: DataFrame) -> DataFrame:
    """measures (with lang) and base_failed, kept. The bands are few rows: languages and scripts times powers of two."""
    found = bands_everywhere(bands(measures))
    ends = [c for c in found.columns if c not in ("kind", "name", "size")]
    out = measures.withColumn("size", F.floor(F.log2("n_tokens")))
    for kind in ("lang", "script"):
        own = found.filter(F.col("kind") == kind).select(F.col("name").alias(kind), "size", *[F.col(c).alias(f"{kind}_{c}") for c in ends])
        out = out.join(own, [kind, "size"], "left")

    def end(m: str, which: int) -> Column:
        fixed = [_limit("lang", F.col("lang"), m, which), _limit("script", F.col("script"), m, which), F.lit(FIXED["other"][""][m][which])]
        return F.coalesce(*[F.col(f"{kind}_{('low', 'high')[which]}_{m}") for kind in ("lang", "script")], *fixed)

    outside = [(F.col(m) < end(m, 0)) | (F.col(m) > end(m, 1)) for m in LEAST]
    rejected = F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in outside]), F.lit(False))
    kept = out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)
    return kept.drop("size", *[f"{kind}_{c}" for kind in ("lang", "script") for c in ends])


def _labelled(df: DataFrame, lang_col: str, source_col: str) -> list[Column]:
    """lang and source of a measured row of df; a column that df lacks is null."""
    return [(F.col("row")[c] if c in df.columns else F.lit(None)).cast("string").alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **vocabulary: str) -> DataFrame:
    """(id_col, the base's counts, base_failed, kept, and the measures) for every text."""
    each = measured(df, text_col, keep=list(dict.fromkeys([id_col, *[c for c in (lang_col, source_col) if c in df.columns]])), **vocabulary)
    each = checkpointed(each.select(F.col("row")[id_col].alias("id"), *_labelled(df, lang_col, source_col), *[name for name, _ in _FIELDS]))
    first = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    out = verdicts(each)
    return out.select(F.col("id").alias(id_col), *first, *[name for name, _ in _FIELDS if name not in first])


def filtered(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **vocabulary: str) -> DataFrame:
    """The rows of df whose text is kept, with df's columns."""
    each = measured(df, text_col, **vocabulary)
    each = checkpointed(each.select("row", *_labelled(df, lang_col, source_col), *[name for name, _ in _FIELDS]))
    return verdicts(each).filter("kept").select(*[F.col("row")[c].alias(c) for c in df.columns])
