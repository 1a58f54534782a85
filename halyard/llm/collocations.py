"""Operator 12: collocations, phrases that stand together more often than their parts would.

Each partition works in shards of about two million words of one language, whose bytes are read at once: where words begin
and end, and their numbers. In a shard every word has a compressed bitmap of its positions: only blocks of WIDTH positions
that aren't empty are kept. Shifting a phrase's bitmap by one and ANDing it with a word's gives the bitmap of the longer
phrase, and popcounts are its occurrences; phrases grow depth first, from a group of first words at a time, so a shard's
memory is bounded. A position stays empty wherever a piece or a text ends, so no phrase crosses one. The shards' popcounts
are added up by Spark. Longer phrases are counted only where the parts that are one word shorter may be frequent enough,
which a bit table of fixed size says (FILTER bits, of hashes): where it errs a phrase is counted in vain, none is missed.

Cases: a null or empty text has no words; a null language is UND; repeated rows count again; texts may have any length
(a shard holds whole texts); equal scores are ordered by count, then by the phrase's bytes; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import batched, checkpointed

#: Words of a phrase at most; occurrences it needs; per cent of a part's that a longer phrase needs to replace it; phrases of a language.
MAX_WORDS, LEAST, COVERED, TOP, UND = 3, 10, 50, 2000, "und"
#: Words of a shard; positions of a bitmap's block; entries of a group of first words; bits of a filter (8 MB); salts of the first ranking.
SHARD, WIDTH, GROUP, FILTER, SALTS = 1 << 21, 8, 1 << 17, 1 << 26, 64
_BLANKS, _BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)  # of a byte: 0 in a word, 1 blank, 2 where a piece ends
_KIND[[*_BLANKS]], _KIND[[*_BREAKS]] = 1, 2
_BITS = np.array([x.bit_count() for x in range(1 << WIDTH)], np.int64)
_BUCKET_BYTES = 1 << 12


class Shard:
    """Texts of one language, to be read at once. size is about their words: what lies between blanks and ends of pieces."""

    def __init__(self, lang: str) -> None:
        self.lang, self.size = lang, 0
        self._texts: list[bytes] = []

    def add(self, text: str) -> None:
        spelled = text.encode().lower()  # of bytes only A to Z change
        self._texts.append(spelled)
        self.size += len(spelled) - len(spelled.translate(None, _BLANKS + _BREAKS)) + 1

    def numbered(self) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The different words, and the texts as word numbers by position; -1 where a piece ends."""
        data = np.frombuffer(b"\n".join([*self._texts, b""]), np.uint8)
        kind = _KIND[data]
        inside = kind == 0
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # the last byte is in no word
        offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
        at = np.flatnonzero((edge == 1) | (kind == 2))
        ids = np.full(len(at), -1, np.int32)
        ids[kind[at] == 0] = words.indices.to_numpy()
        return words.dictionary, ids


class Bitmaps:
    """Sets of positions: entry k says that set of[k] has the positions bits[k] in block[k]; empty blocks have no entry."""

    def __init__(self, of: np.ndarray, block: np.ndarray, bits: np.ndarray) -> None:
        self.of, self.block, self.bits = of, block, bits

    @classmethod
    def of_positions(cls, of: np.ndarray, positions: np.ndarray) -> Bitmaps:
        order = np.sort(of << 32 | positions)  # positions are fewer than 2^32, as a text is shorter than 2^31
        of, positions = order >> 32, order & 0xFFFFFFFF
        block, bits = positions // WIDTH, 1 << (positions % WIDTH)
        first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (block[1:] != block[:-1])])) if len(of) else np.empty(0, np.int64)
        return cls(of[first], block[first], np.add.reduceat(bits, first) if len(first) else bits)

    def picked(self, keep: np.ndarray) -> Bitmaps:
        return Bitmaps(self.of[keep], self.block[keep], self.bits[keep])

    def shifted(self) -> Bitmaps:
        """Every position one further; what leaves a block begins the next."""
        inside, over = (self.bits << 1) & ((1 << WIDTH) - 1), np.flatnonzero(self.bits >> (WIDTH - 1))
        stay = np.flatnonzero(inside)
        return Bitmaps(np.concatenate([self.of[stay], self.of[over]]), np.concatenate([self.block[stay], self.block[over] + 1]), np.concatenate([inside[stay], np.ones(len(over), np.int64)]))

    def anded(self, others: Bitmaps, begins: np.ndarray) -> tuple[np.ndarray, Bitmaps]:
        """ANDs each set with each of others that has its block; others are in the order of blocks, which begin at begins.
        Gives, for every entry that isn't empty, the other set, and the entries under their own set."""
        n = begins[self.block + 1] - begins[self.block]
        mine = np.repeat(np.arange(len(n)), n)
        theirs = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[self.block], n)
        bits = self.bits[mine] & others.bits[theirs]
        some = np.flatnonzero(bits)
        mine = mine[some]
        return others.of[theirs[some]], Bitmaps(self.of[mine], self.block[mine], bits[some])

    def counts(self, sets: int) -> np.ndarray:
        return np.bincount(self.of, _BITS[self.bits], sets).astype(np.int64)


def _may(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = hashes % (8 * len(table))
    return (table[slots >> 3] >> (slots & 7)) & 1 == 1


class Endings:
    """The crc32 of phrases from those of their beginnings, by a blank and a word that follow.

    The crc32 of what goes before moves by each of its bits apart, as the length of what follows says: a table for each length.
    """

    def __init__(self, spelled: list[bytes]) -> None:
        following = [b" " + w for w in spelled]
        self._crc = np.array([*map(crc32, following)], np.int64)
        lengths, first, self._length = np.unique(np.array([*map(len, following)], np.int64), return_index=True, return_inverse=True)
        bits = np.array([[crc32(following[w], 1 << i) ^ crc32(following[w]) for i in range(32)] for w in first.tolist()], np.uint32).reshape(len(lengths), 4, 8)
        moved = np.zeros((len(lengths), 4, 256), np.uint32)
        for i in range(8):
            moved[:, :, 1 << i : 2 << i] = moved[:, :, : 1 << i] ^ bits[:, :, i, None]
        self._moved = moved.ravel()

    def after(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        out, table = self._crc[word], self._length[word] << 10
        for k in range(4):
            out ^= self._moved[table + (before >> (8 * k) & 255) + (k << 8)]
        return out


def phrase_counts(shard: Shard, n: int, tables: list[np.ndarray], group: int = GROUP) -> Iterator[tuple[list[str], np.ndarray]]:
    """phrase_arrays with phrases as lists."""
    for phrases, counts in phrase_arrays(shard, n, tables, group):
        yield phrases.to_pylist(), counts


def phrase_arrays(shard: Shard, n: int, tables: list[np.ndarray], group: int = GROUP) -> Iterator[tuple[pa.StringArray, np.ndarray]]:
    """Phrases of n words in a shard and how often each occurs, in groups; tables[k] says which of k + 1 words may be frequent.

    Phrases are known by their word numbers and hashes; only those that are counted in the end are spelled out.
    """
    words, ids = shard.numbered()
    if n == 1:
        yield words.cast(pa.string()), np.bincount(ids[ids >= 0], minlength=len(words))
        return
    spelled = words.cast(pa.large_binary()).to_pylist()
    before = crc32(f"{shard.lang}\0".encode())
    hashes = np.array([crc32(w, before) for w in spelled], np.int64)
    able = _may(tables[0], hashes)
    endings = Endings(spelled) if n > 2 else None
    places = np.flatnonzero((ids >= 0) & able[ids]) if len(words) else np.empty(0, np.int64)
    roots = Bitmaps.of_positions(ids[places].astype(np.int64), places)
    singles = roots.picked(np.argsort(roots.block, kind="stable"))
    begins = np.searchsorted(singles.block, np.arange(len(ids) // WIDTH + 3))

    def grown(sets: Bitmaps, members: np.ndarray, whole: np.ndarray, tail: np.ndarray) -> Iterator[tuple[pa.StringArray, np.ndarray]]:
        """members: the words of each set's phrase; whole, tail: the hashes of the phrases, and of them without their first word."""
        depth = members.shape[1] + 1
        word, found = sets.shifted().anded(singles, begins)
        pairs = pa.array(found.of * len(words) + word).dictionary_encode()
        pair, found.of = pairs.dictionary.to_numpy(), pairs.indices.to_numpy()
        old, new = pair // len(words), pair % len(words)
        ends = endings.after(tail[old], new) if depth > 2 else hashes[new]
        keep = _may(tables[depth - 2], ends) if depth > 2 else np.ones(len(pair), bool)
        if depth == n:
            kept = np.flatnonzero(keep)
            if len(kept):
                columns = [words.take(pa.array(column)) for column in (*members[old[kept]].T, new[kept])]
                yield pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())).cast(pa.string()), found.counts(len(pair))[kept]
            return
        phrase = endings.after(whole[old], new)
        keep &= _may(tables[depth - 1], phrase)
        if keep.any():
            deeper = found.picked(keep[found.of])
            deeper.of = (np.cumsum(keep) - 1)[deeper.of]
            yield from grown(deeper, np.column_stack([members[old], new])[keep], phrase[keep], ends[keep])

    at = 0
    while at < len(roots.of):  # whole first words, about group entries of them
        end = int(np.searchsorted(roots.of, roots.of[min(at + group, len(roots.of)) - 1], side="right"))
        yield from grown(roots.picked(np.arange(at, end)), np.arange(len(words))[:, None], hashes, hashes)
        at = end


def _counted(texts: DataFrame, n: int, tables: list[np.ndarray], shard_words: int = SHARD, group: int = GROUP) -> DataFrame:
    """(lang, phrase, n): occurrences over all shards of (lang, text). Within shards they are added up already, so each goes straight to its sum."""
    shared = texts.sparkSession.sparkContext.broadcast(tables)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for shard in shards.values():
                for phrases, counts in phrase_arrays(shard, n, shared.value, group):
                    yield pa.RecordBatch.from_arrays([pa.repeat(shard.lang, len(phrases)), phrases, pa.array(counts, pa.int64())], names=["lang", "phrase", "n"])
            shards.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = shards.setdefault(lang, Shard(lang)) if lang not in shards else shards[lang]
                size -= shard.size
                shard.add(text)
                size += shard.size
                if size >= shard_words:
                    yield from emptied()
                    size = 0
        yield from emptied()

    return texts.mapInArrow(run, "lang string, phrase string, n long").repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _table(frequent: DataFrame, bits: int = FILTER) -> np.ndarray:
    """The bit table of (lang, phrase) rows: so many bits in all, whatever their number."""
    at = F.crc32(F.concat_ws("\0", "lang", "phrase").cast("binary")) % bits + 1
    rows = frequent.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in rows.collect():  # bits / 32,768 rows at most, 4 kB each
        begin = (row.bucket - 1) * _BUCKET_BYTES
        out[begin : begin + _BUCKET_BYTES] = np.frombuffer(row.bits, np.uint8)
    return out


def counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, shard_words: int = SHARD, group: int = GROUP, filter_bits: int = FILTER) -> tuple[DataFrame, DataFrame]:
    """(lang, n) with the words of each language, and (lang, phrase, n, words) of the phrases that occur often enough."""
    lang = F.coalesce(df[lang_col].cast("string"), F.lit(UND)) if lang_col in df.columns else F.lit(UND)
    texts = batched(df.select(lang.alias("lang"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text")))
    tables: list[np.ndarray] = []
    total = found = None
    for n in range(1, max_words + 1):
        counted = _counted(texts, n, tables, shard_words, group)
        if n == 1:
            counted = checkpointed(counted)
            total = counted.groupBy("lang").agg(F.sum("n").alias("n"))
        frequent = checkpointed(counted.filter(F.col("n") >= least).withColumn("words", F.lit(n)))
        found = frequent if found is None else found.unionByName(frequent)
        if n < max_words:
            tables.append(_table(frequent, filter_bits))
    return total, found


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, covered: int = COVERED, top: int = TOP, **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to max_words words.

    Counts are exact to 10^16: products are decimals of 38 digits. sizes: shard_words, group and filter_bits, on which no result depends.
    """
    total, found = counts(df, text_col, lang_col, max_words, least, **sizes)
    candidates = found.filter("words > 1")
    part = lambda first, length: F.array_join(F.slice("w", first, length), " ")
    split = candidates.select("lang", "phrase", F.col("n").alias("a"), "words", F.split("phrase", " ").alias("w"))
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("words") - F.col("k"))})
    side = lambda key, n: found.select("lang", F.col("phrase").alias(key), F.col("n").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    number = lambda c: F.col(c).cast("decimal(16,0)")
    cuts = cuts.withColumns({"aa": F.lit(1_000_000).cast("decimal(7,0)") * number("a") * number("a"), "lr": number("l") * number("r")})
    cuts = cuts.withColumn("score", F.expr("aa div lr"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Parts of a longer phrase that has most of their occurrences
    longer = split.filter("words > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
    held = longer.select("lang", part(F.col("i"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    kept = scored.join(held, ["lang", "phrase"], "left").filter(F.coalesce(F.lit(100) * F.col("held") < F.lit(covered) * F.col("a"), F.lit(True)))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("rank") <= top)  # of a hot language first by salts
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return rows.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), listed AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
words AS (SELECT lang, p, unnest(w) AS x, unnest(range(len(w))) AS i FROM listed),
grams AS MATERIALIZED (SELECT lang, x, lead(x) OVER (PARTITION BY p ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY p ORDER BY i) AS z FROM words),
f AS MATERIALIZED (
  SELECT lang, x AS phrase, 1 AS m, count(*) AS n FROM grams GROUP BY ALL
  UNION ALL SELECT lang, x || ' ' || y, 2, count(*) FROM grams WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, x || ' ' || y || ' ' || z, 3, count(*) FROM grams WHERE z IS NOT NULL GROUP BY ALL
), total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
candidate AS MATERIALIZED (SELECT lang, phrase, string_split(phrase, ' ') AS w, m, n AS a FROM f WHERE m > 1 AND n >= 10),
cut AS (SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS rest FROM candidate, range(1, 3) g(k) WHERE k < m),
scored AS (
  SELECT cut.lang, cut.phrase, m, a, k, x.n AS l, y.n AS r, 1000000::HUGEINT * a::HUGEINT * a::HUGEINT // (x.n::HUGEINT * y.n::HUGEINT) AS score
  FROM cut JOIN (SELECT lang, phrase, n FROM f) x ON x.lang = cut.lang AND x.phrase = head JOIN (SELECT lang, phrase, n FROM f) y ON y.lang = cut.lang AND y.phrase = rest
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, k) = 1
), held AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM candidate WHERE m = 3
), ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, l, r, score
  FROM scored s WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = s.lang AND h.phrase = s.phrase AND 100 * h.a >= 50 * s.a)
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
