"""Operator 11: importance resampling towards a target distribution.

Features of a text are its runs of 1 to N words, hashed into buckets. Each partition works in blocks of about a million
words: words become numbers, the block's suffixes are sorted as far as N words reach (a suffix array), neighbours' common
prefixes (LCP) cut it into runs of one and the same n-gram, each run's n-gram is hashed once, and its bucket goes back to
every place where it occurs. A first pass over both tables adds up the buckets' counts: a row a bucket and partition,
combined before they are shuffled, so what reaches the driver is one row a bucket. A second pass scores the texts by
the buckets' gains. Draws are exact: the scores are sorted over ranges, and a rank is the place in a range and the
sizes of the ranges before it.

Cases: a null or empty text has no features, weight 0, and is never drawn; a null id counts as nothing when it is hashed;
repeated rows are scored and drawn each for itself, and ties go to the smaller id, nulls first, then to more features and
weight, so only equal rows are interchangeable; a text of any length is in one block; empty tables give an empty result or gains
that are all of the smoothing; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.blocks import Block, blocks_of
from halyard.llm.common import batched, checkpointed, id_and_text, id_type, numbered, rows_of

#: Words of a feature at most; buckets; words that a text must have to be drawn; per cent drawn; what is hashed before an id.
N, BUCKETS, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, "7:"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.encode().lower().decode())  # of bytes only A to Z change


def suffix_array(block: Block, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of a block in the order of their suffixes, as far as n words reach in their text; for each place in this
    order the common prefix with the one before; and the length of each suffix. All but the order are at most n."""
    ids, start = block.ids, block.start
    left = np.minimum(np.repeat(start[1:], np.diff(start)) - np.arange(len(ids)), n)  # words up to the text's end
    rank, most = ids + 1, len(block.number) + 1
    columns = [rank]
    for k in range(1, n):
        ahead = np.zeros_like(rank)
        ahead[: max(len(rank) - k, 0)] = rank[k:]
        columns.append(np.where(left > k, ahead, 0))  # nothing follows: before every word
    if n * most.bit_length() < 63:
        key = columns[0]
        for column in columns[1:]:
            key = key * most + column
        order = np.argsort(key)
    else:
        order = np.lexsort(columns[::-1])
    lcp, same = np.zeros(len(ids), np.int8), np.ones(max(len(ids) - 1, 0), bool)
    for column in columns:
        ordered = column[order]
        same &= (ordered[1:] == ordered[:-1]) & (ordered[1:] > 0)
        lcp[1:] += same
    return order, lcp, left[order]


def buckets_of(block: Block, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, buckets) of every occurrence of a feature in a block; each distinct one is hashed once."""
    order, lcp, length = suffix_array(block, n)
    ids = block.ids
    spelled = [w.encode() for w in block.words]
    begun = [crc32(w) for w in spelled]  # of a run of words, and from there of the next one behind a space
    places, found = [], []
    value = np.array(begun, np.int64)[ids[order]] if len(ids) else np.empty(0, np.int64)
    for k in range(1, n + 1):
        held = length >= k  # suffixes that have k words
        first = held & (lcp < k)  # a run begins; its other suffixes follow it at once
        run = np.cumsum(first) - 1
        if k > 1:
            heads = np.flatnonzero(first)
            hashes = [crc32(spelled[w], crc32(b" ", v)) for v, w in zip(value[heads].tolist(), ids[order[heads] + k - 1].tolist(), strict=True)]
            value = np.where(held, np.array([*hashes, 0], np.int64)[run], 0)
        places.append(order[held])
        found.append(value[held] % buckets)
    return np.concatenate(places), np.concatenate(found)


def bucket_counts(texts: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts of (id, text) are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for block in blocks_of((0, words_of(text)) for _, texts in rows_of(batches) for text in texts):
            total += np.bincount(buckets_of(block, n, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm by which a bucket is more frequent in the target; each bucket counts once more."""
    s, t, buckets = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + float(buckets)) / ((a + 1.0) * (t + float(buckets))))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """(id_col, n_words, n_features, weight): for every row the floored mean of its features' gains."""
    shared = df.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def scored(ids: list[pa.Array], block: Block, count: int) -> pa.RecordBatch:
        places, found = buckets_of(block, n, len(shared.value))
        owner = np.repeat(np.arange(count), np.diff(block.start))
        sums = np.zeros(count + 1, np.int64)
        by_place = np.zeros(len(owner) + 1, np.int64)
        np.add.at(by_place, places, shared.value[found])
        sums[1:] = np.add.reduceat(by_place, block.start[:-1]) * (np.diff(block.start) > 0)  # the last place is nobody's
        words = np.diff(block.start)
        features = sum(np.maximum(words - k, 0) for k in range(n))
        weight = np.where(features > 0, sums[1:] // np.maximum(features, 1), 0)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(x, pa.int64()) for x in (words, features, weight))], names=["id", "n_words", "n_features", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []

        def parts() -> Iterator[tuple[int, list[str]]]:
            for batch, texts in rows_of(batches):
                for k, text in enumerate(texts):
                    ids.append(batch.slice(k, 1))
                    yield len(ids) - 1, words_of(text)

        for block in blocks_of(parts()):
            yield scored(ids[: len(block.owner)], block, len(block.owner))
            del ids[: len(block.owner)]

    texts = batched(id_and_text(df, id_col, text_col))
    return texts.mapInArrow(run, f"id {id_type(df, id_col)}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def noise(id_col: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths from an id, the same in every run: the highest scores are draws without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", n: int = N, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """(id_col, n_features, weight, score, rank): rank is 1, 2, 3... of the drawn rows, null of the others."""
    raw = bucket_counts(batched(id_and_text(df, id_col, text_col)), n, buckets)
    aim = bucket_counts(batched(id_and_text(target, target_id, target_text)), n, buckets)
    scored = weights(df, gains(raw, aim), id_col, text_col, n)
    scored = checkpointed(scored.withColumn("score", F.col("weight") + noise(scored[id_col], seed)))
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranked = numbered(able, [F.desc("score"), F.asc_nulls_first(id_col), F.desc("n_features"), F.desc("weight")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).select(id_col, "n_features", "weight", "score", "rank")


ORACLE_SQL = """
WITH RECURSIVE poly(i, c, k) AS (
  SELECT i, i::UBIGINT, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM poly WHERE k < 8
), step AS MATERIALIZED (SELECT list(c ORDER BY i) AS v FROM poly WHERE k = 8),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), worded AS MATERIALIZED (
  SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts
), places AS (SELECT side, r, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
features AS MATERIALIZED (
  SELECT side, r, w[i] AS f FROM places
  UNION ALL SELECT side, r, w[i] || ' ' || w[i + 1] FROM places WHERE i < len(w)
), hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(octet_length(encode(f))), lambda j: ('0x' || substr(hex(encode(f)), 2 * j + 1, 2))::UBIGINT)), lambda c, b: xor(c >> 8, v[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), step
), counts AS (SELECT bucket, count_if(side = 'd') AS s, count_if(side = 'b') AS t FROM features JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counts),
gain AS MATERIALIZED (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g FROM counts, totals),
means AS (SELECT r, count(*) AS n_features, sum(g)::BIGINT AS g FROM features JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
    coalesce(CASE WHEN g % n_features < 0 THEN g // n_features - 1 ELSE g // n_features END, 0) AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM worded LEFT JOIN means USING (r) WHERE side = 'd'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id NULLS FIRST, n_features DESC, weight DESC) AS place, 25 * count_if(n_words >= 20) OVER () // 100 AS drawn FROM scored
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + noise)::BIGINT AS score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM ranked
"""
