"""Operator 13: a mixture of sources by weight, as a schedule of slots that each hold a block of one source.

Targets: sources share all words by weight; one that would take more than EPOCHS times its words stops there, and the rest is
shared again. Each round is one aggregate over the sources. The schedule has a power of two of slots; slot i stands at the van der
Corput point of i (its bits in reverse), and the cumulative shares of the sources cut the line of points into intervals, so a source
has its share of every stretch of the schedule, to within a few slots. All points of an interval are consecutive numbers in
reverse, so a source's slots are listed without a join over ranges, and a slot's rank among its source's is counted from
its bits, without a sort. A source's documents, shuffled by a hash, are one stream that is cut into blocks of equal size (to
a word); the slot of rank k takes block k of the stream, which begins again where it ends. The last slot of a source is
cut where its target is reached; where its interval has too few slots for that, the schedule's end has the others.

The shuffled stream's offsets are sums within buckets of the hash and of whole buckets, so no task sees a whole source.

Cases: a null or empty text has no words and is taken 0 times; a null source is a source, the last; repeated rows are
taken each for itself, and rows that tie in the shuffle (one id and size) are interchangeable; a null id counts as nothing
when it is hashed; a long text runs over many blocks; an empty table, or one without words, gives an empty schedule and
targets of 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import checkpointed, numbered

#: Weights of the sources in their order, repeating; how often a source may be taken; words of a slot at most; buckets of the shuffle; what is hashed before an id.
WEIGHTS, EPOCHS, SLOT, BUCKETS, SEED = (5, 2, 1), 3, 4096, 4096, "mix:"
_WORD = r"[^\x20\x09-\x0D]+"
#: Slots that one row of a source's interval lists.
_LISTED = 1 << 16


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """(id, source, size, hash, bucket): the words of every row and its place in the shuffle."""
    source = df[source_col].cast("string") if source_col in df.columns else F.lit(None).cast("string")
    shuffled = F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(df[id_col].cast("string"), F.lit(""))), 256), 1, 15)
    rows = df.select(df[id_col].alias("id"), source.alias("source"), F.regexp_count(F.coalesce(df[text_col].cast("string"), F.lit("")), F.lit(_WORD)).cast("long").alias("size"), shuffled.alias("hash"))
    return rows.withColumn("bucket", F.conv(F.substring("hash", 1, 3), 16, 10).cast("int") % BUCKETS)


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from rows with source and size."""
    sources = numbered(checkpointed(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), [F.asc_nulls_last("source")], "no")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("no") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    sources = sources.withColumns({"weight": weight, "most": F.col("source_size") * epochs})
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    held, share, shared, free = -1, F.lit(0.0), 0, 1
    while True:  # a round for each time that a source stops at its most
        stops = F.lit(False) if held < 0 else F.col("most") < F.lit(float(shared)) * F.col("weight") / F.lit(float(free))
        now = sources.agg(F.count_if(stops).alias("held"), F.sum(F.when(stops, F.col("most")).otherwise(0)).alias("most"), F.sum(F.when(stops, 0).otherwise(F.col("weight"))).alias("free")).first()
        share = F.when(stops, F.col("most").cast("double")).otherwise(F.lit(float(shared)) * F.col("weight") / F.lit(float(free)))
        if (now.held or 0) == held or not now.free:
            break
        held, shared, free = now.held or 0, total - (now.most or 0), now.free
    return sources.select("source", "source_size", "weight", share.cast("double").alias("target"))


def block_start(block: Column, size: Column, blocks: Column) -> Column:
    """Where a block begins in a stream of size words: blocks differ by a word at most, the longer ones first."""
    return block * F.expr("source_size div blocks") + F.least(block, size % blocks)


def block_of(word: Column) -> Column:
    """The block that a word of a stream is in."""
    short, longer = F.expr("source_size div blocks"), F.col("source_size") % F.col("blocks")
    edge = longer * (short + 1)
    return F.when(word < edge, F.floor(word / (short + 1))).otherwise(longer + F.floor((word - edge) / F.greatest(short, F.lit(1)))).cast("long")


def stream(rows: DataFrame) -> DataFrame:
    """rows with start, the words of their source before them in the shuffled order, and row, their number in their bucket."""
    within = Window.partitionBy("source", "bucket").orderBy("hash", F.asc_nulls_first("id"), "size")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sums = sums.withColumn("before", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))  # BUCKETS rows a source at most
    placed = rows.withColumns({"row": F.row_number().over(within), "own": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    sums = sums.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "before")
    joined = placed.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    return joined.select("id", "source", "size", "bucket", "row", (F.col("before") + F.col("own")).alias("start"))


def _reversed(x: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros_like(x)
    for k in range(bits):
        out |= ((x >> k) & 1) << (bits - 1 - k)
    return out


def rank_below(slot: np.ndarray, limit: int, bits: int) -> np.ndarray:
    """How many slots before each of slot have a van der Corput number below limit.

    The slots before one fall into a run of 2^k for each bit k that it has: there the lower k bits are free, so the numbers are those of
    the fixed bits and every multiple of 2^(bits - k).
    """
    out = np.zeros_like(slot)
    for k in range(bits):
        has = (slot >> k) & 1 == 1
        fixed = _reversed((slot >> (k + 1)) << (k + 1), bits)
        step = 1 << (bits - k)
        out += np.where(has, np.clip(-((fixed - limit) // step), 0, 1 << k), 0)
    return out


def slots_of(total: int, slot_words: int = SLOT) -> tuple[int, int]:
    """(bits, words): 2^bits slots of so many words hold a total; the least power of two whose slots have at most slot_words."""
    bits = (-(-total // slot_words) - 1).bit_length() if total else 0
    return bits, max(1, -(-total // (1 << bits)))


def schedule(shares: DataFrame, slot_words: int = SLOT) -> DataFrame:
    """(slot, source, source_size, blocks, rank, epoch, block, words): which block of its source every slot takes, and how many of its words.

    shares: what targets() gives. words is less than the block's only in a source's last slot.
    """
    wanted = F.floor("target").cast("long")
    stats = shares.agg(F.sum("source_size").alias("words")).first()
    bits, size = slots_of(stats.words or 0, slot_words)
    slots = 1 << bits
    plan = shares.filter((F.col("source_size") > 0) & (wanted > 0)).withColumns({"wanted": wanted, "blocks": F.ceil(F.col("source_size") / F.lit(size)).cast("long")})
    # Sources on the line of points, in order; their ends are cumulative shares
    ends = _cumulated(plan, slots)
    full = F.expr("wanted div source_size")
    rest = F.col("wanted") - full * F.col("source_size")
    ends = ends.withColumn("needed", full * F.col("blocks") + F.when(rest > 0, block_of(rest - 1) + 1).otherwise(0))
    runs = ends.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(high - low - 1) div {_LISTED}"), F.lit(0)))))
    runs = runs.repartition(F.col("source"), F.col("run"))  # of a hot source, too, every run for itself

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (low, high, needed, run) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("low", "high", "needed", "run")), strict=True)):
                points = np.arange(low + run * _LISTED, min(high, low + (run + 1) * _LISTED), dtype=np.int64)
                at = _reversed(points, bits)
                rank = rank_below(at, high, bits) - rank_below(at, low, bits)
                if run == 0 and needed > high - low:  # what the interval has too few slots for comes at the end
                    at = np.concatenate([at, np.full(needed - (high - low), slots)])
                    rank = np.concatenate([rank, np.arange(high - low, needed)])
                keep = rank < needed
                at, rank = at[keep], rank[keep]
                same = pa.array(np.full(len(at), k))
                yield pa.RecordBatch.from_arrays([batch.column("source").take(same), *(batch.column(c).take(same) for c in ("source_size", "blocks", "wanted")), pa.array(at, pa.int64()), pa.array(rank, pa.int64())], names=["source", "source_size", "blocks", "wanted", "slot", "rank"])

    made = runs.mapInArrow(listed, "source string, source_size long, blocks long, wanted long, slot long, rank long")
    made = made.withColumns({"epoch": F.expr("rank div blocks"), "block": F.expr("rank % blocks")})
    begin = block_start(F.col("block"), F.col("source_size"), F.col("blocks"))
    length = block_start(F.col("block") + 1, F.col("source_size"), F.col("blocks")) - begin
    left = F.col("wanted") - F.col("epoch") * F.col("source_size") - begin
    return made.select("slot", "source", "source_size", "blocks", "rank", "epoch", "block", F.least(length, left).alias("words"))


def _cumulated(plan: DataFrame, slots: int) -> DataFrame:
    """plan with low and high, each source's points: what its target and those before it make of all slots, rounded up.

    Every source begins where the one before it ends. The sums are over ranges of sources and of whole ranges.
    """
    rows = numbered(plan, [F.asc_nulls_last("source")], "no").withColumn("range", F.floor((F.col("no") - 1) / F.lit(1024)).cast("long"))
    ranges = rows.groupBy("range").agg(F.sum("wanted").alias("in_range"))
    ranges = numbered(ranges, [F.asc("range")], "at").withColumn("zero", F.lit(0))
    before = ranges.withColumn("before", F.sum("in_range").over(Window.partitionBy("zero").orderBy("range")) - F.col("in_range")).select("range", "before")  # a row for 1,024 sources
    total = F.lit(float(plan.agg(F.sum("wanted")).first()[0] or 1))
    upto = F.sum("wanted").over(Window.partitionBy("range").orderBy("no")) + F.col("before")
    rows = rows.join(before, "range").withColumn("upto", upto)
    point = lambda words: F.least(F.ceil(words.cast("double") * F.lit(float(slots)) / total).cast("long"), F.lit(slots).cast("long"))
    return rows.withColumns({"low": point(F.col("upto") - F.col("wanted")), "high": point(F.col("upto"))}).drop("no", "range", "before", "upto")


def mixture(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, slot_words: int = SLOT, seed: str = SEED) -> DataFrame:
    """(slot, source, source_size, target, epoch, block, id, size, bucket, row, first_word, n_words): what every slot holds, a row for each
    piece of a document; a document that no slot takes has one row without slot, 0 words.
    """
    rows = checkpointed(sized(df, id_col, text_col, source_col, seed))
    shares = checkpointed(targets(rows, weights, epochs))
    plan = schedule(shares, slot_words)
    blocks = plan.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "slot", "epoch", "words")
    _, size = slots_of(shares.agg(F.sum("source_size")).first()[0] or 0, slot_words)
    known = shares.select(F.col("source").alias("_s"), "source_size", "target", F.greatest(F.ceil(F.col("source_size") / F.lit(size)).cast("long"), F.lit(1)).alias("blocks"))
    placed = stream(rows).join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    within = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(block_of(F.col("start")), block_of(F.col("start") + F.col("size") - 1)))))
    both = within.join(blocks.hint("merge"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left")
    begin = block_start(F.col("block"), F.col("source_size"), F.col("blocks"))
    first = F.greatest(F.col("start"), begin)
    last = F.least(F.col("start") + F.col("size"), block_start(F.col("block") + 1, F.col("source_size"), F.col("blocks")), begin + F.col("words"))
    return both.select("slot", "source", "source_size", "target", "epoch", "block", "id", "size", "bucket", "row", (first - F.col("start")).alias("first_word"), F.when(F.col("slot").isNotNull(), F.greatest(last - first, F.lit(0))).otherwise(0).cast("long").alias("n_words"))


def taken(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, size, source_size, target, taken) from the result of mixture(): how many words of every document the mix takes."""
    of = mixed.groupBy("source", "bucket", "row", F.col("id").alias(id_col), "size", "source_size", "target").agg(F.sum("n_words").cast("long").alias("taken"))
    return of.select(id_col, "size", "source_size", "target", "taken")


ORACLE_SQL = """
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, substr(sha256('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15) AS h FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight FROM docs GROUP BY source
), ordered AS (  -- in the order in which sources stop at three times their size
  SELECT *, sum(3 * source_size) OVER w - 3 * source_size AS most_before, sum(weight) OVER w - weight AS weight_before, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights
  FROM sources WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)
), stops AS (
  SELECT *, 3 * source_size < (words - most_before)::DOUBLE * weight / (weights - weight_before) AS stopped FROM ordered
), level AS (
  SELECT any_value(words) - coalesce(sum(3 * source_size) FILTER (stopped), 0) AS shared, sum(weight) FILTER (NOT stopped) AS free FROM stops
), target AS (
  SELECT source, source_size, CASE WHEN stopped THEN (3 * source_size)::DOUBLE ELSE shared::DOUBLE * weight::DOUBLE / free::DOUBLE END AS target FROM stops, level
), placed AS (
  SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS start, floor(t.target)::BIGINT AS wanted
  FROM docs d JOIN target t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE (wanted // source_size) * size + greatest(0, least(start + size, wanted % source_size) - start) END::BIGINT AS taken
FROM placed
"""
