"""Operator 9: n-gram Jaccard join by signature trees; exact, and without a pair for every two copies.

A text's set holds its distinct SIZE-word shingles as 64-bit hashes. Two texts link if their sets' Jaccard similarity is
at least THRESHOLD per cent; components of links are returned.

1. Texts with equal sets are one class, told by 128 bits; what follows works on classes, which are numbered.
2. Prefix filter: each class hands on its n - ceil(0.8 n) + 1 + n / 20 smallest hashes. Two classes that link have at
   least 1 + n / 25 of them in common (n the larger set's size), so classes with fewer shared ones have no partner and
   drop out. Sets travel only for the others; they are picked by a table of FILTER_BITS bits for each, which is all that
   reaches the driver: FILTER bits at most, beyond which more sets travel than need to, but none is left out.
3. Classes meet at their smallest hash. A group's signature tree has nodes with the OR of the bitmaps below and their
   range of set sizes; a traversal of pairs of nodes drops those whose largest possible overlap is below what their sizes
   ask for, and compares the sets that remain unless they are connected by then. A task hands on one link for each two
   components that it joins, so fewer links than members.
4. Rare keys: of each class's shingles, ordered by how many classes have them, all but the most frequent ceil(0.8 n) - 1.
   Two classes that link share the rarest of their common shingles there. Passages that many texts have drop out by it.
5. Classes whose component meets another at a rare key meet again, at HOMES hashes that are the smallest by other orders.
   The trees compare all that meet; large groups are dealt out in blocks, and every two blocks meet.
6. Two classes are still open if they share a rare key, their sizes let them link, their components differ, and they met
   at no home of 5. Those pairs have their sets compared. Near copies, linked or not, have nearly all met by then, so
   few pairs are left however large their groups; no pair that can link is left out.

Cases: a null text counts as empty; a text without words has no shingle, links with nothing and is its own component;
one with fewer than SIZE words has its whole sequence as its one shingle; repeated rows and equal texts share a
component, null ids count only if a component has no other; ties cannot matter as the smallest id names a component; an
empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import batched, checkpointed, id_and_text, id_type, rows_of, unused
from halyard.llm.vocabularies import held

SIZE = 5
THRESHOLD = 80
#: Bits of a class's bitmap at least and at most (in between 16 to 32 for a shingle), and members of a tree's node.
BITS, MOST_BITS, FAN = 1024, 1 << 16, 16
#: Classes and shingles of a block; a task compares two blocks of a group at once.
BLOCK, BLOCK_SHINGLES = 2000, 1 << 21
#: Homes at which classes meet that rare keys leave open.
HOMES = 4
#: Bits for each class of the table of those that may have a partner, and bits of the table at most: 128 MB.
FILTER_BITS, FILTER = 16, 1 << 30
_SHIFTS = (0, 17, 33)
#: Classes that a task remembers having handed on, and words whose hashes it keeps.
REMEMBERED, WORDS = 200_000, 100_000
#: Sets that are picked by a broadcast of their numbers (8 bytes each); beyond it, by a shuffle.
PICKED = 200_000
#: Links between components that one task joins (16 bytes each); more are joined in rounds.
JOINED = 100_000

_WEIGHTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int = SIZE) -> np.ndarray:
    """The distinct shingles of a text, as sorted hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = held(_Words)
    if len(known) > WORDS:
        known.clear()
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    total = np.full(len(ids) - width + 1, np.uint64(0x51_7CC1B727220A95 * width & (2**64 - 1)))
    for k in range(width):
        total += ids[k : len(ids) - width + 1 + k] * (_WEIGHTS[k % len(_WEIGHTS)] + np.uint64(2 * (k // len(_WEIGHTS))))
    return np.unique(_mixed(total))


def needed_overlap(n):
    """The least overlap with any partner that a set of n can have."""
    return (THRESHOLD * n + 99) // 100


def handed_on(n: int) -> int:
    return min(n, n - needed_overlap(n) + 1 + n // 20)


def linked(overlap: int, a: int, b: int) -> bool:
    return 100 * overlap >= THRESHOLD * (a + b - overlap)


def class_of(hashes: np.ndarray) -> tuple[int, int]:
    """What equal sets have in common, as two signed numbers."""
    both = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (both >> 64) - (1 << 63), (both & (1 << 64) - 1) - (1 << 63)


def homes_of(hashes: np.ndarray, turns: int) -> np.ndarray:
    """For each of some orders the hash that is smallest by it."""
    return np.array([_mixed(hashes ^ np.uint64(0x2545F4914F6CDD1D * t & (2**64 - 1))).min() if t else hashes.min() for t in range(turns)], np.uint64)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *[a.view(np.int64) for a in arrays]]), kind))


# -- signature trees


def bitmap(hashes: np.ndarray, width: int = BITS) -> np.ndarray:
    bits = np.zeros(width, np.uint8)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


class Tree:
    """Nodes of FAN members each, level by level: the OR of their bitmaps, their sizes, how many shingles share bits, and
    the label that all members below have (or -1)."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, labels: np.ndarray | None = None) -> None:
        spare = sizes - np.bitwise_count(bitmaps).sum(axis=1).astype(np.int64)
        self.levels = [(sizes, sizes, bitmaps, spare, np.full(len(sizes), -1) if labels is None else labels)]
        while len(self.levels[-1][0]) > 1:
            least, most, marks, spare, label = self.levels[-1]
            at = np.arange(0, len(least), FAN)
            same = np.minimum.reduceat(label, at) == np.maximum.reduceat(label, at)
            self.levels.append((np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.bitwise_or.reduceat(marks, at, axis=0), np.maximum.reduceat(spare, at), np.where(same, label[at], -1)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each two of the nodes a and b: whether members of both could link and aren't known to be connected, and the
        largest overlap they could have."""
        least, most, marks, spare, label = self.levels[level]
        most_a, most_b, least_a, least_b = most[a][:, None], most[b][None, :], least[a][:, None], least[b][None, :]
        could = (100 * most_a >= THRESHOLD * least_b) & (100 * most_b >= THRESHOLD * least_a)
        could &= (label[a][:, None] != label[b][None, :]) | (label[a][:, None] < 0)
        overlap = np.bitwise_count(marks[a][:, None, :] & marks[b][None, :, :]).sum(axis=2).astype(np.int64) + np.minimum(spare[a][:, None], spare[b][None, :])
        overlap = np.minimum(overlap, np.minimum(most_a, most_b))
        return could & ((100 + THRESHOLD) * overlap >= THRESHOLD * (least_a + least_b)), overlap

    def leaves(self, apart: Callable[[np.ndarray, np.ndarray], bool]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(members, members, whether two could link, largest overlap) of each pair of leaf nodes that a traversal reaches.

        apart: whether anything between two sets of members is still open; asked when the pair comes up.
        """
        top = len(self.levels) - 1
        stack = [(top, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            below = level - 1
            if below < 0:
                return  # a single member
            n = len(self.levels[below][0])
            a, b = np.arange(i * FAN, min(n, i * FAN + FAN)), np.arange(j * FAN, min(n, j * FAN + FAN))
            if below == 0:
                if apart(a, b):
                    yield (a, b, *self.possible(0, a, b))
                continue
            for x, y in zip(*(k.tolist() for k in np.nonzero(self.possible(below, a, b)[0])), strict=True):
                if i < j or x <= y:
                    stack.append((below, int(a[x]), int(b[y])))


def _find(parent: list[int] | dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def links_of(sets: list[np.ndarray], comps: list[int], sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between sets of different components, one for each two components that it joins.

    sides: sets of one side, unless negative, have been compared before.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    least: dict[int, int] = {}
    for c, n in zip(comps, sizes.tolist(), strict=True):
        least[c] = min(n, least.get(c, n))
    order = sorted(range(len(sets)), key=lambda k: (least[comps[k]], comps[k], sizes[k]))
    place: dict[int, int] = {}
    own = np.array([place.setdefault(comps[k], len(place)) for k in order], np.int64)
    parent = list(range(len(place)))
    width = min(MOST_BITS, max(BITS, 16 << int(sizes.max() - 1).bit_length()))
    tree = Tree(sizes[order], np.array([bitmap(sets[k], width) for k in order]).reshape(len(sets), -1), own)
    side = np.array([sides[k] for k in order]) if sides is not None else np.full(len(sets), -1)
    out = []
    for a, b, could, _ in tree.leaves(lambda a, b: len({_find(parent, x) for x in {*own[a].tolist(), *own[b].tolist()}}) > 1):
        could &= (side[a][:, None] != side[b][None, :]) | (side[a][:, None] < 0)
        for x, y in zip(*(k.tolist() for k in np.nonzero(could)), strict=True):
            i, j = int(a[x]), int(b[y])
            if i < j and (p := _find(parent, int(own[i]))) != (q := _find(parent, int(own[j]))):
                one, other = order[i], order[j]
                if linked(overlap_of(sets[one], sets[other]), len(sets[one]), len(sets[other])):
                    parent[max(p, q)] = min(p, q)
                    out.append((one, other))
    return out


def overlap_of(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


# -- distributed steps


def _met(keys: DataFrame, member: str) -> DataFrame:
    """The rows of keys (one a key and member) that meet another there whose size lets them link.

    Ordered by size, the nearest sizes decide; the window reads one exchange, and a large key spills.
    """
    by_size = Window.partitionBy("key").orderBy("n", member)
    before, after = F.coalesce(F.lag("n").over(by_size), F.lit(0)), F.lead("n").over(by_size)
    near = (100 * before >= THRESHOLD * F.col("n")) | F.coalesce(100 * F.col("n") >= THRESHOLD * after, F.lit(False))
    return keys.withColumn("_near", near).filter("_near").drop("_near")


def _apart(keys: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, no, n, comp) where components meet; like all that follows within a key, it reads one exchange."""
    of_key = Window.partitionBy("key")
    marked = keys.join(comps, "no").withColumn("_lo", F.min("comp").over(of_key)).withColumn("_hi", F.max("comp").over(of_key))
    return _met(marked.filter("_lo <> _hi").drop("_lo", "_hi"), "no").select("key", "no", "n", "comp")


def prefixes(texts: DataFrame, size: int) -> DataFrame:
    """(key, cls, n): the hashes that each class hands on; copies within a task hand theirs on once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, batch in rows_of(batches):
            classes, sizes, keys = [], [], []
            for text in batch:
                hashes = shingles(text, size)
                if len(hashes) and (c := class_of(hashes)[0]) not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(c)
                    classes.append(c)
                    sizes.append(len(hashes))
                    keys.append(hashes[: handed_on(len(hashes))])
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()), _lists(keys, pa.int64())], names=["cls", "n", "keys"])

    return texts.mapInArrow(run, "cls long, n int, keys array<long>").select(F.explode("keys").alias("key"), "cls", "n")


def with_partners(keys: DataFrame) -> DataFrame:
    """(cls): the classes that share enough keys with others to have a partner; a few more may be among them."""
    shared = checkpointed(_met(keys.repartition("key").dropDuplicates(["key", "cls", "n"]), "cls"))
    enough = F.count(F.lit(1)).over(Window.partitionBy("cls")) >= 1 + F.floor(F.col("n") / 25)
    again = _met(shared.withColumn("_enough", enough).filter("_enough").drop("_enough"), "cls")
    return checkpointed(again.groupBy("cls", "n").count().filter(F.col("count") >= 1 + F.floor(F.col("n") / 25)).select("cls").distinct())


def filter_table(classes: DataFrame) -> np.ndarray:
    """A table of a power of two of bits, with three of each class set; classes is read twice."""
    size = min(FILTER, max(1 << 10, 1 << (FILTER_BITS * classes.count()).bit_length()))
    mask = F.lit(size - 1).cast("long")
    at = F.array(*[F.shiftrightunsigned("cls", s).bitwiseAND(mask) for s in _SHIFTS])
    words = classes.select(F.explode(at).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint64)


def _in_table(table: np.ndarray, cls: int) -> bool:
    c, mask = cls & (2**64 - 1), 64 * len(table) - 1
    return all(int(table[(p := c >> s & mask) >> 6]) >> (p & 63) & 1 for s in _SHIFTS)


def classified(texts: DataFrame, size: int, table: np.ndarray, kind: str) -> DataFrame:
    """(id, cls, rest, n, hashes) for every text; the last only for classes in the table, once a task."""
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for ids, batch in rows_of(batches):
            classes, sizes, kept = [], [], []
            for text in batch:
                hashes = shingles(text, size)
                c = class_of(hashes) if len(hashes) else (None, None)
                classes.append(c)
                sizes.append(len(hashes))
                if c[0] is None or c in seen or not _in_table(shared.value, c[0]):
                    kept.append(None)
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(c)
                kept.append(hashes.tobytes())
            columns = [ids, *(pa.array([c[k] for c in classes], pa.int64()) for k in (0, 1)), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cls", "rest", "n", "hashes"])

    return texts.mapInArrow(run, f"id {kind}, cls long, rest long, n long, hashes binary")


def numbered(each: DataFrame) -> DataFrame:
    """(cls, rest, n, hashes, no): the sets that travel, one a class, with a number for each."""
    once = each.filter("hashes is not null").select("cls", "rest", "n", "hashes").dropDuplicates(["cls", "rest"])
    return checkpointed(once.withColumn("no", F.monotonically_increasing_id()))


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Stretches of rows sorted by their first `by` columns, and where each group begins and the last ends; no group is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        if held and all(held[-1].column(k)[len(held[-1]) - 1] == batch.column(k)[len(batch) - 1] for k in range(by)):
            held.append(batch)  # one group goes on through the whole batch
            continue
        rows = pa.Table.from_batches([*held, batch])
        starts = _starts(rows, by)
        if starts[-1]:
            yield rows.slice(0, starts[-1]), starts
        held = rows.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, np.append(_starts(rows, by), len(rows))


def _starts(rows: pa.Table, by: int) -> np.ndarray:
    """Where groups begin; the beginning of the last one only ends the one before."""
    new = np.zeros(len(rows), bool)
    new[0] = True
    for k in range(by):
        values = rows.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _picked(sets: DataFrame, numbers: DataFrame) -> DataFrame:
    """The sets whose numbers are wanted; numbers is read twice."""
    return sets.join(F.broadcast(numbers) if numbers.count() <= PICKED else numbers, "no", "left_semi")


def _dealt(members: DataFrame, group: list[str], across: bool) -> DataFrame:
    """members (with n) of each group in blocks, `one` and `other` naming the two blocks that meet, side the own one of two.

    across: every two blocks of a group meet, else each is by itself.
    """
    sized = members.groupBy(*group).agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("of"))
    block = F.pmod(F.xxhash64("no"), F.col("of"))
    placed = members.join(sized, group).withColumn("block", block)
    if not across:
        return placed.select(*members.columns, F.col("block").alias("one"), F.col("block").alias("other"), F.lit(-1).cast("long").alias("side"))
    both = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    side = F.when(F.col("with") == F.col("block"), F.lit(-1)).otherwise(F.col("block")).cast("long")
    return both.select(*members.columns, F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), side.alias("side"))


def links_at_homes(sets: DataFrame, comps: DataFrame | None, turns: range) -> DataFrame:
    """(a, b): links between sets that share a home and whose components differ, one for each two that a task joins.

    comps: None if each set is a component; then blocks of a large group stay by themselves.
    """

    def homed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes = [homes_of(np.frombuffer(x, np.uint64), turns.stop)[turns.start :] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(homes, pa.int64())], names=["no", "n", "hashes", "comp", "homes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _groups(batches, 4):
            numbers, found = rows["no"].to_numpy(), []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = rows["comp"].slice(s, e - s).to_pylist()
                if e - s > 1 and len(set(own)) > 1:
                    held = [np.frombuffer(x.as_py(), np.uint64) for x in rows["hashes"].slice(s, e - s)]
                    found += [(s + i, s + j) for i, j in links_of(held, own, rows["side"].slice(s, e - s).to_pylist())]
            ends = numbers[np.array(found, np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, k]) for k in (0, 1)], names=["a", "b"])

    labelled = sets.select("no", "n", "hashes", F.col("no").alias("comp")) if comps is None else sets.select("no", "n", "hashes").join(comps, "no").select("no", "n", "hashes", "comp")
    homes = labelled.mapInArrow(homed, "no long, n long, hashes binary, comp long, homes array<long>")
    each = homes.select("no", "n", "hashes", "comp", F.posexplode("homes").alias("turn", "home"))
    dealt = _dealt(each, ["turn", "home"], across=comps is not None).select("turn", "home", "one", "other", "no", "comp", "side", "hashes")
    ordered = dealt.repartition("turn", "home", "one", "other").sortWithinPartitions("turn", "home", "one", "other", "no")
    return ordered.mapInArrow(run, "a long, b long")


def rare_keys(sets: DataFrame) -> DataFrame:
    """(key, no, n): of each set's shingles that other sets have too, all but the ceil(0.8 n) - 1 most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists([np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()], pa.int64())], names=["no", "n", "keys"])

    each = sets.select("no", F.col("n").cast("int").alias("n"), "hashes").mapInArrow(run, "no long, n int, keys array<long>").select(F.explode("keys").alias("key"), "no", "n")
    shared = each.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("sets > 1")
    place = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("sets"), "key"))
    return shared.withColumn("place", place).filter(100 * F.col("place") >= THRESHOLD * F.col("n")).select("key", "no", "n")


def open_pairs(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): members of different components that share a key of met and could link, but met at no home; each two once."""

    def homed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes = [homes_of(np.frombuffer(x, np.uint64), HOMES + 1)[1:] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(homes, pa.int64())], names=["no", "homes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _groups(batches, 3):
            numbers, sizes, comps, sides = (rows[c].to_numpy() for c in ("no", "n", "comp", "side"))
            homes = np.asarray(rows["homes"].combine_chunks().flatten()).reshape(len(rows), -1)
            found = set()
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if e - s < 2 or (comps[s:e] == comps[s]).all():
                    continue
                last = np.searchsorted(sizes[s:e] * THRESHOLD, 100 * sizes[s:e], side="right") + s  # members are ordered by size
                for i in range(s, e - 1):
                    others = slice(i + 1, last[i - s])
                    could = (comps[others] != comps[i]) & ((sides[others] != sides[i]) | (sides[i] < 0)) & ~(homes[others] == homes[i]).any(axis=1)
                    found.update((min(x, y), max(x, y)) for x in (int(numbers[i]),) for y in numbers[others][could].tolist())
            ends = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, k]) for k in (0, 1)], names=["a", "b"])

    here = _picked(sets, checkpointed(met.select("no").distinct())).select("no", "hashes").mapInArrow(homed, "no long, homes array<long>")
    dealt = _dealt(met, ["key"], across=True).join(here, "no")
    ordered = dealt.select("key", "one", "other", "no", "comp", "side", "n", "homes").repartition("key", "one", "other").sortWithinPartitions("key", "one", "other", "n", "no")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs that link."""
    ends = checkpointed(pairs.select(F.col("a").alias("no")).union(pairs.select(F.col("b").alias("no"))).distinct())
    picked = _picked(sets, ends)
    of = lambda name: picked.select(F.col("no").alias(name), F.col("hashes").alias(f"{name}_hashes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [[np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3)]
            keep = [linked(overlap_of(x, y), len(x), len(y)) for x, y in zip(*held, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_hashes", "b_hashes").mapInArrow(run, "a long, b long")


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """(no, comp) after components have been joined by links (a, b) between sets: smallest labels, doubling their reach."""
    ends = links.join(comps.select(F.col("no").alias("a"), F.col("comp").alias("x")), "a").join(comps.select(F.col("no").alias("b"), F.col("comp").alias("y")), "b")
    both = checkpointed(ends.select("x", "y").filter("x <> y").unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y")).filter("x <> y")).distinct())
    n = both.count()
    if not n:
        return comps
    labels = _labels_in_one_task(both) if n <= 2 * JOINED else _labels_in_rounds(both)
    renamed = comps.join(labels.select(F.col("node").alias("comp"), "label"), "comp", "left")
    return checkpointed(renamed.select("no", F.coalesce("label", "comp").alias("comp")))


def _labels_in_one_task(both: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links (x, y) lead to, of at most 2 JOINED rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for batch in batches:
            for x, y in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                for z in (x, y):
                    parent.setdefault(z, z)
                x, y = _find(parent, x), _find(parent, y)
                parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([_find(parent, x) for x in nodes], pa.int64())], names=["node", "label"])

    return both.select("x", "y").repartition(1).mapInArrow(run, "node long, label long")


def _labels_in_rounds(both: DataFrame) -> DataFrame:
    """(node, label) as above, by smallest labels that double their reach each round."""
    labels = checkpointed(both.select(F.col("x").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").select(F.col("x").alias("node"), "label")
        low = labels.unionByName(near).groupBy("node").agg(F.min("label").alias("label"))
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = checkpointed(low.join(jump, "label").select("node", F.col("further").alias("label")))
        if new.join(labels, ["node", "label"], "left_anti").isEmpty():
            return new
        labels = new


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id_col, n_shingles, component_id) for every text; component_id is the smallest id that links lead to."""
    texts = batched(id_and_text(df, id_col, text_col))
    table = filter_table(with_partners(prefixes(texts, size)))
    each = checkpointed(classified(texts, size, table, id_type(df, id_col)))
    sets = numbered(each)
    comps = joined(sets.select("no", F.col("no").alias("comp")), checkpointed(links_at_homes(sets, None, range(1))))
    keys = checkpointed(rare_keys(sets))
    still = checkpointed(_apart(keys, comps).select("no").distinct())
    comps = joined(comps, checkpointed(links_at_homes(_picked(sets, still), comps, range(1, HOMES + 1))))
    pairs = checkpointed(open_pairs(checkpointed(_apart(keys, comps)), sets))
    comps = joined(comps, checkpointed(_verified(pairs, sets)))
    return _named(each, sets, comps).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _named(each: DataFrame, sets: DataFrame, comps: DataFrame) -> DataFrame:
    """(id, n_shingles, component_id): the smallest id of each text's class or, for classes in comps, of its component."""
    classes = each.filter("cls is not null").groupBy("cls", "rest").agg(F.min("id").alias("first"))
    known = sets.select("cls", "rest", "no").join(comps, "no").join(classes, ["cls", "rest"])
    least = known.join(known.groupBy("comp").agg(F.min("first").alias("least")), "comp").select("cls", "rest", "least")
    named = classes.join(least, ["cls", "rest"], "left").select("cls", "rest", F.coalesce("least", "first").alias("component_id"))
    return each.select("id", "cls", "rest", F.col("n").alias("n_shingles")).join(named, ["cls", "rest"], "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """The rows of df but for those that link, directly or not, to a row with a smaller id; rows of one id stay together.

    Only the ids that go are joined to the rows.
    """
    name = unused(df, "gone")
    gone = components(df, id_col, text_col, size).filter(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias(name)).distinct()
    return df.join(gone, df[id_col] == F.col(name), "left_anti")
