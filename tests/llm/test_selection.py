"""Operators 11 to 13 against plain versions on small fixtures."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from halyard.llm import blocks, collocations, importance, mixing

SCHEMA = "doc_id long, text string, lang string, source string, phrase string, n string, word string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """(doc_id, text, lang, source), with columns that the operators use themselves."""
    return spark.createDataFrame([(*r, "p", "n", "w") for r in rows], SCHEMA).repartition(3)


def corpus(seed, n=120):
    r = random.Random(seed)
    words = "the cat sat on a mat And THEN it ran, over. the; hill É été x1 new york new york city\t  a.b".split(" ")
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 19, 20, 21, 60, 200]))) + r.choice(["", "\n", " ", "."]), r.choice(["en", "de", None, ""]), r.choice(["b", "a", None, "ä", "Z"])) for i in range(n)]
    return [*rows, (n, None, None, None), (n + 1, "", "en", "a"), (5, rows[5][1], "en", "a"), (5, rows[5][1], "en", "a"), (None, rows[7][1], "de", "b"), (n + 2, "the cat " * 9000, "en", "b")]


# -- 11


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, [" ".join(w[i : i + k]) for k in (1, 2) for i in range(len(w) - k + 1)]


def plain_weights(rows, target):
    s, t = (Counter(crc32(f.encode()) % 10000 for text in texts for f in features(text)[1]) for texts in ([r[1] for r in rows], target))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (m * 0 + n + 10000) / ((s[b] + 1) * (m + 10000))))
    out = []
    for r in rows:
        w, f = features(r[1])
        weight = sum(gain(crc32(x.encode()) % 10000) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append((r[0], len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_resampling(spark, seed):
    rows = corpus(seed)
    target = ["the cat sat on a mat", None, "", "new york, new york " * 30]
    aim = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id int, text string, score string")
    ours = importance.resample(frame(spark, rows), aim).collect()
    plain = plain_weights(rows, target)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in ours) == Counter((i, f, w, s) for i, _, f, w, s in plain)
    able = sorted([(-s, -1 if i is None else i) for i, n, f, w, s in plain if n >= 20])
    drawn = able[: 25 * len(able) // 100]
    got = sorted([(r.rank, -r.score, -1 if r.doc_id is None else r.doc_id) for r in ours if r["rank"] is not None])
    assert got == [(k + 1, s, i) for k, (s, i) in enumerate(drawn)]


def test_resampling_of_empty_tables(spark):
    empty, aim = frame(spark, []), spark.createDataFrame([], "item_id int, text string")
    assert importance.resample(empty, aim).count() == 0
    rows = importance.resample(frame(spark, [(1, "a b " * 20, None, None), (2, None, None, None)]), aim).collect()
    assert {(r.doc_id, r["rank"]) for r in rows} == {(1, None), (2, None)}  # a quarter of one row, floored


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), min_size=1, max_size=6), st.integers(1, 4))
def test_suffix_arrays_hash_each_run_once(texts, n):
    block = next(blocks.blocks_of(enumerate(texts), 10**9))
    flat = [(k, i) for k, t in enumerate(texts) for i in range(len(t))]
    order, lcp, length = importance.suffix_array(block, n)
    suffix = [texts[k][i : i + n] for k, i in flat]
    ordered = [suffix[p] for p in order]
    number = block.number
    assert [[number[w] for w in s] for s in ordered] == sorted([number[w] for w in s] for s in suffix) and [len(s) for s in ordered] == length.tolist()
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert [common(a, b) for a, b in zip(ordered, ordered[1:], strict=False)] == lcp[1:].tolist()
    places, found = importance.buckets_of(block, n, 10000)
    want = Counter((p, crc32(" ".join(texts[k][i : i + m]).encode()) % 10000) for p, (k, i) in enumerate(flat) for m in range(1, n + 1) if i + m <= len(texts[k]))
    assert Counter(zip(places.tolist(), found.tolist(), strict=True)) == want


def test_many_words_are_sorted_by_columns():
    """Keys that don't fit into 64 bits are sorted one column at a time, with the same result."""
    r = random.Random(3)
    block = blocks.Block()
    for k in range(40):
        block.add(k, [str(r.randrange(300)) for _ in range(200)])
    order, lcp, _ = importance.suffix_array(block, 8)
    ids, ends = block.ids.tolist(), np.repeat(block.start[1:], np.diff(block.start)).tolist()
    suffix = [ids[p : min(ends[p], p + 8)] for p in range(len(ids))]
    assert [suffix[p] for p in order] == sorted(suffix) and 8 * (len(block.number) + 1).bit_length() >= 63


# -- 12


def plain_collocations(rows, least, covered=50, top=2000):
    f = defaultdict(Counter)
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            for m in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, n in f.items():
        words = sum(c for p, c in n.items() if len(p) == 1)
        held = lambda p: any(c >= least and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * c >= covered * n[p] for q, c in n.items())  # noqa: B023, E731
        rows = []
        for p, a in n.items():
            if len(p) > 1 and a >= least and not held(p):
                score, _, l, r = min((1_000_000 * a * a // (n[p[:k]] * n[p[k:]]), k, n[p[:k]], n[p[k:]]) for k in range(1, len(p)))
                rows.append((score, a, " ".join(p), l, r))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, k + 1, p, a, l, r, words, score) for k, (score, a, p, l, r) in enumerate(rows[:top])]
    return sorted(out)


@pytest.mark.parametrize(("seed", "shard", "group", "filter_bits"), [(1, 1 << 20, 1 << 17, 1 << 26), (2, 300, 7, 1 << 20), (3, 50, 1, 1 << 15)])
def test_collocations(spark, seed, shard, group, filter_bits, monkeypatch):
    """Shards and groups of any size, and a filter so full that it errs, change nothing."""
    rows = corpus(seed)
    if seed == 3:
        monkeypatch.setattr(collocations, "_table", lambda frequent, bits: np.full(bits // 8, 255, np.uint8))
    ours = sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), shard_words=shard, group=group, filter_bits=filter_bits).collect())
    assert ours == plain_collocations(rows, 10) and ours


def test_collocations_by_salts(spark, monkeypatch):
    rows = corpus(4, 200)
    ours = sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), least=3, top=5).collect())
    assert ours == plain_collocations(rows, 3, top=5)


def test_collocations_of_little(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None, None), (2, "", "en", None)])).count() == 0
    bare = frame(spark, [(1, "a b. " * 12, "en", None)]).drop("lang")
    assert [tuple(r) for r in collocations.collocations(bare).collect()] == [("und", 1, "a b", 12, 12, 12, 24, 1_000_000)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab."), max_size=60), st.integers(1, 5))
def test_bitmaps_count_phrases(tokens, n):
    shard = collocations.Shard("x")
    shard.add(" ".join(tokens))
    full = [np.full(collocations.FILTER // 8, 255, np.uint8)] * (n - 1)
    ours = Counter()
    for phrases, counts in collocations.phrase_counts(shard, n, full):
        ours.update(dict(zip(phrases, counts.tolist(), strict=True)))
    pieces = "".join(tokens).split(".")
    assert +ours == Counter(" ".join(p[i : i + n]) for p in pieces for i in range(len(p) - n + 1))


def test_filter_has_what_is_frequent(spark):
    words = spark.range(3000).select(F.lit("é").alias("lang"), F.concat(F.lit("w "), "id").alias("phrase"))
    table = collocations._table(words)
    hashes = np.array([crc32(f"é\0w {k}".encode()) for k in range(3000)])
    assert collocations._may(table, hashes).all() and np.unpackbits(table).sum() <= 3000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("aBzÉ.;:!?,\n\x0b\x0c\r\t \0\xa0\u0130", max_size=30), max_size=5))
def test_shards_read_words_of_bytes(texts):
    shard = collocations.Shard("x")
    for text in texts:
        shard.add(text)
    words, ids = shard.numbered()
    tokens = [t for text in texts for t in (*re.findall(r"[.,;:!?\n-\r]|[^ \t.,;:!?\n-\r]+", text.translate(LOWER)), ".")]
    assert [-1 if k < 0 else words[k].as_py() for k in ids.tolist()] == [-1 if t in ".,;:!?\n\x0b\x0c\r" else t for t in tokens]
    assert len(set(words.to_pylist())) == len(words) and (ids >= 0).sum() <= shard.size


@given(st.lists(st.binary(max_size=70), min_size=1, max_size=8), st.lists(st.binary(max_size=9), min_size=1, max_size=8))
def test_endings_hash_as_whole_phrases(words, begun):
    before = np.repeat([crc32(b) for b in begun], len(words))
    after = collocations.Endings(words).after(before, np.tile(np.arange(len(words)), len(begun)))
    assert after.tolist() == [crc32(b + b" " + w) for b in begun for w in words]


def test_words_are_read_at_less_than_a_search_costs():
    """A shard's words are told and numbered at less than what an expression alone takes to find them."""
    r = random.Random(7)
    texts = [" ".join(f"w{int(r.expovariate(1 / 3000))}" for _ in range(500)) + "." for _ in range(400)]

    def ours():
        shard = collocations.Shard("x")
        for text in texts:
            shard.add(text)
        return sum(int(counts.sum()) for _, counts in collocations.phrase_counts(shard, 1, []))

    def plain():
        return sum(len(re.findall(r"[.,;:!?\n-\r]|[^ \t.,;:!?\n-\r]+", text.lower())) - 1 for text in texts)

    def seconds(f):
        began = time.process_time()
        assert f() == 200_000
        return time.process_time() - began

    assert min(seconds(ours) for _ in range(5)) < min(seconds(plain) for _ in range(5))


# -- 13


def plain_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    stopped = set()
    while True:
        left, free = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped), sum(weight[s] for s in order if s not in stopped)
        more = {s for s in order if s not in stopped and 3 * sizes[s] < Fraction(left * weight[s], free)}
        if not more:
            return sizes, {s: 3.0 * sizes[s] if s in stopped else left * weight[s] / free for s in order}
        stopped |= more


@pytest.mark.parametrize(("seed", "words"), [(1, 64), (2, 7), (3, 4096)])
def test_mixture(spark, seed, words, monkeypatch):
    monkeypatch.setattr(mixing, "_LISTED", 16)  # of a nested function, so workers see it
    rows = [r for r in corpus(seed) if seed != 3 or r[3] != "Z"]
    mixed = mixing.mixture(frame(spark, rows), slot_words=words).collect()
    sizes, target = plain_mix(rows)
    assert {(r.source, r.source_size, r.target) for r in mixed} == {(s, sizes[s], target[s]) for s in sizes}
    used, by_doc, places = Counter(), defaultdict(int), Counter()
    for r in mixed:
        used[r.source] += r.n_words
        by_doc[r.source, r.bucket, r.row] += r.n_words
        places.update((r.source, r.bucket, r.row, w, r.epoch) for w in range(r.first_word, r.first_word + r.n_words) if r.slot is not None)
    assert {s: used[s] for s in sizes} == {s: math.floor(t) for s, t in target.items()}
    assert places.total() == sum(used.values()) and set(places.values()) == {1}  # a word once an epoch
    size = {(r.source, r.bucket, r.row): r.size for r in mixed}
    assert len(size) == len(rows) and all(n <= 3 * size[k] for k, n in by_doc.items())
    by_slot = Counter()
    for r in mixed:
        if r.slot is not None:
            by_slot[r.source, r.slot, r.epoch, r.block] += r.n_words
    assert max(by_slot.values()) <= words
    again = mixing.mixture(frame(spark, rows).repartition(5), slot_words=words)
    counted = lambda m: Counter(tuple(r) for r in m.select("slot", "source", "epoch", "block", "id", "size", "first_word", "n_words").collect())
    assert counted(again) == Counter(tuple(r[c] for c in ("slot", "source", "epoch", "block", "id", "size", "first_word", "n_words")) for r in mixed)


def test_every_stretch_of_the_schedule_has_the_shares(spark):
    rows = [(i, "w " * 500, "en", "abcdef"[i % 6]) for i in range(600)]
    docs = frame(spark, rows)
    plan = mixing.schedule(mixing.targets(mixing.sized(docs)), 64)
    slots = sorted((r.slot, r.source) for r in plan.collect())
    target = {r.source: r.target for r in mixing.targets(mixing.sized(docs)).collect()}
    for k in range(0, len(slots) - 512, 512):
        seen = Counter(s for _, s in slots[k : k + 512])
        assert all(abs(seen[s] - 512 * t / sum(target.values())) < 8 for s, t in target.items())


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 9), st.data())
def test_ranks_are_counted_from_bits(bits, data):
    slots = 1 << bits
    limit = data.draw(st.integers(0, slots))
    numbers = mixing._reversed(np.arange(slots), bits)
    assert sorted(numbers.tolist()) == list(range(slots))
    below = np.concatenate([[0], np.cumsum(numbers < limit)])
    assert mixing.rank_below(np.arange(slots), limit, bits).tolist() == below[:-1].tolist()


def test_mixtures_of_little(spark):
    assert mixing.taken(mixing.mixture(frame(spark, []))).count() == 0
    rows = mixing.taken(mixing.mixture(frame(spark, [(1, None, None, None), (1, None, None, None), (2, " ", None, "a")]))).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    one = mixing.taken(mixing.mixture(frame(spark, [(1, "a b c", None, "a"), (2, "d", None, "a")]).drop("source"))).collect()
    assert sorted(tuple(r) for r in one) == [(1, 3, 4, 4.0, 3), (2, 1, 4, 4.0, 1)]
