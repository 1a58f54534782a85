"""Operators 2, 3, 7 and 8 against the libraries and plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken

from halyard.llm import bpe, packing, quality, token_counts, vocabularies

DOCS = "doc_id long, text string, lang string, source string, n_tokens string"
SPACED = ["", " ", "  ", "a  b", " a", "a ", "\n\n x", "tab\tand more", "x\x1cy", "▁ mark", "it's 'll we're  done ", "中文 привет \U0001f44d", "<|endoftext|> in text", "a" * 300, "ab" * 700]


def texts(n=400, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijéß.,!") for _ in range(r.randint(1, 9))) for _ in range(300)]
    return SPACED + [r.choice((" ", " ", "\n", "  ")).join(r.choice(words) for _ in range(r.randint(0, 120))) for _ in range(n)]


def documents(spark, more=()):
    rows = [(i, t, "en", "s", "clash") for i, t in enumerate(texts(60))]
    rows += [(1000, None, None, None, None), (1001, "same text", "en", "s", ""), (1001, "same text", "en", "s", ""), (None, "no id", "en", "s", ""), *more]
    return spark.createDataFrame(rows, DOCS)


def library():
    return tiktoken.Encoding("own", pat_str=vocabularies.pattern(), mergeable_ranks=vocabularies.ranks(vocabularies.BYTE_BPE_RANKS), special_tokens={})


def test_matrices_merge_as_the_library():
    coder, lib = bpe.encoder(vocabularies.BYTE_BPE_RANKS), library()
    r = random.Random(5)
    odd = texts() + ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 600))) for _ in range(100)]
    coded = coder.encode(odd)
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [lib.encode_ordinary(t) for t in odd]
    assert [coder.decode(c) for c in coded] == [t.encode() for t in odd]


def test_row_and_matrix_agree():
    coder = bpe.encoder(vocabularies.BYTE_BPE_RANKS)
    r = random.Random(6)
    for alphabet in (b"abcdeXY \xc3\xa9", b"ab", b"a", b"the cat"):
        for _ in range(60):
            token = bytes(r.choice(alphabet) for _ in range(r.randint(2, 200)))
            assert coder._by_row(token) == coder._by_matrix([token], 256)[0]


@pytest.mark.parametrize("unit", ["a", "of", "abcabd", "0", "é", "=-", "xyzzy9Q", None])
def test_long_rows_are_what_the_library_gives(unit):
    """Pre-tokens of 50,000 characters, periodic ones and one without a period."""
    r = random.Random(7)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000)) if unit is None else unit * (50_000 // len(unit))
    assert bpe.encoder(vocabularies.BYTE_BPE_RANKS).encode([text])[0] == np.array(library().encode_ordinary(text), "<u4").tobytes()


def test_kept_pretokens_stay_bounded():
    from halyard.llm.pretokens import Kept

    kept = Kept(lambda pieces: [len(p) for p in pieces], kept=10)
    kept.load({str(i) for i in range(8)})
    kept.load({str(i) for i in range(6, 12)})
    assert kept["11"] == 2 and len(kept) <= 10


def test_round_trip_query(spark):
    rows = bpe.round_trip(documents(spark)).collect()
    lib = library()
    plain = Counter((i, len(ids := lib.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in documents(spark).collect())
    assert Counter(tuple(r) for r in rows) == plain
    coded = bpe.encode(documents(spark))
    assert {bytes(r.bytes) for r in bpe.decode(coded).collect()} == {(r.text or "").encode() for r in documents(spark).collect()}
    assert bpe.round_trip(documents(spark).limit(0)).count() == 0


def test_token_counts(spark):
    pieces = vocabularies.pieces_model(vocabularies.PIECE_BPE)
    got = Counter(tuple(r) for r in token_counts.count_tokens(documents(spark), limit=50).collect())
    want = Counter((i, len((t or "").encode()), n := len(pieces.encode(t or "", num_threads=1)), n > 50) for i, t, *_ in documents(spark).collect())
    assert got == want
    assert token_counts.count_tokens(documents(spark).limit(0)).count() == 0


def test_frequent_pretokens_are_those_counted(spark):
    df = spark.createDataFrame([("the cat the dog",)] * 50 + [("the end",)], "text string")
    top = token_counts.frequent_pretokens(df).collect()
    assert (top[0].piece, top[0].n) == ("the", 101) and "end" not in {r.piece for r in top}


def plain_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_base(spark):
    base = [(2000, "w x y " * 40, "en", "s", ""), (2001, "a b c d\n a b c d\n\n#1 *", "en", "s", "")]
    got = {(r.doc_id, r.n_words): tuple(r)[1:6] + (r.base_failed,) for r in quality.judge(documents(spark, base)).collect()}
    for i, t, *_ in documents(spark, base).collect():
        want = plain_base(t or "")
        assert got[i, want[0]] == (*want, want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_quality_measures():
    text = "Some words, some tokens 中文\U0001f980."
    row = dict(zip([n for n, _ in quality._FIELDS], quality.meter(vocabularies.PIECE_BPE, vocabularies.BYTE_BPE_RANKS)([text])[0], strict=True))
    pieces = vocabularies.pieces_model(vocabularies.PIECE_BPE)
    ids = pieces.encode(text)
    counts = np.array(list(Counter(ids).values())) / len(ids)
    assert row["n_tokens"] == len(ids) and row["chars_per_token"] == round(len(text) / len(ids), 3)
    assert row["fallback_share"] == round(sum(pieces.is_byte(i) for i in ids) / len(ids), 4) and row["token_entropy"] == round(-(counts * np.log2(counts)).sum(), 3)
    assert row["chars_per_byte_token"] == round(len(text) / len(library().encode_ordinary(text)), 3)
    assert [quality.script_of(t) for t in ("abc", "123", "при a", "中文")] == ["Latin", "Common", "Cyrillic", "Han"]


def test_quality_rejects_what_lies_outside_its_language(spark):
    r = random.Random(1)
    good = [(i, " ".join(r.choice("the of and to in that it was for on with as his they be at one have this".split()) for _ in range(90)), "en", "s", "") for i in range(150)]
    odd = (900, " ".join("".join(r.choice("ƀɃʉɍɇ") for _ in range(6)) for _ in range(60)), "en", "s", "")
    df = spark.createDataFrame([*good, odd], DOCS)
    kept = {x.doc_id: x.kept for x in quality.judge(df).collect()}
    assert not kept[900] and sum(kept[i] or False for i in range(150)) >= 145
    out = quality.filtered(df)
    assert out.columns == df.columns and out.filter("doc_id = 900").count() == 0 and out.count() == sum(kept.values())
    assert quality.judge(df.limit(0)).count() == 0 and quality.filtered(df.limit(0)).count() == 0


def measures_of(spark, rows):
    """Rows (lang, source, n_tokens, characters per token) as measures that pass the base."""
    kinds = ", ".join(f"{name} {kind}" for name, kind in quality._FIELDS)
    full = [(k, lang, source, 300, 1500, 0, 0, 0, n, c, c, 0.01, 6.5 + k % 7 / 1000, "Latin") for k, (lang, source, n, c) in enumerate(rows)]
    return spark.createDataFrame(full, f"id long, lang string, source string, {kinds}")


def kept_of(spark, rows):
    return [r.kept for r in quality.verdicts(measures_of(spark, rows)).orderBy("id").collect()]


@pytest.mark.parametrize("source", [None, "junk"])
def test_a_band_does_not_follow_junk(spark, source):
    """A third of a class, spread over the sources, or a source that is more than half of it."""
    r = random.Random(2)
    good = [("en", f"s{k % 5}", 600, r.gauss(2.63, 0.05)) for k in range(400)]
    junk = [("en", source or f"s{k % 5}", 600, 1.9 + r.random() / 10) for k in range(200 if source is None else 600)]
    kept = kept_of(spark, good + junk)
    assert sum(kept[:400]) >= 390 and not any(kept[400:])


def test_limits_hold_where_all_is_junk(spark):
    r = random.Random(2)
    assert not any(kept_of(spark, [("en", "s", 600, 1.5 + r.random() / 10) for _ in range(300)]))


def test_every_text_has_a_band(spark):
    """Classes with too few texts are judged by their neighbours, then by all lengths, then by the script, then by fixed limits."""
    r = random.Random(3)
    good = [("en", "s", 600, r.gauss(2.63, 0.05)) for _ in range(150)]
    odd = [("en", "s", 1100, 2.0), ("en", "s", 300, 2.0), ("en", "s", 20_000, 2.0), ("xx", "s", 20_000, 2.0), (None, "s", 600, 2.0)]
    fine = [(lang, source, n, 2.63) for lang, source, n, _ in odd]
    kept = kept_of(spark, good + odd + fine)
    assert kept[150:155] == [False] * 5 and kept[155:] == [True] * 5
    assert kept_of(spark, [("en", "s", 600, 1.2), ("en", "s", 600, 2.6), ("xx", "s", 600, 0.5), ("xx", "s", 600, 2.0)]) == [False, True, False, True]


def plain_squares(lengths, capacity):
    """The sum of squares worked out in full for every choice."""
    gaps, total = [], 0
    counts = Counter()
    cost = lambda c: sum(n * n for g, n in c.items() if 0 < g < capacity)
    for s in sorted(lengths, reverse=True):
        choices = []
        for g in sorted({*counts, capacity}):
            if g >= s and (g == capacity or counts[g] > 0):
                new = Counter(counts)
                if g < capacity:
                    new[g] -= 1
                new[g - s] += 1
                choices.append((cost(new), g == capacity, g))
        _, _, g = min(choices)
        if g < capacity:
            counts[g] -= 1
            gaps.remove(g)
        counts[g - s] += 1
        gaps.append(g - s)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_sum_of_squares_is_the_least(seed):
    r = random.Random(seed)
    lengths = np.array([r.randint(1, 20) for _ in range(120)])
    bins, offsets, gaps = packing.sum_of_squares(lengths, 20)
    assert sorted(gaps.tolist()) == plain_squares(lengths.tolist(), 20)
    for b in range(len(gaps)):
        own = sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist(), strict=True))
        assert [o for o, _ in own] == list(np.cumsum([0, *[n for _, n in own]])[:-1]) and sum(n for _, n in own) + gaps[b] == 20


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_documents(spark):
    df = documents(spark, [(3000, "word " * 5000, "en", "s", "")])
    rows = packing.pack_documents(df, capacity=256).collect()
    n = check_packed(rows, 256)
    assert n <= 1.1 * sum(r.length for r in rows) / 256 + 1
    coder = vocabularies.byte_level(vocabularies.BYTE_BPE)
    want = Counter()
    for i, t, *_ in df.collect():
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_packing_in_two_rounds(spark):
    r = random.Random(2)
    items = spark.createDataFrame([(i, 0, 0, r.randint(1, 100), i) for i in range(2000)], "id long, piece int, start long, length long, ids_crc32 long")
    one, two = packing.pack(items, 100).collect(), packing.pack(items, 100, shard=150, fan=4).collect()
    assert len(one) == len(two) == 2000 and check_packed(two, 100) <= 1.05 * check_packed(one, 100)


def test_ranks_and_tokenizer_are_one_vocabulary():
    """Every token that is one pre-token of valid text is given back by the tokenizer's merges, as the ranks give it."""
    import regex

    coder, find = vocabularies.byte_level(vocabularies.BYTE_BPE), regex.compile(vocabularies.pattern())
    tokens = [(t.decode(), i) for t, i in vocabularies.ranks(vocabularies.BYTE_BPE_RANKS).items() if t.decode("utf-8", "ignore").encode() == t]
    tokens = [(t, i) for t, i in tokens if find.fullmatch(t) and find.findall(t) == [t]]
    assert len(tokens) > 45_000
    coded = coder.encode_batch([t for t, _ in tokens], add_special_tokens=False)
    assert all(e.ids == [i] for e, (_, i) in zip(coded, tokens, strict=True))


def test_a_worker_keeps_one_stage_at_a_time():
    """What one stage keeps in a worker goes when the next one begins."""
    meter = quality.meter(vocabularies.PIECE_BPE, vocabularies.BYTE_BPE_RANKS)
    assert quality.meter(vocabularies.PIECE_BPE, vocabularies.BYTE_BPE_RANKS) is meter and list(vocabularies._HELD.values()) == [meter]
    ids = packing.document_ids(vocabularies.BYTE_BPE)
    assert list(vocabularies._HELD.values()) == [ids] and ids.spaced.kept <= 100_000
