"""Operator 10: line dedup by content-defined chunks, with DataFrame functions only.

A text is cut into lines, each line is hashed, and a rolling hash runs over the hashes of two lines in a row. A chunk
begins where the rolling hash is a local minimum, so a boundary depends on four lines only and moves with them; every
chunk of a text with two lines or more has at least two. Chunks found at several places of the table with two
lines or more that aren't blank are removed everywhere but at the first place (smallest id, then position), after
their bytes have been compared with those at the first place.

Shuffled are the digests of all chunks (summed up before), the chunks once, and the rows once to receive the positions.
A frequent chunk makes a large group only in joins, which split it; nothing is gathered by chunk.

Cases: a null text counts as empty and has no chunk to remove; rows equal in id and text count as one place and are
treated alike; ties are broken by position; a null id comes before all others; a text whose chunks all go becomes
empty; texts may have any length; an empty table gives an empty result; other columns of the input stay or are ignored,
whatever their names.

Two neighbours of a repeated passage decide where its first and last chunk end, so chunks miss short passages and the
ends of long ones. without_passages() removes the repeated chunks and then looks at the windows of two lines that aren't
blank (with the blank ones between them) that no removed chunk holds whole: so a passage of two lines or more that stands
anywhere before is removed from its first line to its last, whatever stands around it. Every removed line that isn't blank
stays at an earlier place; a window that overlaps its own first place loses its second line only. Where a window stands
first, no chunk goes, as both go by one order of places; so what the chunks took need not be looked at again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import unused

#: The rolling hash: digits of a line's digest, the weight of the line before, the modulus (all below 2**62 together).
HEX_DIGITS, WEIGHT, MODULUS = 15, 3, (1 << 60) - 93
#: Orders of places: rows of one id by position, or one after the other, as chunks and windows need it to agree.
IN_ORDER, BY_ROW = ("id", "at", "mark"), ("id", "mark", "at")
#: Two lines that aren't blank; anchored, so that a text is read once.
TWO_LINES = r"\A[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r][^\n]*\n[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, HEX_DIGITS), 16, 10).cast("long")


def chunks(text: Column) -> Column:
    """The chunks of a text, which joined by line ends give the text."""

    def of_lines(lines: Column) -> Column:
        n = F.size(lines)

        def of_hashes(h: Column) -> Column:
            rolling = F.transform(h, lambda x, i: F.pmod(F.coalesce(F.get(h, i - 1), F.lit(0).cast("long")) * WEIGHT + x, F.lit(MODULUS)))

            def of_rolling(r: Column) -> Column:
                minimum = lambda i: (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) <= F.get(r, i + 1))
                within = F.when(n >= 4, F.sequence(F.lit(2), F.greatest(n - 2, F.lit(2)))).otherwise(F.array().cast("array<int>"))
                return let(F.filter(within, minimum), lambda b: F.zip_with(F.concat(F.array(F.lit(0)), b), F.concat(b, F.array(n)), lambda s, e: F.array_join(F.slice(lines, s + 1, e - s), "\n")))

            return let(rolling, of_rolling)

        return let(F.transform(lines, line_hash), of_hashes)

    return let(F.split(text, "\n", -1), of_lines)


def _line_places(lines: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda p: F.get(lines, p).rlike(r"[^ \t\n\x0B\f\r]"))


def _pairs(places: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body of each of the places and the one after it."""
    n = F.greatest(F.size(places) - 1, F.lit(0))
    return F.zip_with(F.slice(places, 1, n), F.slice(places, 2, n), body)


def windows(text: Column) -> Column:
    """The windows of two lines that aren't blank, each with the blank lines between the two."""
    return let(F.split(text, "\n", -1), lambda lines: let(_line_places(lines), lambda places: _pairs(places, lambda s, e: F.array_join(F.slice(lines, s + 1, e - s + 1), "\n"))))


def _based(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text, null, mark): all other columns as a struct, the id, the text, never null, whether it was null, a hash of it.

    What follows adds columns beside these, so those of df may have any name.
    """
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    others = F.struct(*[df[c] for c in df.columns if c != text_col])
    return df.select(others.alias("row"), df[id_col].alias("id"), text.alias("text"), df[text_col].isNull().alias("null"), F.xxhash64(text).alias("mark"))


def _unpacked(df: DataFrame, text_col: str, text: Column) -> list[Column]:
    """df's columns from the struct `row`, with a text of its own."""
    return [(text if c == text_col else F.col("row")[c]).alias(c) for c in df.columns]


def _owners(text: Column, gone: Column) -> Column:
    """For each line of a text the number of its chunk if that is one of gone, else -1."""
    n_lines = lambda c: F.size(F.split(c, "\n", -1))
    return F.flatten(F.transform(chunks(text), lambda c, i: F.array_repeat(F.when(F.array_contains(gone, i), i).otherwise(-1), n_lines(c))))


def _open_windows(found: Column, text: Column, gone: Column) -> Column:
    """Those of the windows found (by their `at`) that no chunk of gone, which may be null, holds whole."""

    def of_places(places: Column) -> Column:
        def of_owners(owners: Column) -> Column:
            first, last = (lambda x, k=k: F.get(owners, F.get(places, x["at"] + k)) for k in (0, 1))
            return F.filter(found, lambda x: (first(x) < 0) | (first(x) != last(x)))

        return let(_owners(text, gone), of_owners)

    return F.when(gone.isNull(), found).otherwise(let(F.split(text, "\n", -1), lambda lines: let(_line_places(lines), of_places)))


def repeated_chunks(based: DataFrame, pieces: Callable[[Column], Column] = chunks, digest: Callable[[str], Column] = F.md5, order: tuple[str, ...] = IN_ORDER) -> DataFrame:
    """(own_id, own_mark, chunks): for each text with chunks that the table repeats, their (at, digest, whether it is the first place).

    pieces: what a text is cut into, chunks or windows; digest: of a piece, whose bytes are compared afterwards; order: of places.
    """
    places = (
        based.select("id", "text", "mark")
        .filter(F.col("text").rlike(TWO_LINES))
        .select("id", "mark", F.posexplode(pieces(F.col("text"))).alias("at", "chunk"))
        .filter(F.col("chunk").rlike(TWO_LINES))
        .select("id", "mark", "at", digest("chunk").alias("digest"))
    )
    place = F.struct(*order)
    firsts = places.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last"))).select("digest", "first")
    again = places.join(firsts, "digest").withColumn("leads", F.col("first").eqNullSafe(place))
    return again.groupBy(F.col("id").alias("own_id"), F.col("mark").alias("own_mark")).agg(F.collect_set(F.struct("at", "digest", "leads")).alias("chunks"))


def _same_row() -> Column:
    return F.col("id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark"))


def _later(based: DataFrame, pieces: Callable[[Column], Column], digest: Callable[[str], Column], order: tuple[str, ...] = IN_ORDER, gone: DataFrame | None = None) -> DataFrame:
    """(own_id, own_mark, at, overlaps): the places of chunks that go, after the comparison of bytes; overlaps: with the first place, which is one before.

    gone: what _gone() gives if pieces are windows; those that a chunk there holds whole are left out.

    The rows are joined to what repeats in them as they are joined to the result afterwards, so that the two joins read
    one exchange; the fingerprint of the whole row keeps its columns the same in both.
    """
    rows = (based if gone is None else _with_gone(based, gone)).join(repeated_chunks(based, pieces, digest, order), _same_row())
    found = F.col("chunks") if gone is None else _open_windows(F.col("chunks"), F.col("text"), F.col("gone"))
    texts = let(pieces(F.col("text")), lambda c: F.transform(found, lambda x: F.struct(x["at"].alias("at"), x["digest"].alias("digest"), x["leads"].alias("leads"), F.get(c, x["at"]).alias("bytes"))))
    row = F.xxhash64(*[F.col(c) for c in based.columns])
    each = rows.select("own_id", "own_mark", row.alias("whole"), F.explode(texts).alias("x")).select("own_id", "own_mark", "whole", "x.*")
    leaders = each.filter("leads").groupBy("digest").agg(F.min("bytes").alias("first_bytes"), F.min("whole").alias("first_row"), F.min("at").alias("first_at"))
    elsewhere = (F.col("whole") != F.col("first_row")) | (F.col("at") != F.col("first_at"))
    later = each.filter("not leads").join(leaders, "digest").filter(elsewhere & (F.col("bytes").cast("binary") == F.col("first_bytes").cast("binary")))
    return later.withColumn("overlaps", (F.col("whole") == F.col("first_row")) & (F.col("at") == F.col("first_at") + 1))


def removed_places(based: DataFrame, order: tuple[str, ...] = IN_ORDER) -> DataFrame:
    """(own_id, own_mark, removed): for each text that loses chunks, their positions."""
    return _later(based, chunks, F.md5, order).groupBy("own_id", "own_mark").agg(F.collect_set("at").alias("removed"))


def _gone(based: DataFrame) -> DataFrame:
    """(gone_id, gone_mark, gone): for each text that loses chunks by the order of rows, their positions."""
    return removed_places(based, BY_ROW).withColumnsRenamed({"own_id": "gone_id", "own_mark": "gone_mark", "removed": "gone"})


def _with_gone(based: DataFrame, gone: DataFrame) -> DataFrame:
    return based.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left")


def without_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_empty: bool = True) -> DataFrame:
    """df without the passages of two lines or more in text_col that stand at an earlier place (smaller id, then position).

    Repeated chunks go first, then what windows find around them. keep_empty: else a text that loses lines and has only
    blank ones left goes.
    """
    based = _based(df, id_col, text_col)
    gone = _gone(based)
    windowed = _later(based, windows, F.xxhash64, BY_ROW, gone).groupBy("own_id", "own_mark").agg(F.collect_set(F.struct("at", "overlaps")).alias("removed"))
    joined = _with_gone(based, gone).join(windowed, _same_row(), "left")
    changed = F.col("removed").isNotNull() | F.col("gone").isNotNull()

    def rest_of(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)

        def of_places(places: Column) -> Column:
            return F.flatten(F.transform("removed", lambda x: F.sequence(F.get(places, x["at"]) + x["overlaps"].cast("int"), F.get(places, x["at"] + 1))))

        none = F.array().cast("array<int>")
        by_windows = F.when(F.col("removed").isNotNull(), let(_line_places(lines), of_places)).otherwise(none)
        by_chunks = F.when(F.col("gone").isNotNull(), let(_owners(F.col("text"), F.col("gone")), lambda owners: F.filter(every, lambda p: F.get(owners, p) >= 0))).otherwise(none)
        return F.array_join(F.transform(F.array_except(every, F.concat(by_windows, by_chunks)), lambda p: F.get(lines, p)), "\n")

    rest = joined.withColumn("rest", F.when(changed, let(F.split("text", "\n", -1), rest_of)))
    if not keep_empty:
        rest = rest.filter(~changed | F.col("rest").rlike(r"[^ \t\n\x0B\f\r]"))
    return rest.select(*_unpacked(df, text_col, F.when(changed, F.col("rest")).when(~F.col("null"), F.col("text"))))


def deduped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_empty: bool = True) -> DataFrame:
    """df with its repeated chunks removed from text_col, and after df's columns n_lines, n_removed_lines as a struct `line_dedup`.

    keep_empty: else a text of which nothing is left goes. If df has a column of that name, the struct's has marks before it.
    """
    based = _based(df, id_col, text_col)
    joined = based.join(removed_places(based), _same_row(), "left")
    stays = let(chunks(F.col("text")), lambda c: F.filter(c, lambda x, i: ~F.array_contains(F.col("removed"), i)))
    rest = joined.withColumn("stays", F.when(F.col("removed").isNotNull(), stays))
    lines = F.size(F.split("text", "\n", -1))
    n_left = F.aggregate("stays", F.lit(0), lambda n, c: n + F.size(F.split(c, "\n", -1)))
    new_text = F.when(F.col("removed").isNotNull(), F.array_join("stays", "\n")).when(~F.col("null"), F.col("text"))
    counts = F.struct(lines.cast("long").alias("n_lines"), F.when(F.col("removed").isNull(), F.lit(0)).otherwise(lines - n_left).cast("long").alias("n_removed_lines"))
    if not keep_empty:
        rest = rest.filter("removed is null or size(stays) > 0")
    return rest.select(*_unpacked(df, text_col, new_text), counts.alias(unused(df, "line_dedup")))


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i,
         len(string_split(coalesce(text, ''), chr(10))) AS n
  FROM documents),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, {HEX_DIGITS}) AS BIGINT) AS h FROM lines),
rolled AS (
  SELECT *, (coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * {WEIGHT} + h) % {MODULUS} AS r FROM hashed),
begun AS (
  SELECT *, CASE WHEN i >= 2 AND i <= n - 2 AND r < lag(r) OVER (PARTITION BY doc_id ORDER BY i)
                  AND r <= lead(r) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS b FROM rolled),
numbered AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM begun),
chunks AS (
  SELECT doc_id, c, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS k,
         sum(CASE WHEN regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') THEN 1 ELSE 0 END) >= 2 AS counts
  FROM numbered GROUP BY doc_id, c),
ranked AS (
  SELECT *, CASE WHEN counts THEN row_number() OVER (PARTITION BY chunk, counts ORDER BY doc_id, c) ELSE 1 END AS rank FROM chunks)
SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY c) FILTER (WHERE rank = 1), '') AS text,
       CAST(sum(k) AS BIGINT) AS n_lines, CAST(coalesce(sum(k) FILTER (WHERE rank > 1), 0) AS BIGINT) AS n_removed_lines
FROM ranked GROUP BY doc_id
"""
