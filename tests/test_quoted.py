"""Records with line breaks in quotes, against Python's csv."""

import csv
import random

import pytest

from halyard.sources import delimited


def test_quoted_breaks_across_blocks(spark, tmp_path, monkeypatch):
    """Fields with commas, quotes and line breaks, in two files that are read in blocks of a few lines, numbered as records."""
    monkeypatch.setattr(delimited, "CHUNK", 7)
    r = random.Random(4)
    field = lambda: "".join(r.choice(["a", "b c", ",", '"', "\n", "\n\n", "é", " "]) for _ in range(r.randrange(9)))
    want = {}
    for name in ("a", "b"):
        rows = [[f"x{k}", field(), field()] for k in range(400)]
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            f.write('\\preamble, with "one quote\nK,One,Two\n')
            csv.writer(f, quoting=csv.QUOTE_MINIMAL, lineterminator="\n").writerows(rows)
        with open(tmp_path / f"{name}.csv", newline="") as f:
            f.readline()
            want |= {(name, k + 1): tuple(x) for k, x in enumerate(list(csv.reader(f))[1:])}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        out = delimited.read_after_header(spark, str(tmp_path), {"K": "k", "One": "one", "Two": "two"}, file_col="file", quoted=True)
        assert out.select("file").rdd.getNumPartitions() >= 1 and delimited.numbered_lines(spark, str(tmp_path)).count() > 1000
        got = {(x.file[-5], x._source_row_number): (x.k, x.one or "", x.two or "") for x in out.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_records_without_quotes_are_lines(spark, tmp_path):
    (tmp_path / "p.csv").write_text("K,V\n1,2\n\n3,4\n")
    plain, quoted = (sorted(map(tuple, delimited.read_after_header(spark, str(tmp_path), {"K": "k", "V": "v"}, quoted=q).collect())) for q in (False, True))
    assert plain == quoted == [("1", "2", 1), ("3", "4", 3)]


def test_a_quote_that_is_not_closed_is_refused(spark, tmp_path):
    (tmp_path / "p.csv").write_text('K,V\n1,"2\n' + "3,4\n" * 50)
    lines = delimited.numbered_lines(spark, str(tmp_path))
    with pytest.raises(ValueError, match="a quote is not closed"):
        delimited.logical_lines(lines, longest=20)
