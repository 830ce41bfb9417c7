import pytest

from curata.llm import lines
from curata.llm.queries import ORACLES, QUERIES
from tests.llm.test_pipeline import brute_lines

A, B = "one\ntwo\nthree", "x\ny\nz\nw"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def by_id(df):
    return {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in df.collect()}


def test_overlapping_windows_and_edges(spark):
    got = by_id(
        lines.line_dedup(
            docs(
                spark,
                [
                    (1, A),
                    (2, "head\n" + A + "\ntail"),
                    (3, B),
                    (4, "p\n" + B),  # two windows that overlap: four lines go
                    (5, None),
                    (6, ""),
                    (7, "one\ntwo"),  # under three lines
                    (8, A),  # loses every line, its row stays
                    (9, " \n\t\n\r\n\nend"),
                    (10, " \n\t\n\r\n\nstop"),  # blank windows never count
                    (11, "r\nr\nr\nr\nr"),  # a window that repeats inside its own document
                ],
            )
        )
    )
    assert got == {
        1: (A, 3, 0), 2: ("head\ntail", 5, 3), 3: (B, 4, 0), 4: ("p", 5, 4), 5: ("", 1, 0), 6: ("", 1, 0), 7: ("one\ntwo", 2, 0),
        8: ("", 3, 3), 9: (" \n\t\n\r\n\nend", 5, 0), 10: (" \n\t\n\r\n\nstop", 5, 0), 11: ("r", 5, 4),
    }
    assert got[11][0] == brute_lines([(11, "r\nr\nr\nr\nr")])[11]


def test_repeated_rows_and_null_ids(spark):
    rows = lines.line_dedup(docs(spark, [(5, A), (5, A), (None, A), (9, A)])).collect()
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.text, r.n_removed) for r in rows))
    # the null id comes first and keeps its lines; rows that repeat id and text are one document
    assert got == [(False, 0, A, 0), (True, 5, "", 3), (True, 5, "", 3), (True, 9, "", 3)]
    rows = lines.line_dedup(docs(spark, [(5, A), (5, A)])).collect()
    assert [r.text for r in rows] == [A, A]


def test_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([(1, A, "old", 7), (2, A, "old", 8)], "doc_id long, text string, n_lines string, at int")
    got = {r.doc_id: r.asDict() for r in lines.line_dedup(df).collect()}
    assert got == {
        1: {"doc_id": 1, "text": A, "n_lines": 3, "at": 7, "n_removed": 0},
        2: {"doc_id": 2, "text": "", "n_lines": 3, "at": 8, "n_removed": 3},
    }


def test_empty_table(spark):
    out = lines.line_dedup(docs(spark, []))
    assert out.collect() == [] and out.columns == ["doc_id", "text", "n_lines", "n_removed"]


@pytest.mark.parametrize("n", [30_000])
def test_very_long_text(spark, n):
    long = "\n".join(f"line {i % 20_011}" for i in range(n))  # its last third repeats its first lines
    rows = [(1, long), (2, "\n".join(f"line {i}" for i in range(500, 900))), (3, "word " * 200_000)]
    assert {d: t for d, (t, _, _) in by_id(lines.line_dedup(docs(spark, rows))).items()} == brute_lines(rows)


def test_no_python_worker(spark):
    plan = QUERIES["op10_line_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
    assert "op10_line_dedup" in ORACLES
