"""Line dedup where a line's earliest holder is not enough, and where short lines take part."""

from netdensity.llm import lines


def removed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r["__n_removed"], r.text) for r in lines.dedup_lines(df).collect()}


def line(k):
    return f"this is line number {k} of some text"


def test_other_earlier_holders_are_met(spark):
    a, b, c = line(1), line(2), line(3)
    rows = [(1, f"{a}\n{b}"), (2, f"{b}\n{a}"), (3, f"{b}\n{a}\n{c}"), (4, f"{a}\n{a}\n{a}"), (5, f"{c}\n{a}\n{a}\n{c}")]
    got = removed(spark, rows)
    assert got[1][0] == 0 and got[2][0] == 1  # one holder only, in another order
    assert got[3] == (2, c)  # 2 has both lines in this order
    assert got[4][0] == 3  # one of each of three earlier documents
    assert got[5] == (3, c)  # c once in 3; the second c has no other holder


def test_short_lines_of_copies_go(spark):
    head = f"Haanth.\n\n{line(1)}\nyes\nno\n{line(2)}"
    rows = [(1, head), (2, head), (3, "a b\nc"), (4, "a b\nc"), (5, f"Haanth.\n{line(1)}\nno\nother"), (6, "c"), (7, ""), (8, "")]
    got = removed(spark, rows)
    assert got[2] == (6, "") and got[4] == (2, "")
    assert got[5] == (3, "other")
    assert [got[k][0] for k in (1, 3, 6, 7, 8)] == [0] * 5
