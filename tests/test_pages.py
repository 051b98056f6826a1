"""Printed pages: columns in order, lines, running lines, headings against the body's size."""

import random

import pytest

from stemma.operators import pages as P

SCHEMA = "work string, page int, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, text string"


def word(x, y, text, width=20, size=10.0, bold=False, page=1, work="w"):
    return (work, page, float(x), float(y), float(x + width), float(y + size), size, bold, text)


def said(spark, rows):
    lines = P.lines(P.columns(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    return [r.text for r in lines.orderBy("work", "page", "n").collect()]


def test_two_columns(spark):
    rows = [word(10, 5, "A title over both", 300, 20.0)]
    rows += [word(10, 60 + 12 * k, f"l{k}", 100) for k in range(4)] + [word(200, 60 + 12 * k, f"r{k}", 100) for k in range(3)]
    rows += [word(10, 150, "after", 300)]
    assert said(spark, rows) == ["A title over both", "l0", "l1", "l2", "l3", "r0", "r1", "r2", "after"]
    # three columns, the last with two parts
    rows = [word(100 * c + 10, 12 * k, f"{c}{k}", 60) for c in range(3) for k in range(3)] + [word(210, 100, "below", 60)]
    assert said(spark, rows) == [f"{c}{k}" for c in range(3) for k in range(3)] + ["below"]


def test_lines(spark):
    rows = [word(40, 100, "b"), word(10, 101.5, "a"), word(90, 100, "c"), word(10, 112, "d"), word(31, 113.9, "e", 5), word(37, 114.1, "f", 5), word(44, 120, "g", 5)]
    lines = P.lines(P.columns(spark.createDataFrame(rows, SCHEMA), column_gap=1000))
    assert [r.text for r in lines.orderBy("n").collect()] == ["a b ｜ c", "d e", "f", "g"]
    empty = spark.createDataFrame([], SCHEMA)
    assert P.structured(P.without_running(P.lines(P.columns(empty)))).count() == 0


def test_running_lines(spark):
    rows = []
    for page in range(1, 7):
        rows += [word(10, 5, f"Head {page}", 200, page=page), word(10, 40, f"body {'x' * page}", 200, page=page), word(10, 60, "Head 7", 200, page=page), word(100, 90, f"– {page} –", page=page)]
    rows += [word(10, 5, "Head 1", 200, work="single"), word(10, 40, "text", 200, work="single")]
    rows += [word(10, 5, "Only here", 200, page=p, work="v") if p == 1 else word(10, 5, f"x{'y' * p}", 200, page=p, work="v") for p in (1, 2, 3)]
    out = P.without_running(P.lines(P.columns(spark.createDataFrame(rows, SCHEMA))))
    got = {}
    for r in out.collect():
        got.setdefault(r.work, []).append(r.text)
    assert sorted(got["w"]) == sorted([f"body {'x' * p}" for p in range(1, 7)] + ["Head 7"] * 6)  # the same words inside a page stay
    assert sorted(got["single"]) == ["Head 1", "text"] and sorted(got["v"]) == ["Only here", "xyy", "xyyy"]


@pytest.mark.parametrize("scale", [1.0, 1.6])
def test_headings_by_the_bodys_size(spark, scale):
    rows = [("w", 1, 0, 24.0, True, "Title"), ("w", 1, 1, 14.0, False, "Chapter"), ("w", 1, 2, 11.0, True, "Section"), ("w", 1, 3, 11.0, True, "long " * 30), ("w", 1, 4, 11.0, False, "not bold"), ("w", 1, 5, 8.0, False, "a note"), ("w", 1, 6, 10.0, False, "a ｜ b")] + [("w", 1, k, 10.0, False, "plain body text " * 4) for k in range(7, 20)]
    frame = spark.createDataFrame([(w, p, n, s * scale, b, t) for w, p, n, s, b, t in rows], "work string, page int, n int, size double, bold boolean, text string")
    assert [r.body for r in P.body_sizes(frame).collect()] == [10.0 * scale]
    kinds = [r.kind for r in P.structured(frame).orderBy("n").collect()]
    assert kinds == ["h1", "h2", "h3", "p", "p", "note", "row"] + ["p"] * 13


def parts_of(words, columns, rows, block=""):
    """{text: block} of one page, word by word."""

    def widest(low, high):
        end, width, at = float("-inf"), 0.0, 0.0
        for w in sorted(words, key=lambda w: (float("-inf") if w[low] is None else w[low], float("-inf") if w[high] is None else w[high])):
            if w[low] is not None and end > float("-inf") and w[low] - end > width:
                width, at = w[low] - end, w[low]
            end = max(end, float("-inf") if w[high] is None else w[high])
        return width, at

    (x, right), (y, below) = widest(2, 4), widest(3, 5)
    if x >= columns and (x >= y or y < rows):
        side = lambda w: w[2] is not None and w[2] >= right
    elif y >= rows:
        side = lambda w: w[3] is not None and w[3] >= below
    else:
        return {w[8]: block for w in words}
    return parts_of([w for w in words if not side(w)], columns, rows, block + "0") | parts_of([w for w in words if side(w)], columns, rows, block + "1")


def test_pages_are_cut_where_they_are_read(spark):
    """words are moved once, however many cuts there are inside each other, and nothing is stored between cuts."""
    r = random.Random(1)
    some = lambda: None if r.random() < 0.03 else float(r.randrange(40) * 10)
    rows = []
    for page in range(30):
        for k in range(r.choice([1, 2, 30])):
            x, y = some(), some()
            rows.append(("w", page, x, y, x and x + r.choice([5.0, 9.0, 100.0]), y and y + 8, 10.0, False, f"{k}"))
    out = P.columns(spark.createDataFrame(rows, SCHEMA).repartition(3), 25.0, 15.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Union" not in plan
    got = {}
    for w in out.collect():
        got.setdefault(w.page, {})[w.text] = w.block
    assert got == {p: parts_of([w for w in rows if w[1] == p], 25.0, 15.0) for p in {w[1] for w in rows}} and max(len(b) for g in got.values() for b in g.values()) > 3
    lines = P.lines(out)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in lines
