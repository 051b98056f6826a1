"""Words, contents, parts and ranks on small cases, against plain Python."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from stemma.operators import index, outline, ranking, segment
from stemma.sources import formats


def test_words_of_scripts(spark):
    texts = spark.createDataFrame([("東京タワーへ行く、東京 Tower",), (None,), ("",), ("ABC abc",)], "text string")
    assert {r.word: r.cost for r in segment.vocabulary(texts).collect()} == {w: round(1000 * math.log(9 / n)) for w, n in {"東京": 2, "タワー": 1, "へ": 1, "行": 1, "く": 1, "tower": 1, "abc": 2}.items()}


def test_best_words(spark):
    """Against all ways to cut a run."""
    counts = {"a": 5, "ab": 9, "abc": 2, "b": 1, "bca": 7, "ca": 8, "é": 3, "cab": 4}
    words = spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "text string")
    vocabulary = segment.vocabulary(words)
    total = sum(counts.values())
    cost = lambda w: round(1000 * math.log(total / counts[w])) if w in counts else (segment.unknown(total) if len(w) == 1 else math.inf)

    def best(run):
        ways = []
        for cuts in itertools.product([0, 1], repeat=len(run) - 1):
            out, start = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    out.append(run[start:i])
                    start = i
            out.append(run[start:])
            ways.append((sum(cost(w.lower()) for w in out), len(out), out))
        least = min(w[:2] for w in ways)
        return [w[2] for w in ways if w[:2] == least]

    r = random.Random(4)
    runs = ["".join(r.choice("abcABéx") for _ in range(r.randrange(1, 10))) for _ in range(60)]
    texts = spark.createDataFrame([(i, f"{x}, {y}!") for i, (x, y) in enumerate(itertools.pairwise(runs))] + [(100, None), (101, "--"), (102, "ab" * 5000)], "id int, text string")
    got = {r.id: r.words for r in segment.segmented(texts, vocabulary).collect()}
    assert got[100] == got[101] == [] and got[102] == ["ab"] * 5000
    for i, (x, y) in enumerate(itertools.pairwise(runs)):
        assert any(got[i] == a + b for a in best(x) for b in best(y)), (x, y, got[i])
    assert {tuple(r.words) for r in segment.segmented(texts.where("id = 0"), vocabulary.limit(0)).collect()} == {tuple(c for run in runs[:2] for c in run)}


def test_queries_of_both_kinds(spark):
    words = segment.vocabulary(spark.createDataFrame([("東京 東京 大学 大学",)], "text string"))
    texts = spark.createDataFrame([(1, "東京大学"), (2, "")], "id int, text string")
    got = {r.id: r.queries for r in segment.candidates(texts, words).collect()}
    assert got == {1: ["東京 大学", "東 京 大学", "東京 大 学", "東京大学", "東 京大学", "東京大 学"], 2: []}


def folded(runs, chars, chunks):
    """Parts of page runs (first, chunks, chars, head), one after the other."""
    out, held, count = [], 0, 0
    for first, n, size, head in runs:
        if count and (held + head > chars or count >= chunks):
            held = count = 0
        if not count:
            out.append([first, 0, 0])
        out[-1][1] += n
        out[-1][2] += size
        held, count = held + size, count + n
    return out


@pytest.mark.parametrize("seed", range(4))
def test_parts_as_a_fold(spark, seed, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET", 37)
    r = random.Random(seed)
    rows, want = [], {}
    for slug in ("u", "v", "w"):
        runs, ord_ = [], 1
        for page in range(r.choice([1, 40, 120])):
            texts = ["x" * r.choice([1, 5, 30, 200 if seed == 3 else 9]) for _ in range(r.randrange(1, 6))]
            runs.append((ord_, len(texts), sum(map(len, texts)), len(texts[0])))
            rows += [(slug, ord_ + k, page, t) for k, t in enumerate(texts)]
            ord_ += len(texts)
        want[slug] = folded(runs, 100, 12)
    made = index.parts(spark.createDataFrame(rows, "slug string, ord long, pdf_page int, text string").repartition(5), 100, 12)
    got = {}
    for p in sorted(made.collect(), key=lambda p: (p.slug, p.part)):
        got.setdefault(p.slug, []).append([p["first"], p.chunks, p.chars])
        assert p.part == len(got[p.slug]) - 1
    assert got == want


def tree(levels):
    """depth, last, left, right of each heading, by a stack."""
    out, stack, clock = [None] * len(levels), [], 0
    for i, level in enumerate([*levels, 0]):
        while stack and levels[stack[-1]] >= level:
            j = stack.pop()
            clock += 1
            out[j] = (len(stack), i, out[j], clock)
        if i < len(levels):
            clock += 1
            out[i] = clock
            stack.append(i)
    return [(d, last, left, right) for d, last, left, right in out]


def test_interval_numbers(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET", 7)
    r = random.Random(2)
    works = {f"w{k}": [r.randrange(1, 7) for _ in range(r.randrange(1, 60))] for k in range(6)}
    rows = [(w, i, level) for w, levels in works.items() for i, level in enumerate(levels, 1)]
    made = outline.numbered_tree(spark.createDataFrame(rows, "slug string, ord long, level int"))
    got = {}
    for x in sorted(made.collect(), key=lambda x: (x.slug, x.ord)):
        got.setdefault(x.slug, []).append((x.depth, x.last, x.left, x.right))
    assert got == {w: tree(levels) for w, levels in works.items()}


def test_contents(spark):
    schema = "slug string, seq long, path string, level int, label string, anchor string, unlisted boolean"
    rows = [("w", 10, "a.xhtml", 1, " One \n two", "x", None), ("w", 20, "a.xhtml", 3, "Deep", "x", False), ("w", 30, "a.xhtml", 2, "Second", None, False), ("w", 35, "a.xhtml", 2, "hidden", "h", True), ("w", 36, "a.xhtml", 2, " ", "b", False), ("w", 37, "a.xhtml", 5, "small", "s", False), ("w", 40, "b.xhtml", 1, "A & <b>", "x", False)]
    entries = outline.contents(spark.createDataFrame(rows, schema))
    got = [(e.ord, e.label, e.target, e.depth) for e in entries.orderBy("ord").collect()]
    assert got == [(1, "One two", "a.xhtml#x", 0), (2, "Deep", "a.xhtml#reading-order-heading-00002", 1), (3, "Second", "a.xhtml#reading-order-heading-00003", 1), (4, "A & <b>", "b.xhtml#x", 0)]
    markup = "".join(r.markup for r in outline.contents_markup(entries).orderBy("ord").collect())
    assert markup == '<li><a href="a.xhtml#x">One two</a><ol class="toc"><li><a href="a.xhtml#reading-order-heading-00002">Deep</a></li><li><a href="a.xhtml#reading-order-heading-00003">Second</a></li></ol></li><li><a href="b.xhtml#x">A &amp; &lt;b&gt;</a></li>'
    assert outline.contents(spark.createDataFrame([], schema)).count() == 0


def test_ranks_of_any_key(spark):
    big = 2**53
    rows = [(big + 1, 3), (big, 2), (big + 2, 1), (None, 4), (None, 0)] + [(5, k) for k in range(10, 400)]
    frame = spark.createDataFrame(rows, "key long, ord long").repartition(6)
    up = {r.ord: r["rank"] for r in ranking.numbered(frame, F.col("key"), "ord").collect()}
    down = {r.ord: r["rank"] for r in ranking.numbered(frame, F.col("key"), "ord", True).collect()}
    order = lambda sign: [o for *_, o in sorted((k is None, sign * (k or 0), o) for k, o in rows)]
    assert [o for o, _ in sorted(up.items(), key=lambda x: x[1])] == order(1) and sorted(up.values()) == [*range(1, len(rows) + 1)]
    assert [o for o, _ in sorted(down.items(), key=lambda x: x[1])] == order(-1)
    words = spark.createDataFrame([(w,) for w in ("b", "é", "", "a", "\U0001f600", "￿")], "w string")
    assert [r.w for r in ranking.ranked(words, F.encode("w", "UTF-16BE").asc()).orderBy("rank").collect()] == ["", "a", "b", "é", "\U0001f600", "￿"]
    assert ranking.ranked(words.limit(0), F.col("w").asc()).count() == 0
    ranking.release()


@pytest.mark.parametrize("form", ["lines", "array", "one line", "parquet", "blank lines"])
def test_catalogues(spark, tmp_path, form):
    records = [{"slug": f"s{k}", "title": f"t {k}"} for k in range(40)]
    path = tmp_path / ("c.parquet" if form == "parquet" else "c.json")
    if form == "parquet":
        spark.createDataFrame(records).coalesce(1).write.parquet(str(path))
    else:
        joint = "\n\n" if form == "blank lines" else "\n"
        text = {"array": json.dumps(records, indent=1), "one line": json.dumps(records)}.get(form, joint.join(map(json.dumps, records)))
        path.write_text(("\n" if form == "blank lines" else "") + text)
    rows = formats.read_catalogue(spark, str(path))
    assert [(r.slug, r.ord) for r in rows.orderBy("ord").collect()] == [(f"s{k}", k) for k in range(40)]


def test_block_ids_beyond_five_digits(spark):
    from stemma.functions import text as T
    from stemma.operators import integrity, search

    rows = spark.createDataFrame([("w", 99_999), ("w", 100_000), ("w", 150_000)], "slug string, ord long")
    results = rows.select("slug", "ord", F.lit(None).cast("string").alias("anchor"), F.concat(F.lit("/x/#"), T.block_id(F.col("ord"))).alias("url"))
    chunks = rows.select("slug", "ord", F.lit("p").alias("original_page"), F.lit(1).alias("pdf_page"))
    assert sorted(r["order"] for r in search.located(results, index.page_map(chunks)).collect()) == [99_998, 99_999, 149_999]
    ids = spark.createDataFrame([("b00001",), ("b100000",), ("b012345",), ("b1234",), ("x00001",)], "id string")
    assert sorted(r.key for r in integrity.shape(ids, "id", "id", integrity.BLOCK).collect()) == ["b012345", "b1234", "x00001"]
