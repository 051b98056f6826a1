"""Structure of printed pages from the boxes of their words: columns, lines, running lines, headings by size.

Words are rows(work, page, x0, y0, x1, y1, size, bold, text), y growing downwards. A page is a bounded group; nothing else is
gathered: works are compared by counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as S

from stemma.functions.text import short_batches
from stemma.operators.ranking import kept

#: Least empty space between columns and between rows of a cut; how far words of a line may be off; a wide gap in a line.
COLUMN_GAP, ROW_GAP, HEIGHT, GAP = 18.0, 12.0, 2.0, 18.0
#: Headings by size, as shares of the body's; bold ones are short; notes are smaller.
LEVEL_1, LEVEL_2, LEVEL_3, SHORT, NOTE = 2.0, 1.3, 1.05, 100, 0.9
#: Fixed value: what is but a page number.
NUMBER = r"^[0-9IVXLCDM\s–—-]+$"
PAGE = ["work", "page"]


def _widest(low: np.ndarray, high: np.ndarray) -> tuple[float, float]:
    """(width, at) of the widest gap that the words of a part leave empty, and where it ends; the first of several."""
    none = np.isnan(low)
    low, high = np.where(none, -np.inf, low), np.where(np.isnan(high), -np.inf, high)
    order = np.lexsort((high, low))
    before = np.maximum.accumulate(high[order])[:-1]
    begin = low[order][1:]
    open_ = (before > -np.inf) & ~none[order][1:]
    if not open_.any():
        return 0.0, 0.0
    gaps = np.subtract(begin, before, where=open_, out=np.zeros(len(begin)))
    k = int(gaps.argmax())
    return max(float(gaps[k]), 0.0), float(begin[k])


def _blocks(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, column_gap: float, row_gap: float) -> list[str]:
    """The part of each word of a page."""
    out, todo = [""] * len(x0), [("", np.arange(len(x0)))]
    while todo:
        block, words = todo.pop()
        (x, right), (y, below) = _widest(x0[words], x1[words]), _widest(y0[words], y1[words])
        if x >= column_gap and (x >= y or y < row_gap):
            after = x0[words] >= right
        elif y >= row_gap:
            after = y0[words] >= below
        else:
            for k in words.tolist():
                out[k] = block
            continue
        todo += [(block + "0", words[~after]), (block + "1", words[after])]
    return out


def columns(words: DataFrame, column_gap: float = COLUMN_GAP, row_gap: float = ROW_GAP) -> DataFrame:
    """Add `block`, a string that orders the parts of each page as they are read.

    A part is cut at its widest empty strip: from top to bottom, left before right, or from side to side; and so on, until
    no strip is wide enough. The words of a page are one row, and all its cuts are made where it is read, so words are moved
    once. A word without a box stays in the first part.
    """
    names = [c for c in words.columns if c not in PAGE]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("words").value_lengths().to_numpy()
            fields = dict(zip(names, batch.column("words").flatten().flatten(), strict=True))
            box = [pc.cast(fields[c], pa.float64()).to_numpy(zero_copy_only=False) for c in ("x0", "x1", "y0", "y1")]
            ends = np.cumsum(sizes).tolist()
            blocks = [b for a, z in zip([0, *ends], ends, strict=False) for b in _blocks(*(c[a:z] for c in box), column_gap, row_gap)]
            of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in PAGE), *fields.values(), pa.array(blocks, pa.string())], names=[*PAGE, *names, "block"])

    short_batches()
    whole = words.groupBy(*PAGE).agg(F.collect_list(F.struct(*names)).alias("words"))
    return whole.mapInArrow(cut, S.StructType([*(words.schema[c] for c in (*PAGE, *names)), S.StructField("block", S.StringType())]))


def lines(words: DataFrame, height: float = HEIGHT, gap: float = GAP) -> DataFrame:
    """Words with `block` -> work, page, n, y0, y1, x0, size, bold, text: the lines of each page in order.

    A line takes words up to `height` below its first. Wide gaps are marked as cells of a table are.
    """
    by = [*PAGE, "block"]
    tops = F.aggregate(F.array_sort(F.collect_set(F.col("y0").cast("double"))), F.array().cast("array<double>"), lambda out, y: F.when((F.size(out) == 0) | (y - F.element_at(out, -1) > height), F.concat(out, F.array(y))).otherwise(out))
    parts = words.groupBy(*by).agg(tops.alias("tops"), F.collect_list(F.struct("x0", "y0", "x1", "y1", "size", "bold", "text")).alias("words"))
    placed = parts.select(*by, "tops", F.explode("words").alias("w")).select(*by, "tops", "w.*").withColumn("line", F.size(F.filter("tops", lambda t: t <= F.col("y0"))))
    word = F.struct("x0", "x1", "text")
    rows = placed.groupBy(*by, "line").agg(F.array_sort(F.collect_list(word)).alias("w"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("size").alias("size"), F.max("bold").alias("bold"))
    joint = lambda i: F.when(i == 0, "").when(F.element_at("w", i + 1).x0 - F.element_at("w", i).x1 > gap, " ｜ ").otherwise(" ")
    text = F.array_join(F.transform("w", lambda w, i: F.concat(F.when(i == 0, "").otherwise(joint(F.greatest(i, F.lit(1)))), w.text)), "")
    n = F.row_number().over(W.partitionBy(*PAGE).orderBy("block", "line"))
    return kept(rows.select(*PAGE, n.alias("n"), "y0", "y1", "x0", "size", "bold", text.alias("text")))


def without_running(rows: DataFrame, share: float = 0.5) -> DataFrame:
    """lines() without headers, footers and page numbers: first and last lines that, digits aside, at least `share` of a work's pages have.

    A first or last line that is but a number goes too. Works of one page keep all else.
    """
    edges = rows.groupBy(*PAGE).agg(F.min("n").alias("top"), F.max("n").alias("bottom"))
    rows = rows.join(edges, PAGE).withColumn("edge", (F.col("n") == F.col("top")) | (F.col("n") == F.col("bottom")))
    rows = rows.withColumn("key", F.when(F.col("edge"), F.regexp_replace("text", "[0-9]+", "#")))
    pages = edges.groupBy("work").agg(F.count("*").alias("pages"))
    often = rows.where("edge").select(*PAGE, "key").distinct().groupBy("work", "key").agg(F.count("*").alias("times")).join(pages, "work")
    often = often.where((F.col("pages") > 1) & (F.col("times") >= F.col("pages") * share)).select("work", "key", F.lit(True).alias("running"))
    out = rows.join(often, ["work", "key"], "left")
    number = F.col("edge") & F.col("text").rlike(NUMBER)
    return out.where(~(F.coalesce("running", F.lit(False)) | number)).drop("top", "bottom", "edge", "key", "running")


def body_sizes(rows: DataFrame) -> DataFrame:
    """work, body: the size in which half of a work's characters or more are set no larger.

    The weighted median of a histogram of sizes, to a tenth: counts that add up, from any number of tasks.
    """
    histogram = rows.groupBy("work", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"))
    upto = F.sum("n").over(W.partitionBy("work").orderBy("size"))  # a row a size
    total = F.sum("n").over(W.partitionBy("work"))
    return histogram.select("work", "size", (2 * upto >= total).alias("half")).where("half").groupBy("work").agg(F.min("size").alias("body"))


def structured(rows: DataFrame) -> DataFrame:
    """lines() with `kind`: h1 to h3 for headings, row for cells of a table, note or p, by a line's size against its work's."""
    size = F.col("size") / F.nullif(F.col("body"), F.lit(0.0))
    short = F.col("bold") & (F.length("text") <= SHORT)
    kind = F.when(size >= LEVEL_1, "h1").when(size >= LEVEL_2, "h2").when(short & (size >= LEVEL_3), "h3").when(F.contains("text", F.lit(" ｜ ")), "row").when(size <= NOTE, "note").otherwise("p")
    return rows.join(body_sizes(rows), "work", "left").withColumn("kind", kind).drop("body")
