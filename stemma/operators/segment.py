"""Words of texts that do not part them: the best path through a lattice of known words, weighed by the corpus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions import text as T

#: Characters of the longest word that is learnt, and the weight that stands for a word seen half a time.
LONGEST, HALF = 24, 0.5
#: A run of one script, which may be a word: Han, Hiragana, Katakana, or what else has letters and digits.
SCRIPTS = r"[\p{IsHan}々〆]+|[\p{IsHiragana}]+|[\p{IsKatakana}ー]+|[\p{L}\p{M}\p{N}&&[^\p{IsHan}々〆\p{IsHiragana}\p{IsKatakana}ー]]+"
#: Places of one piece when a run is spread out, as each cut counts characters from the start.
PIECE = 64


def vocabulary(texts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """texts(text) -> word, cost: what lower-cased texts have between spaces, signs and changes of script, in one aggregate.

    cost is 1000 * ln(words in all / times of this one), rounded; see unknown() for characters that are no word.
    """
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(T.nfc(F.col("text"))), F.lit(SCRIPTS), F.lit(0))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).withColumn("total", F.lit(None).cast("long"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    return counted.where(F.length("word") <= longest).select("word", F.round(1000 * F.log(F.lit(total) / F.col("n"))).cast("long").alias("cost"), F.lit(total).alias("total"))


def unknown(total: int) -> int:
    """The cost of a character that is no word by itself: that of a word seen HALF a time."""
    return round(1000 * float(np.log(max(total, 1) / HALF)))


def best_path(length: int, first: np.ndarray, size: np.ndarray, cost: np.ndarray, other: int) -> list[int]:
    """Where the words of the least total cost end. Ties: fewer words, then the longer last word."""
    ending: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]
    for a, n, c in zip(first.tolist(), size.tolist(), cost.tolist(), strict=True):
        ending[a + n].append((a, c))
    best: list[tuple[int, int, int]] = [(0, 0, 0)]
    for j in range(1, length + 1):
        ways = ending[j] if any(a == j - 1 for a, _ in ending[j]) else [*ending[j], (j - 1, other)]
        best.append(min((best[a][0] + c, best[a][1] + 1, a) for a, c in ways))
    ends, j = [], length
    while j:
        ends.append(j)
        j = best[j][2]
    return ends[::-1]


def segmented(texts: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """texts(id, text) and vocabulary() -> id, words: each run of letters and digits cut into its best words, in order.

    Every place of a run asks the vocabulary for the words that may begin there: one equality join, in which neither
    side is held by a task. A run's edges meet, at most `longest` for each of its characters, for the best path.
    A text without letters, or null, has no words.
    """
    total = words.select("total").limit(1).collect()  # one number
    other = unknown(total[0].total if total else 0)
    runs = texts.select("id", F.posexplode(T.surface_words(T.nfc(F.col("text")))).alias("run", "said"))
    n = F.length("said")
    pieces = F.transform(F.sequence(F.lit(1), n, F.lit(PIECE)), lambda i: F.struct(i.alias("at"), F.substring("said", i, F.lit(PIECE + longest - 1)).alias("p")))
    spread = runs.select("id", "run", F.explode(pieces).alias("x")).select("id", "run", "x.at", F.lower("x.p").alias("p"), F.length("x.p").alias("m"))
    spread = spread.where(F.length("p") == F.col("m"))  # where lower case has other lengths, there are no words
    spread = spread.select("id", "run", "at", "p", "m", F.explode(F.sequence(F.lit(1), F.least(F.col("m"), F.lit(PIECE)))).alias("k"))
    spread = spread.select("id", "run", (F.col("at") + F.col("k") - 2).alias("first"), "p", "k", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("m") - F.col("k") + 1))).alias("size"))
    asked = spread.select("id", "run", "first", "size", F.substring("p", F.col("k"), F.col("size")).alias("word"))
    edges = asked.join(words.select("word", "cost"), "word").groupBy("id", "run").agg(F.collect_list(F.struct("first", "size", "cost")).alias("edges"))
    lattice = runs.join(edges, ["id", "run"], "left").select("id", "run", "said", n.alias("n"), F.coalesce("edges", F.array().cast(edges.schema["edges"].dataType)).alias("edges"))

    @F.pandas_udf("array<int>")
    def ends(length: pd.Series, edges: pd.Series) -> pd.Series:
        fields = lambda e, k: np.array([x[k] for x in e], np.int64)
        return pd.Series([best_path(int(m), *(fields(e, k) for k in ("first", "size", "cost")), other) for m, e in zip(length, edges, strict=True)])

    cut = lattice.withColumn("ends", ends("n", "edges"))
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("ends", i - 1))
    said = F.transform("ends", lambda e, i: F.substring("said", begin(i) + 1, e - begin(i)))
    rows = cut.select("id", "run", said.alias("words")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("run", "words"))).alias("runs"))
    made = rows.select("id", F.flatten(F.transform("runs", lambda r: r.words)).alias("words"))
    return texts.select("id").join(made, "id", "left").select("id", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def candidates(texts: DataFrame, words: DataFrame) -> DataFrame:
    """texts(id, text) -> id, queries: what to ask an index for, by the best words of the text and then by its surface words."""
    found = segmented(texts, words).join(texts.select("id", T.nfc(F.col("text")).alias("text")), "id")
    both = F.array(F.col("words"), T.surface_words(F.coalesce("text", F.lit(""))))
    return found.select("id", queries(both).alias("queries"))


def queries(tokenizations: Column) -> Column:
    """The queries of each tokenization, one after the other, each once."""
    return F.array_distinct(F.flatten(F.transform(tokenizations, T.candidate_queries)))
