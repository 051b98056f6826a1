"""Filter interaction audit: what each filter removes in every order of the filters, from the edges of the subset lattice."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stemma.llm.common import let, narrowed, table

FILTERS = "ABCDE"
#: The filters of op11 but the last, which looks at all texts: words, repetition in %, capitals in %, odd signs.
LEAST_WORDS, DISTINCT, CAPITALS, SIGNS = 200, 50, 3, "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_failures(text: Column) -> Column:
    """Bits of what a text by itself fails: A (1) few words, B (2) repetition, C (4) capitals, D (8) signs."""

    def judged(words: Column) -> Column:
        n = F.size(words)
        few, repeated = n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < DISTINCT * n
        capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
        failed = (few, repeated, 100 * capitals > CAPITALS * F.length(text), text.rlike(SIGNS))
        return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(failed)), F.lit(0))

    # Only the first and the last piece can be empty.
    return let(F.filter(F.split(text, SPACES, -1), lambda w: w != ""), judged)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents(doc_id, lang, text), labels(doc_id, quality, toxic) -> part, fails, good, toxic, n: counts of documents.

    `fails` has a bit for each of FILTERS; the last is set where a smaller doc_id has the same text, by its SHA-256.
    Documents are counted by text, part and label before texts meet, so a text with very many copies is few rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = narrowed(docs, "doc_id", "lang", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), text_failures(F.col("text")).alias("fails"))
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = narrowed(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality"), is_one("toxic"))
    # Rows without a doc_id have no label; they are dealt by their text, as they would all meet in one place.
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("key")).otherwise(F.lit(0)))
    rows = rows.join(marks.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    kinds = ["part", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "fails"]
    same = rows.groupBy("doc_id", "key", *kinds).agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    groups = same.groupBy("key", "part", "good", "toxic", "fails").agg(F.sum("n").alias("n"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("loose"))
    least = F.min("first.doc_id").over(W.partitionBy("key"))
    groups = groups.withColumn("once", F.col("loose") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(F.lit(0)))
    last = 1 << (len(FILTERS) - 1)
    both = F.array(F.struct("fails", F.col("once").alias("n")), F.struct(F.col("fails").bitwiseOR(F.lit(last)).alias("fails"), (F.col("n") - F.col("once")).alias("n")))
    cells = groups.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.fails", "x.n")
    return cells.groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def lattice(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """cells(part, fails, good, toxic, n) -> part, before, filter and COUNTS, a row an edge of the lattice of filter subsets.

    An edge is a set of filters that have been applied (bits of `before`) and the filter (its number) that is next:
    80 edges for five filters. Each cell counts on every edge. In an order of all filters, the edge stands wherever
    that filter follows those others, in any order: |before|! * (others left)! times, which weighs `shapley`.
    """
    k = len(filters)
    edges = cells.withColumn("before", F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1)))).withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    edges = edges.where(F.col("before").bitwiseAND(bit) == 0)
    alive, fails = F.col("fails").bitwiseAND(F.col("before")) == 0, F.col("fails").bitwiseAND(bit) != 0
    count = lambda what, name: F.sum(F.when(what, F.col("n")).otherwise(F.lit(0))).alias(name)
    sums = [count(alive & ~fails, "kept"), count(alive & fails, "removed"), count(~alive & fails, "redundant"), count(F.col("fails") == bit, "unique_fails")]
    sums += [count(alive & fails & F.col("good"), "good_lost"), count(alive & fails & F.col("toxic"), "toxic_lost")]
    edges = edges.groupBy("part", "before", "filter").agg(*sums)
    times = F.element_at(F.array(*(F.lit(factorial(j) * factorial(k - 1 - j)) for j in range(k))), F.bit_count("before") + 1)
    return edges.withColumn("shapley", F.sum(F.col("removed") * times).over(W.partitionBy("part", "filter")))


def paths(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """filter_order, step, before, filter: the edges that each order of the filters goes along, 600 for five filters."""
    rows = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(filters[i] for i in order), step, before, f))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, before int, filter int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and COUNTS: every order of the five filters of op11, in each language.

    Documents count into cells of what they fail (failures()), cells into the 80 edges of the lattice (lattice()), and
    each of the 600 steps of the orders reads its edge. No order filters documents by itself.

    A null text counts as empty: it fails A, and E if a smaller doc_id is empty too. A null language is the part ''. Rows
    that repeat a doc_id all count, and none of them is a copy of another by that; rows without a doc_id are neither
    copies nor labelled, nor do they make others copies. Of several labels of a doc_id, any 1 counts. No documents: no rows.
    """
    steps = F.broadcast(paths(docs.sparkSession))  # 600 rows, whatever the data
    out = lattice(failures(docs, labels)).join(steps, ["before", "filter"])
    return out.select("part", "filter_order", "step", *COUNTS)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The same by counting, for each of the 80 edges, the documents themselves.
SQL = r"""
    WITH word AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    mark AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    fail AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS m FROM word LEFT JOIN mark USING (doc_id)),
    edge AS (SELECT part, s, f, count(*) FILTER (m & s = 0 AND m & (1 << f) = 0) AS kept, count(*) FILTER (m & s = 0 AND m & (1 << f) <> 0) AS removed, count(*) FILTER (m & s <> 0 AND m & (1 << f) <> 0) AS redundant,
        count(*) FILTER (m = 1 << f) AS unique_fails, count(*) FILTER (m & s = 0 AND m & (1 << f) <> 0 AND good) AS good_lost, count(*) FILTER (m & s = 0 AND m & (1 << f) <> 0 AND toxic) AS toxic_lost
        FROM fail, range(32) a(s), range(5) b(f) WHERE s & (1 << f) = 0 GROUP BY part, s, f),
    letter AS (SELECT f, 'ABCDE'[f + 1] AS c FROM range(5) r(f)),
    orders AS (SELECT a.f AS f1, b.f AS f2, c.f AS f3, d.f AS f4, e.f AS f5, a.c || b.c || c.c || d.c || e.c AS filter_order FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    path AS (SELECT filter_order, step::INT AS step, [f1, f2, f3, f4, f5][step] AS f, coalesce(list_sum(list_transform([f1, f2, f3, f4, f5][:step - 1], lambda x: 1 << x)), 0)::BIGINT AS s FROM orders, range(1, 6) r(step)),
    walk AS (SELECT * FROM path JOIN edge USING (s, f)),
    shap AS (SELECT part, f, sum(removed)::BIGINT AS shapley FROM walk GROUP BY part, f)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM walk JOIN shap USING (part, f)"""
