import zlib

import duckdb
from pyspark.sql import functions as F

from stemma.llm import sharding as S


def check(rows, shards, total):
    counts = [0] * shards
    slots = [set() for _ in range(shards)]
    for r in rows:
        counts[r.shard] += 1
        slots[r.shard].add(r.slot)
    assert sum(counts) == total
    assert max(counts) - min(counts) <= 1
    assert all(s == set(range(n)) for s, n in zip(slots, counts, strict=True))


def links(docs):
    return docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("hub"))


def test_copies_meet_and_a_hot_group_is_split(make_docs):
    texts = ["hot"] * 100 + [f"pair{i // 2}" for i in range(60)] + [f"single{i}" for i in range(140)] + ["", None]
    docs = make_docs([*enumerate(texts), (None, "x"), (7, "hot")]).drop("shard")
    rows = S.shard(docs, links(docs), 6).collect()
    check(rows, 6, len(texts) + 2)
    pairs = {}
    for r in rows:
        if r.text and r.text.startswith("pair"):
            pairs.setdefault(r.text, set()).add(r.shard)
    assert sum(len(s) == 1 for s in pairs.values()) >= 0.9 * len(pairs)


def test_edges_pull_neighbours_together(spark, make_docs):
    docs = make_docs([f"t{i}" for i in range(200)]).drop("shard")
    edges = [(i, f"e{i // 4}-{j}") for i in range(80) for j in range(4)]  # cliques of four, as hubs
    rows = S.shard(docs, spark.createDataFrame(edges, "doc_id long, hub string"), 4).collect()
    check(rows, 4, 200)
    at = {r.doc_id: r.shard for r in rows}
    assert sum(len({at[4 * c + k] for k in range(4)}) == 1 for c in range(20)) >= 16


def test_few_rows(make_docs):
    for texts in ([], ["a"], ["a", "a", None]):
        docs = make_docs(texts).drop("shard")
        check(S.shard(docs, links(docs), 5).collect(), 5, len(texts))


def test_query(spark, small):
    rows = S.op2_sharding(spark, small).collect()
    check(rows, 24, 200)
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{small}/documents.parquet')").fetchall())
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def whole(rows, key):
    """The share of groups that stand in one shard, of those with several rows."""
    at = {}
    for r in rows:
        at.setdefault(key(r), []).append(r.shard)
    several = [set(x) for x in at.values() if len(x) > 1]
    return sum(len(x) == 1 for x in several) / len(several)


def test_groups_that_fit_stay_whole(make_docs):
    """Also where every row has a copy, so that there is room only where others leave, and for groups near a shard's size."""
    for texts, least in (([f"t{i // 2}" for i in range(2400)], 0.9), ([f"t{i // 6}" for i in range(1200)], 0.8), ([f"big{i // 180}" for i in range(1080)] + [f"s{i}" for i in range(120)], 1.0)):
        docs = make_docs(texts, clash=False)
        rows = S.shard(docs, links(docs), 6).collect()
        check(rows, 6, len(texts))
        assert whole([r for r in rows if not r.text.startswith("s")], lambda r: r.text) >= least


def test_a_group_beyond_a_shard_is_cut_as_little_as_can_be(make_docs):
    docs = make_docs(["hot"] * 500 + [f"s{i}" for i in range(700)], clash=False)
    rows = S.shard(docs, links(docs), 6).collect()
    check(rows, 6, 1200)
    assert len({r.shard for r in rows if r.text == "hot"}) <= 5


def test_names_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "x" * 3_000_000, 5, "a"), (2, "y", 6, "b"), (3, "y", 7, None)], "doc_id long, text string, shard int, _label string")
    docs = docs.withColumns({n: F.col("_label") for n in ("slot", "_bucket", "label", "main", "bucket", "row", "doc", "id", "size", "number", "rank", "to", "left", "sub", "n")})
    rows = S.shard(docs, links(docs), 2).collect()
    check(rows, 2, 3)
    assert sorted(rows[0].asDict()) == sorted(docs.columns)
    assert {r.doc_id: (len(r.text), r._label, r.main, r.n) for r in rows} == {1: (3_000_000, "a", "a", "a"), 2: (1, "b", "b", "b"), 3: (1, None, None, None)}
    assert {r.shard for r in rows} == {0, 1}


def best_whole(sizes, quotas):
    """The most groups that can stand whole, by trying all places of each group; what is cut fills the rest."""
    best = 0

    def place(k, free, n):
        nonlocal best
        if k == len(sizes):
            best = max(best, n)
        elif n + len(sizes) - k > best:
            for s in range(len(free)):
                if free[s] >= sizes[k]:
                    place(k + 1, [f - sizes[k] * (i == s) for i, f in enumerate(free)], n + 1)
            place(k + 1, free, n)

    place(0, list(quotas), 0)
    return best


def test_against_all_placements(make_docs):
    """On small cases: groups that stand whole, and edges that are cut, against the best that any placement reaches."""
    short = cut = edges = groups_ = 0
    for k, sizes in enumerate(([5, 4, 3, 3, 2, 2, 1, 1], [4, 4, 4, 2, 2, 2], [7, 2, 2, 2, 2], [3, 3, 3, 3, 3, 3], [2] * 9, [10, 3, 3, 2])):
        texts = [f"case{k} group{g}" for g, n in enumerate(sizes) for _ in range(n)]
        docs = make_docs(texts).drop("shard")
        rows = S.shard(docs, links(docs), 3).collect()
        check(rows, 3, len(texts))
        at = {}
        for r in rows:
            at.setdefault(r.text, []).append(r.shard)
        quotas = sorted((sum(r.shard == s for r in rows) for s in range(3)), reverse=True)
        whole_ = sum(len(set(x)) == 1 for x in at.values())
        best = best_whole(sizes, quotas)
        assert whole_ <= best
        short, groups_ = short + best - whole_, groups_ + best
        edges += sum(len(x) for x in at.values() if len(x) > 1)
        cut += sum(len(x) - max(map(x.count, x)) for x in at.values())
    print("whole groups short of the best:", short, "of", groups_, "edges cut:", cut, "of", edges)
    assert short <= groups_ // 4 and cut <= edges // 4
