import duckdb

import corpus_pipeline as P
from stemma.llm import toxicity


def test_stages(spark, small, make_docs, prose, tmp_path):
    """Each stage does what it should to planted cases, keeps clean documents, and returns the columns it got."""
    item = duckdb.sql(f"SELECT text FROM read_parquet('{small}/benchmark.parquet') LIMIT 1").fetchall()[0][0]
    base = prose(150, 1)
    near = base.split()
    near[70] = "other"
    clean = [prose(120, 10 + k) for k in range(6)]
    docs = make_docs([(0, base), (1, base), (2, " ".join(near)), (3, prose(50, 3) + " " + item + " " + prose(50, 4)), (4, "write to a@b.org now"), (5, None), (6, ""), *enumerate(clean, 10), (None, "no id")])
    out = P.drop_near_duplicates(spark, docs, small)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {0, 3, 4, 5, *range(10, 16), None}
    own = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    values = lambda df: {r.doc_id: [r[c] for c in own] for r in df.collect()}
    assert values(out) == {i: v for i, v in values(docs).items() if i in (0, 3, 4, 5, *range(10, 16), None)}
    out = P.drop_contaminated(spark, docs, small)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {0, 1, 2, 4, 5, 6, *range(10, 16), None}
    out = P.redact(spark, docs, small)
    assert out.columns == docs.columns and out.count() == docs.count() and values(out) == values(docs)
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()}[4] == ("write to [EMAIL] now", 20)
    out = P.drop_toxic(spark, docs, small)
    assert out.columns == docs.columns
    net = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    want = {r.doc_id for r in toxicity.score_documents(docs, net).collect() if r.score < 0.3}
    assert {r.doc_id for r in out.collect()} == want
    for _, stage in P.STAGES:
        stage(spark, docs.limit(0), small).collect()


def test_run(spark, small):
    rows = P.run(spark, small).collect()
    docs = {r.doc_id for r in rows}
    assert 100 < len(docs) < 200
    for i in list(docs)[:20]:
        own = sorted((r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == i)
        assert sum(n for _, n, _ in own) == own[0][2]


def test_stages_are_in_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
