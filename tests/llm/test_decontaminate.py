import duckdb

from stemma.llm import decontaminate as D
from stemma.llm.words import word_list


def grams(text, n):
    ws = word_list((text or "").encode())
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def brute(docs, items, threshold=D.THRESHOLD):
    out = set()
    for i, item in items:
        n = min(D.SHINGLE, len(word_list((item or "").encode())))
        want = grams(item, n) if n else set()
        for d, text in docs:
            shared = len(want & grams(text, n)) if want else 0
            if want and shared >= threshold * len(want):
                out.add((d, i, round(shared / len(want), 9)))
    return out


def found(docs, items, **options):
    rows = D.find_contained(docs, items, **options).collect()
    return [(r.doc_id, r.item_id, round(r.containment, 9)) for r in rows]


def test_same_as_brute_force(spark, make_docs, prose, monkeypatch):
    items = [(i, prose(n, 50 + i)) for i, n in enumerate((5, 6, 9, 20, 60, 300))] + [(90, "only three words"), (91, ""), (92, None), (93, "--"), (None, prose(12, 77))]
    docs = [(k, f"{prose(200, k)}. {text or ''}, {prose(100, 900 + k)}") for k, (_, text) in enumerate(items)]
    for k, share in enumerate((0.95, 0.85, 0.8, 0.75, 0.5)):  # only a part of a long item
        ws = items[5][1].split()
        docs.append((100 + k, prose(30, 500 + k) + " " + " ".join(ws[: int(len(ws) * share)]) + " " + prose(30, 600 + k)))
    docs += [(200, ""), (201, None), (202, items[4][1].upper()), (203, "x " * 50_000 + items[3][1]), (204, items[3][1]), (204, items[3][1])]
    table = spark.createDataFrame([*items, items[2]], "item_id long, text string")
    want = brute(docs, items)
    got = found(make_docs(docs), table)
    assert set(got) == want and len(got) == len(want) + 1  # the repeated document
    monkeypatch.setattr(D, "PASS_BYTES", 300)  # several passes
    assert sorted(map(str, found(make_docs(docs), table))) == sorted(map(str, got))
    kept = D.decontaminate(make_docs(docs), table).collect()
    assert {r.doc_id for r in kept} == {d for d, _ in docs} - {d for d, _, _ in want}


def test_nothing(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(make_docs(["a b c"]), none) == []
    assert D.decontaminate(make_docs(["a b c"]), none).count() == 1
    assert found(make_docs([]), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")) == []


def test_query(spark, small):
    read = lambda t, c: duckdb.sql(f"SELECT {c}, text FROM read_parquet('{small}/{t}.parquet')").fetchall()
    got = {(r.doc_id, r.item_id, round(r.containment, 9)) for r in D.op7_decontamination(spark, small).collect()}
    assert got == brute(read("documents", "doc_id"), read("benchmark", "item_id"))
