import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stemma.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit(lengths):
    """Each piece goes to the tightest open window, as a plain search finds it."""
    sequence, offset, made = P.best_fit_decreasing(lengths, 64)
    free, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [f for f in free if f >= lengths[i]]
        want[i] = min(fits) if fits else 64
        if fits:
            free.remove(want[i])
        free.append(want[i] - lengths[i])
    assert [64 - o for o in offset] == [want[i] for i in range(len(lengths))]
    assert made == len(free)
    used = defaultdict(list)
    for s, o, n in zip(sequence, offset, lengths, strict=True):
        used[s].append((o, n))
    for pieces in used.values():
        assert sum(n for _, n in pieces) <= 64
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n


TEXTS = ["", None, "one two", "one two", "Hello, World. It's <|endoftext|>. İstanbul É, x., ...,. 12.", "word " * 9000, "q" * 300, " \n\t ", "don't. WON'T, a.b, <|ENDOFTEXT|>."]


def test_pack(spark, make_docs):
    tokenizer = Tokenizer.from_file(P.default_tokenizer())
    rows = P.pack(make_docs([*TEXTS, (None, "null id")]).repartition(2), P.default_tokenizer()).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == {*range(len(TEXTS)), None}
    for i, text in [*enumerate(TEXTS), (None, "null id")]:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert list(r.ids) == ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= P.WINDOW


def test_rounds_are_bounded(monkeypatch, make_docs):
    monkeypatch.setattr(P, "PACK_DOCS", 2)
    assert P.pack(make_docs(TEXTS), P.default_tokenizer(), with_ids=False).count() >= len(TEXTS)


def test_no_rows(make_docs):
    assert P.pack(make_docs([]), P.default_tokenizer()).count() == 0


@pytest.mark.parametrize("name", ["op1_packing"])
def test_query_has_all_ids(spark, small, name):
    out = P.op1_packing(spark, small).toPandas()
    total = out.groupby("doc_id").agg(n=("length", "sum"), want=("doc_tokens", "first"))
    assert (total.n == total.want).all() and len(total) == 200
    used = out.groupby("sequence_id").length.sum()
    assert used.max() <= P.WINDOW and used.sum() / (len(used) * P.WINDOW) > 0.95


ODD = ["a", "B", "é", "É", "×", "÷", "ß", "İ", "'s", "'", "don't", "l'été", "<|endoftext|>", "<", "1", "23", " ", "\n", " ", "　", "日本語", "ｶﾞ", "é", "́", ".", ",", "!!!", "\x00", "\x1c", "\x85", "Ω", "ſ", "ﬁ", "🙂", "x" * 40, "É" * 20, "-" * 50, "\t", "ª", "²", "_", "The", "of"]


@pytest.mark.parametrize("clashes", [False, True])
def test_pieces(monkeypatch, clashes):
    """Ids are those of the tokenizer, though pieces share hashes, the cache is small and texts are cut."""
    import random

    monkeypatch.setattr(P, "CACHE_PIECES", 60)
    monkeypatch.setattr(P, "PART_BYTES", 300)
    if clashes:
        monkeypatch.setattr(P, "_hash", lambda h, key: (h + key) % np.uint64(50))
    r = random.Random(5)
    texts = ["", "  ", *("".join(r.choice(ODD) for _ in range(r.randrange(n))) for n in (3, 12, 60, 400) for _ in range(100))]
    made = P.PieceIds(P.default_tokenizer())
    whole = Tokenizer.from_file(P.default_tokenizer())
    got = [np.frombuffer(x, "<u4").tolist() for k in range(0, len(texts), 7) for x in made.of([t.encode() for t in texts[k : k + 7]])]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("splits", [1, 16, 211])
def test_fill_by_splits(spark, splits):
    """Many small input splits waste no more windows than one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(splits)
    rows = P.pack(docs, P.default_tokenizer(), with_ids=False)
    tokens, windows = rows.selectExpr("sum(length)", "count(distinct sequence_id)").first()
    assert tokens / windows / P.WINDOW > 0.95
