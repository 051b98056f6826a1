import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.llm import toxicity as X
from stemma.llm.words import word_list


def test_gradients_are_right():
    net = X.Network(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    words, index, first = X.read([b"one two three four", b"five six", b"seven"])
    ids, _ = X.windows(index, first)
    y, weight = np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])

    def loss():
        q = X._sigmoid(net.logits(words, ids))
        return -(weight * (y * np.log(q) + (1 - y) * np.log(1 - q))).mean()

    g = net.gradients(words, ids, y, weight)
    r = np.random.default_rng(1)
    for name, p in net.p.items():
        flat, grad = p.reshape(-1), g[name].reshape(-1)
        for i in r.choice(np.flatnonzero(grad), min(5, np.count_nonzero(grad)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            down = loss()
            flat[i] = old
            assert grad[i] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=1e-6), name


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 112, 113, 500])
def test_windows_cover_all_words(n):
    words, index, first = X.read([b"w " * n, b"other"])
    ids, text = X.windows(index, first)
    own = ids[text == 0]
    assert len(words.word) == (2 if n else 1)
    assert (own >= 0).sum() >= n
    covered = {k * X.STRIDE + j for k in range(len(own)) for j in np.flatnonzero(own[k] >= 0)}
    assert covered == set(range(n))


def test_parts_read_as_one():
    texts = [b"the cat sat", b"", b"the dog", "é É x".encode()] * 5
    a, b = X.read(texts), X.read(texts, size=8)
    assert (a[2] == b[2]).all()
    assert (a[0].word[a[1]] == b[0].word[b[1]]).all() and (a[0].chars[a[1]] == b[0].chars[b[1]]).all()
    assert np.diff(a[2]).tolist() == [len(word_list(t)) for t in texts]


def corpus(n, seed):
    r = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re", "so") for b in ("lan", "dor", "vex", "pim", "gul")]
    texts, labels = [], []
    for _ in range(n):
        ws = [r.choice(plain) for _ in range(r.choice((20, 80, 300)))]
        bad = r.random() < 0.3
        if bad:
            for _ in range(r.randrange(1, 4)):
                ws[r.randrange(len(ws))] = r.choice(["vile", "scoundrel", "zzag" + r.choice(plain)])  # the stem counts, with any ending
        texts.append(" ".join(ws))
        labels.append(int(bad))
    return texts, labels


def test_held_out_accuracy():
    texts, labels = corpus(700, 1)
    net = X.train([t.encode() for t in texts], labels)
    unseen, truth = corpus(300, 2)
    got = X.scores(net, [t.encode() for t in unseen])
    assert ((got >= X.THRESHOLD) == np.array(truth)).mean() > 0.95
    # each text is scored by itself
    assert np.allclose(got[:20], [X.scores(net, [t.encode()])[0] for t in unseen[:20]], atol=1e-4)
    # one bad word at the end of a very long text is seen
    long_ = (unseen[truth.index(0)] + " ") * 60
    a, b = X.scores(net, [long_.encode(), (long_ + "vile scoundrel").encode()])
    assert a < X.THRESHOLD <= b


def test_odd_inputs(spark, make_docs):
    texts, labels = corpus(200, 3)
    net = X.train([t.encode() for t in texts], labels)
    rows = X.score_documents(make_docs(["", None, "!!", "vile scoundrel", (None, "x"), (3, "vile scoundrel")]), net).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert [r.score for r in rows[:3]] == [0, 0, 0]
    assert X.train([], []) is None and X.train([b"a"], [1]) is None and X.train([b"", b""], [0, 1]) is None
    assert X.score_documents(make_docs(["a"]), None).first().score == 0
    assert X.score_documents(make_docs([]), net).count() == 0


def test_only_some_labels_are_learnt(spark, make_docs):
    texts, labels = corpus(120, 4)
    docs = make_docs(texts)
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - y) for i, y in enumerate(labels)]
    nets = [X.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int")) for rows in (list(enumerate(labels)), flipped)]
    assert all((nets[0].p[k] == nets[1].p[k]).all() for k in nets[0].p)


def test_query(spark, small):
    rows = X.op9_toxicity(spark, small).collect()
    assert len(rows) == 200
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_logits_as_plain_loops():
    """The network's output, word by word and unit by unit, without numpy's products."""
    import math

    net = X.Network(3)
    words, index, first = X.read([b"you are a very bad word", b"fine"])
    ids, _ = X.windows(index, first)
    got = net.logits(words, ids)
    p, H, sigmoid = {k: v.astype(float).tolist() for k, v in net.p.items()}, X.HIDDEN, lambda x: 1 / (1 + math.exp(-x))
    dot = lambda x, m: [sum(x[i] * m[i][j] for i in range(len(x))) for j in range(len(m[0]))]
    for row, want in zip(ids, got, strict=True):
        x = []
        for w in row[row >= 0]:
            rows = [c for c in words.chars[w] if c >= 0]
            chars = [sum(p["char"][c][j] for c in rows) / max(1, len(rows)) for j in range(X.DIM)]
            x.append([a + b for a, b in zip(dot(p["word"][words.word[w]] + chars, p["W"]), p["b"], strict=True)])
        states = []
        for k, U in enumerate((p["Uf"], p["Ub"])):
            h, out = [0.0] * H, {}
            for t in range(len(x))[:: -1 if k else 1]:
                a, g = x[t][3 * H * k : 3 * H * (k + 1)], dot(h, U)
                z, r = ([sigmoid(a[s + j] + g[s + j]) for j in range(H)] for s in (0, H))
                new = [math.tanh(a[2 * H + j] + r[j] * g[2 * H + j]) for j in range(H)]
                h = [h[j] + (1 - z[j]) * (new[j] - h[j]) for j in range(H)]
                out[t] = h
            states.append([out[t] for t in range(len(x))])
        s = [f + b for f, b in zip(*states, strict=True)]
        e = [math.exp(sum(math.tanh(a) * v for a, v in zip(dot(h, p["A"]), p["v"], strict=True))) for h in s]
        pooled = [sum(e[t] * s[t][j] for t in range(len(s))) / sum(e) for j in range(2 * H)]
        assert abs(sum(a * b for a, b in zip(pooled, p["o"], strict=True)) + p["c"][0] - want) < 1e-4


def test_query_on_held_out_documents(spark):
    """Accuracy on the given documents whose labels are never learnt."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = X.op9_toxicity(spark, d).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 900
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.95
    both = sum(r.predicted and r.toxic for r in rows)
    assert 2 * both / sum(r.predicted + r.toxic for r in rows) > 0.85


def test_the_sample_is_bounded_in_bytes(monkeypatch, make_docs, prose):
    """Texts that take too much room are passed over, and the others learnt from."""
    monkeypatch.setattr(X, "CLEAN_BYTES", 20_000)
    monkeypatch.setattr(X, "TOXIC_BYTES", 20_000)
    seen = []
    monkeypatch.setattr(X, "train", lambda texts, labels: seen.append((texts, labels)))
    docs = make_docs([(i, prose(20, i) if i % 5 else prose(600, i)) for i in range(200)])
    labels = docs.selectExpr("doc_id", "doc_id % 2 as toxic")
    X.fit(docs, labels)
    texts, toxic = seen[0]
    assert 10_000 < sum(map(len, texts)) <= 40_000 and max(map(len, texts)) <= 20_000 / 16 and set(toxic) == {0, 1}
