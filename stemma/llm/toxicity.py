"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.llm.common import discard, narrowed, short_batches, slices, staged, table, text_bytes, tidy
from stemma.llm.words import _IS_WORD, lowered, mix, prefix_hashes, range_hashes

#: Bound of the training sample: labelled rows of either class, and bytes of their texts.
TOXIC_ROWS, CLEAN_ROWS = 2000, 4000
TOXIC_BYTES, CLEAN_BYTES = 8 << 20, 16 << 20
#: Windows that are scored together.
SCORED = 1024
#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 48
THRESHOLD = 0.3
WORD_ROWS, CHAR_ROWS, DIM, HIDDEN = 1 << 14, 1 << 16, 8, 8
PREFIXES, SUFFIXES = range(2, 9), range(2, 5)
EPOCHS, BATCH, RATE, SEED = 6, 256, 0.01, 7


class Vocabulary(NamedTuple):
    """The distinct words of some texts: row of the word table, rows of the character table (-1: none)."""

    word: np.ndarray
    chars: np.ndarray


def read(texts: list[bytes], size: int = 1 << 20) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """Vocabulary, the words of all texts as indices into it, and for each text its first word (one more at the end).

    Texts are read in parts of about `size` bytes, whose vocabularies are put together.
    """
    parts, part, total = [], [], 0
    for t in texts:
        part.append(t)
        total += len(t)
        if total >= size:
            parts.append(_read(part))
            part, total = [], 0
    if part or not parts:
        parts.append(_read(part))
    if len(parts) == 1:
        return parts[0][1:]
    known, at, new = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    del known
    words = Vocabulary(np.concatenate([p[1].word for p in parts])[at], np.concatenate([p[1].chars for p in parts])[at])
    shift = np.cumsum([0, *(len(p[0]) for p in parts)])
    index = np.concatenate([new[shift[k] : shift[k + 1]][p[2]] for k, p in enumerate(parts)])
    begin = np.cumsum([0, *(len(p[2]) for p in parts)])
    first = np.concatenate([*(p[3][:-1] + b for p, b in zip(parts, begin, strict=False)), begin[-1:]])
    return words, index.astype(np.int32), first


def _read(texts: list[bytes]) -> tuple[np.ndarray, Vocabulary, np.ndarray, np.ndarray]:
    low = lowered(texts)
    raw = np.frombuffer(b" ".join(low) + b" ", np.uint8)
    inside = _IS_WORD[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    sums = prefix_hashes(raw)
    hashes = mix(range_hashes(sums, start, end) + (end - start).astype(np.uint64))
    known, at, index = np.unique(hashes, return_index=True, return_inverse=True)
    start, size = start[at], (end - start)[at]
    chars = np.full((len(known), len(PREFIXES) + len(SUFFIXES)), -1, np.int32)
    for j, (n, tail) in enumerate([(n, False) for n in PREFIXES] + [(n, True) for n in SUFFIXES]):
        has = np.flatnonzero(size >= n)
        a = start[has] + (size[has] - n if tail else 0)
        salt = np.uint64(2 * n + tail)
        chars[has, j] = (mix(range_hashes(sums, a, a + n) + salt) % np.uint64(CHAR_ROWS)).astype(np.int32)
    ends = np.cumsum([len(x) + 1 for x in low]) if texts else np.zeros(0, np.int64)
    first = np.searchsorted(edge[::2], np.concatenate([[0], ends]))
    return known, Vocabulary((known % np.uint64(WORD_ROWS)).astype(np.int32), chars), index.reshape(-1), first


def windows(index: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows (words, -1 beyond a text's end), and their texts. A text without words has none."""
    size = np.diff(first)
    count = np.where(size > 0, np.maximum(1, -(-(size - (WINDOW - STRIDE)) // STRIDE)), 0)
    text = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    out = np.full((len(text), WINDOW), -1, np.int32)
    for i in range(0, len(text), 8192):
        t = text[i : i + 8192]
        at = k[i : i + 8192, None] * STRIDE + np.arange(WINDOW)
        here = at < size[t][:, None]
        out[i : i + 8192][here] = index[(first[t][:, None] + at)[here]]
    return out, text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """x = [word vector, mean of the vectors of its prefixes and suffixes] -> GRU both ways -> attention -> logit."""

    def __init__(self, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        normal = lambda scale, *shape: (scale * r.standard_normal(shape)).astype(np.float32)
        self.p = {
            "word": normal(0.1, WORD_ROWS, DIM),
            "char": normal(0.1, CHAR_ROWS, DIM),
            "W": normal(0.3, 2 * DIM, 6 * HIDDEN),
            "b": np.zeros(6 * HIDDEN, np.float32),
            "Uf": normal(0.3, HIDDEN, 3 * HIDDEN),
            "Ub": normal(0.3, HIDDEN, 3 * HIDDEN),
            "A": normal(0.3, 2 * HIDDEN, HIDDEN),
            "v": normal(0.3, HIDDEN),
            "o": normal(0.3, 2 * HIDDEN),
            "c": np.zeros(1, np.float32),
        }
        self.top = np.zeros(3)  # of the features of a document

    def vectors(self, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        has = words.chars >= 0
        share = (has / np.maximum(has.sum(1), 1)[:, None]).astype(np.float32)
        chars = np.einsum("ijk,ij->ik", self.p["char"][words.chars], share)
        return np.hstack([self.p["word"][words.word], chars]), share

    def _scan(self, x: np.ndarray, live: np.ndarray, U: np.ndarray, back: bool, keep: list | None) -> np.ndarray:
        """The states of one direction, (steps, windows, HIDDEN)."""
        steps, n = x.shape[:2]
        h, out, H = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32), HIDDEN
        for t in range(steps)[:: -1 if back else 1]:
            g = h @ U
            gates = _sigmoid(x[t, :, : 2 * H] + g[:, : 2 * H])
            z, r = gates[:, :H], gates[:, H:]
            new = np.tanh(x[t, :, 2 * H :] + r * g[:, 2 * H :])
            if keep is not None:
                keep.append((t, h, z, r, new, g[:, 2 * H :]))
            # a dead step keeps the state
            h = h + live[t] * (1 - z) * (new - h)
            out[t] = h
        return out

    def logits(self, words: Vocabulary, ids: np.ndarray, tape: dict | None = None) -> np.ndarray:
        p, H = self.p, HIDDEN
        x, share = self.vectors(words)
        table = x @ p["W"] + p["b"]
        at = ids.T
        live = (at >= 0)[:, :, None].astype(np.float32)
        keep = ([], []) if tape is not None else (None, None)
        f = self._scan(table[:, : 3 * H][at], live, p["Uf"], False, keep[0])
        b = self._scan(table[:, 3 * H :][at], live, p["Ub"], True, keep[1])
        s = np.concatenate([f, b], 2)
        a = np.tanh(s @ p["A"])
        e = np.where(live[:, :, 0] > 0, a @ p["v"], -1e9)
        e = np.exp(e - e.max(0))
        w = e / e.sum(0)
        pooled = np.einsum("tn,tnh->nh", w, s)
        if tape is not None:
            tape.update(x=x, share=share, at=at, live=live, keep=keep, s=s, a=a, w=w, pooled=pooled)
        return pooled @ p["o"] + p["c"]

    def gradients(self, words: Vocabulary, ids: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy of these windows."""
        p, H, tape = self.p, HIDDEN, {}
        d = (weight * (_sigmoid(self.logits(words, ids, tape)) - label) / len(ids)).astype(np.float32)
        s, a, w, at, live = (tape[k] for k in ("s", "a", "w", "at", "live"))
        g = {"o": tape["pooled"].T @ d, "c": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * p["o"]
        dw = np.einsum("tnh,nh->tn", s, dpool)
        de = w * (dw - (w * dw).sum(0))
        g["v"] = np.einsum("tn,tnh->h", de, a)
        da = de[:, :, None] * p["v"] * (1 - a * a)
        g["A"] = np.einsum("tnh,tnk->hk", s, da)
        ds = w[:, :, None] * dpool + da @ p["A"].T
        dx = np.zeros((*at.shape, 6 * H), np.float32)
        for k, (name, part) in enumerate((("Uf", ds[:, :, :H]), ("Ub", ds[:, :, H:]))):
            U, dU, dh = p[name], np.zeros_like(p[name]), np.zeros((at.shape[1], H), np.float32)
            for t, before, z, r, new, gn in reversed(tape["keep"][k]):
                dh = dh + part[t]
                on = live[t] * dh
                dnew = on * (1 - z) * (1 - new * new)
                dz = on * (before - new) * z * (1 - z)
                dr = dnew * gn * r * (1 - r)
                dg = np.hstack([dz, dr, dnew * r])
                dx[t, :, 3 * H * k : 3 * H * (k + 1)] = np.hstack([dz, dr, dnew])
                dU += before.T @ dg
                dh = dh - on * (1 - z) + dg @ U.T
            g[name] = dU
        flat = dx[at >= 0]
        rows = np.zeros((len(words.word), 6 * H), np.float32)
        np.add.at(rows, at[at >= 0], flat)
        g["W"], g["b"] = tape["x"].T @ rows, rows.sum(0)
        dvec = rows @ p["W"].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], words.word, dvec[:, :DIM])
        has = words.chars >= 0
        np.add.at(g["char"], words.chars[has], (tape["share"][:, :, None] * dvec[:, None, DIM:])[has])
        return g

    def all_logits(self, words: Vocabulary, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([self.logits(*_subset(words, ids[i : i + SCORED])) for i in range(0, len(ids), SCORED)] or [np.zeros(0)])


def features(logit: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Of each text: its highest window, the mean of its three highest, and 1. Texts without windows have zeros."""
    out = np.zeros((texts, 3))
    order = np.lexsort((-logit, text))
    s, t = logit[order], text[order]
    first = np.searchsorted(t, np.arange(texts + 1))
    has = np.flatnonzero(np.diff(first))
    out[has, 0] = s[first[has]]
    rank = np.arange(len(t)) - first[t]
    three = rank < 3
    out[:, 1] = np.bincount(t[three], s[three], texts) / np.maximum(np.bincount(t[three], minlength=texts), 1)
    out[has, 2] = 1
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = _sigmoid(x @ w)
        w += np.linalg.solve((x * (q * (1 - q) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - q) - ridge * w)
    return w


def _subset(words: Vocabulary, ids: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
    used, new = np.unique(ids, return_inverse=True)
    new = new.reshape(ids.shape)
    if used[0] < 0:
        used, new = used[1:], new - 1
    return Vocabulary(words.word[used], words.chars[used]), new


def _log_odds(seen: np.ndarray, label: np.ndarray) -> np.ndarray:
    """How much likelier rows of a table are in toxic documents; seen (2, rows): in how many clean and toxic ones."""
    prior = label.mean()
    return np.log((seen[1] + 2 * prior) / (seen[0] + 2 * (1 - prior))) - np.log(prior / (1 - prior))


def _seen(rows: np.ndarray, doc: np.ndarray, label: np.ndarray, size: int) -> np.ndarray:
    """In how many clean and toxic documents each row of a table is. -1: no row."""
    out = np.zeros((2, size))
    for column in rows.T:
        has = column >= 0
        key = np.unique(doc[has].astype(np.int64) * size + column[has])
        for c in (0, 1):
            out[c] += np.bincount(key[label[key // size] == c] % size, minlength=size)
    return out


def train(texts: list[bytes], labels: list[int], seed: int = SEED, informed: bool = True, epochs: int = EPOCHS) -> Network | None:
    """Fit the network on whole labelled texts; None unless both classes are there.

    A text's label is that of its most suspicious window: each epoch scores all windows, and learns from the
    highest of each text, and from one more of each clean text. The first component of both tables starts as
    log-odds (unless `informed` is off: all of both is random then). A quarter of the texts only serves to weigh
    the windows of a document.
    """
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return None
    r = np.random.default_rng(seed)
    words, index, first = read(texts)
    tidy()
    ids, text = windows(index, first)
    if not len(ids):
        return None
    net = Network(seed)
    learn = r.random(len(y)) >= 0.25
    for c in (0, 1):
        if not learn[y == c].any():
            learn[np.flatnonzero(y == c)[0]] = True
    seen_word, seen_char = np.zeros((2, WORD_ROWS)), np.zeros((2, CHAR_ROWS))
    for i in range(0, len(y), 500):  # by some documents at a time, as all their words at once would take much memory
        j = min(i + 500, len(y))
        doc = np.repeat(np.arange(i, j), np.diff(first[i : j + 1]))
        once = np.unique((doc * len(words.word) + index[first[i] : first[j]])[learn[doc]])  # a text's distinct words
        doc, word = once // len(words.word), once % len(words.word)
        seen_word += _seen(words.word[word][:, None], doc, y, WORD_ROWS)
        seen_char += _seen(words.chars[word], doc, y, CHAR_ROWS)
    del index
    if informed:
        net.p["word"][:, 0] = 0.3 * _log_odds(seen_word, y)
        net.p["char"][:, 0] = 0.3 * _log_odds(seen_char, y)
    odd = np.concatenate([net.vectors(Vocabulary(*(x[i : i + 50_000] for x in words)))[0][:, [0, DIM]].sum(1) for i in range(0, len(words.word), 50_000)])
    odd = np.append(np.maximum(odd, 0).astype(np.float32), np.float32(0))  # the last for -1
    score = np.concatenate([np.partition(odd[ids[i : i + 4096]], WINDOW - 3, 1)[:, -3:].sum(1) for i in range(0, len(ids), 4096)])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, rare = 0, min(4.0, (1 - y[learn].mean()) / y[learn].mean())
    weight = np.where(y == 1, rare, 1.0)
    for _ in range(epochs):
        order = np.lexsort((-score, text))
        best = order[np.searchsorted(text[order], np.unique(text))]
        extra = r.permutation(len(text))[: len(y)]
        chosen = np.concatenate([best, extra[y[text[extra]] == 0]])
        chosen = r.permutation(chosen[learn[text[chosen]]])
        for i in range(0, len(chosen), BATCH):
            at = chosen[i : i + BATCH]
            own, new = _subset(words, ids[at])
            step += 1
            for k, g in net.gradients(own, new, y[text[at]], weight[text[at]]).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        score = net.all_logits(words, ids)
    x = features(score, text, len(y))
    weigh = ~learn if (y[~learn].min(initial=1) == 0 and y[~learn].max(initial=0) == 1) else learn
    net.top = _logistic(x[weigh], y[weigh])
    return net


def scores(net: Network | None, texts: list[bytes]) -> np.ndarray:
    """Of whole texts, from all their windows. Texts without words, and all without a network, score 0."""
    out = np.zeros(len(texts))
    if net is None:
        return out
    words, index, first = read(texts)
    ids, text = windows(index, first)
    if len(ids):
        x = features(net.all_logits(words, ids), text, len(texts))
        has = np.diff(first) > 0
        out[has] = _sigmoid(x[has] @ net.top)
    return out


def held_out(doc_id: F.Column) -> F.Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Network | None:
    """Train on labels(doc_id, toxic) of at most so many rows of either class, the first by a hash of doc_id.

    Their texts, which come to the driver whole, are bounded in bytes too: from the first on, while they fit,
    where a text that takes more than a sixteenth of the room is passed over.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pick = lambda c, n: known.where(F.col("toxic") == c).orderBy(*order).limit(n)
    sample = F.broadcast(pick(1, toxic_rows).unionByName(pick(0, clean_rows)))  # at most toxic_rows + clean_rows rows
    rows = narrowed(docs, "doc_id", "text").join(sample, "doc_id").withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    rows = staged(rows, "labelled")
    room = F.when(F.col("toxic") == 1, TOXIC_BYTES).otherwise(CLEAN_BYTES)
    total = rows.groupBy("doc_id", "toxic").agg(F.sum("size").alias("size")).where(F.col("size") <= room / 16)
    upto = F.sum("size").over(W.partitionBy("toxic").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))  # a row a sampled id
    chosen = F.broadcast(total.withColumn("upto", upto).where(F.col("upto") <= room).select("doc_id"))  # at most toxic_rows + clean_rows rows
    found = rows.join(chosen, "doc_id").orderBy("doc_id", "text").select("text", "toxic").toArrow()
    discard(rows)
    texts = [x.encode() if x else b"" for x in found.column("text").to_pylist()]
    toxic = [int(x) for x in found.column("toxic").to_pylist()]
    del found
    net = train(texts, toxic)
    del texts
    tidy()
    return net


def score_documents(docs: DataFrame, net: Network | None) -> DataFrame:
    """documents(doc_id, text) -> doc_id, score: every whole text, window by window, where it is read.

    Null and empty texts score 0. Repeated rows are scored each; a null doc_id stays null. No rows: no rows.
    """
    short_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(net, text_bytes(b)))], ["doc_id", "score"])
        tidy()

    source = narrowed(docs, "doc_id", "text")
    return source.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")


def drop_toxic(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all their columns, that score less than the threshold."""
    short_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(scores(net, text_bytes(b)) < threshold))
        tidy()

    return docs.mapInArrow(keep, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
