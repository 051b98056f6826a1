"""SimHash classes against comparing every fingerprint with every other."""

import random
import re

import numpy as np
import pytest
import xxhash

from stemma.llm import simhash as S


def fingerprint(text, shingle=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows, distance=4):
    """(doc_id, fingerprint, component_id) of each row, by all pairs."""
    prints = [fingerprint(t) for _, t in rows]
    part = list(range(len(rows)))

    def top(k):
        while part[k] != k:
            k = part[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((top(i), top(j)))
                part[b] = a
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i if i is not None else -1), f"{p:016x}", least.get(top(k))) for k, ((i, _), p) in enumerate(zip(rows, prints, strict=True)))


def got(docs):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect())


def test_documents(make_docs, prose):
    r = random.Random(3)
    rows = []
    for k in range(12):
        text = prose(r.choice([30, 200, 600]), k).split()
        for c in range(r.randrange(1, 8)):
            copy = list(text)
            for _ in range(c):
                copy[r.randrange(len(copy))] = f"new{r.randrange(99)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(100, ""), (101, None), (102, " \t\r\n\x0b\x0c"), (103, "one"), (104, "ONE"), (105, "Three short words"), (106, "three  short\twords"), (107, "Éa b c d e"), (None, rows[0][1]), (None, "alone here with nobody near"), (5, rows[5][1]), (5, rows[0][1]), (110, "a b c d " * 50_000)]
    want = classes(rows)
    assert len({c for *_, c in want}) > 10
    assert got(make_docs(rows).repartition(4)) == want


def test_no_documents(make_docs):
    assert got(make_docs([])) == []
    assert got(make_docs([(7, None)])) == [(7, "0" * 16, 7)]


@pytest.mark.parametrize("pairwise", [2, 5, 2048])
def test_links(spark, pairwise):
    """Chains, dense balls and hardly linked prints, by comparisons and by common neighbours."""
    r = random.Random(pairwise)
    some = lambda n: sum(1 << b for b in r.sample(range(64), n))
    prints = set()
    for _ in range(10):
        p = r.getrandbits(64)
        for _ in range(12):
            prints.add(p)
            p ^= some(r.choice([1, 4, 4, 5]))
    ball = r.getrandbits(64)
    prints |= {ball ^ some(k % 4) for k in range(60)} | {0, (1 << 64) - 1, 1, 1 << 63}
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").repartition(3)
    edges = [(e.u % (1 << 64), e.v % (1 << 64)) for e in S.links(frame, pairwise=pairwise).collect()]

    def grouped(pairs):
        part = {p: p for p in prints}

        def top(p):
            while part[p] != p:
                p = part[p]
            return p

        for a, b in pairs:
            part[top(a)] = top(b)
        sets = {}
        for p in prints:
            sets.setdefault(top(p), set()).add(p)
        return sorted(map(sorted, sets.values()))

    assert grouped(edges) == grouped((a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4)


def test_many_shingles_at_once():
    """Counts add up over parts of a long text."""
    text = " ".join(f"w{k % 977}" for k in range(3000)).encode()
    assert S.fingerprints([text, b"", text], most=100).tolist() == S.fingerprints([text, b"", text]).tolist() == [fingerprint(text.decode()), 0, fingerprint(text.decode())]


def test_blocks_cover():
    """However four bits are chosen, some choice of blocks has none of them."""
    cuts = [64 * i // S.BLOCKS for i in range(S.BLOCKS + 1)]
    block = np.searchsorted(cuts, np.arange(64), "right")
    assert len(set(block)) == S.BLOCKS and S.BLOCKS > S.DISTANCE
