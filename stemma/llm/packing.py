"""Packing token sequences: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from stemma.llm.common import estimated_bytes, narrowed, short_batches, slices, table, text_bytes, tidy
from stemma.llm.words import mix

WINDOW = 4096
END = 2
#: Documents (and tokens) that are packed together. A task holds no more than this, whatever its input: 32 MB of ids.
PACK_DOCS, PACK_TOKENS = 65_536, 1 << 23
#: Pieces that a worker keeps with their ids (about 80 bytes each), and the longest in bytes; a multiple of 8.
CACHE_PIECES, WIDTH = 1 << 18, 32
#: Bytes of text whose pieces are looked up together.
PART_BYTES = 1 << 20
#: Bytes of input that a task should have at least, so that its last windows, which stay short, are few.
TASK_BYTES = 8 << 20
_BLANK = re.compile(rb"[\t-\r ]")
_ODD = np.uint64(0xD1342543DE82EF95)


class CapacityTree:
    """A segment tree over remaining capacity: which open window fits most tightly?

    Leaf c stands for the open windows with c free places; an inner node counts the windows below it.
    """

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, free: int, window: int) -> None:
        self.open.setdefault(free, []).append(window)
        i = free + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (free places, window) of the tightest window that holds `need`, or None."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until a sibling to the right has windows
                i >>= 1
            if i == 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        free, j = i - self.leaves, i
        while j:
            count[j] -= 1
            j >>= 1
        return free, self.open[free].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Sequence and offset of each piece, and the number of sequences. Ties keep their order."""
    tree = CapacityTree(window)
    sequence, offset, made = [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        found = tree.take(n) if n < window else None
        free, s = found or (window, made)
        made += found is None
        sequence[i], offset[i] = s, window - free
        if free > n:
            tree.add(free - n, s)
    return sequence, offset, made


class PieceIds:
    """Token ids of texts, piece by piece, in columns.

    The tokenizer cuts texts into runs of letters, single digits and runs of other marks, and no token spans
    two of them, so the ids of a text are those of its pieces in a row. Pieces come again and again: each
    distinct one is encoded once, and looked up by a hash of its bytes and then by the bytes themselves.

    A word (between ASCII white space) with an apostrophe, "<" or a character that may need another form is
    one piece as it stands, which the whole tokenizer encodes. Pieces beyond WIDTH bytes are not kept.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # For pieces that are in lower case and cut already; each ends with a token that ends a word.
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # of the known pieces, sorted
        self.entry = np.zeros(0, np.int64)
        self.keys = np.zeros((0, WIDTH // 8), np.uint64)  # by entry: their bytes
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids of each text."""
        out, small, size = [], [], 0
        for t in texts:
            if small and size + len(t) > PART_BYTES:
                out += self._ids(small)
                small, size = [], 0
            if len(t) > PART_BYTES:
                out.append(b"".join(x for part in _parts(t) for x in self._ids([part])))
            else:
                small.append(t)
                size += len(t)
        return out + self._ids(small) if small else out

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        joined = b" ".join(texts) + b" " * (WIDTH + 8)
        low, start, end, hard = _pieces(joined)
        size = end - start
        eight = np.ndarray((len(joined) - 7,), "<u8", low, strides=(1,))
        keys = np.empty((len(start), WIDTH // 8), np.uint64)
        h = size.astype(np.uint64)
        for j in range(WIDTH // 8):
            keys[:, j] = eight[np.minimum(start + 8 * j, len(eight) - 1)] & _KEEP[np.clip(size - 8 * j, 0, 8)]
            h = _hash(h, keys[:, j])
        cut = low.tobytes()
        distinct, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        place, old = self._places(distinct)
        new = at[~old]
        new = new[size[new] <= WIDTH]
        if len(new):
            if len(self.hashes) + len(new) > CACHE_PIECES:
                self.forget()
                new = at[size[at] <= WIDTH]
            self._learn(h[new], keys[new], [cut[a:z] for a, z in zip(start[new].tolist(), end[new].tolist(), strict=True)], hard[new])
            place, old = self._places(distinct)
        entry = np.full(len(start), -1)
        known = old[inverse]
        entry[known] = self.entry[place[inverse[known]]]
        entry[known] = np.where((self.keys[entry[known]] == keys[known]).all(1) & (size[known] <= WIDTH), entry[known], -1)
        first, count, ids = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), self.ids
        known = entry >= 0
        first[known], count[known] = self.first[entry[known]], self.count[entry[known]]
        if not known.all():  # long ones, and those that share a hash with another
            rest = np.flatnonzero(~known)
            made = self._encoded([cut[a:z] for a, z in zip(start[rest].tolist(), end[rest].tolist(), strict=True)])
            count[rest] = [len(x) for x in made]
            first[rest] = len(ids) + np.cumsum(count[rest]) - count[rest]
            ids = np.concatenate([ids, *made])
        upto = np.cumsum(np.concatenate([[0], count]))
        flat = ids[np.repeat(first - upto[:-1], count) + np.arange(upto[-1])].tobytes()
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = 4 * upto[np.searchsorted(start, begins)]
        return [flat[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _places(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        return place, (self.hashes[place] == distinct if len(self.hashes) else np.zeros(len(distinct), bool))

    def _learn(self, hashes: np.ndarray, keys: np.ndarray, pieces: list[bytes], hard: np.ndarray) -> None:
        """Add pieces whose hashes, in order, are not known yet."""
        soft = np.flatnonzero(~hard)
        count, ids = np.zeros(len(pieces), np.int64), []
        for i in range(0, len(soft), 1000):
            part = soft[i : i + 1000]
            made = np.array(self.bare.encode(b" ".join([pieces[k] for k in part]).decode(), add_special_tokens=False).ids, np.uint32)
            count[part] = np.diff(np.flatnonzero(self.ends[made]) + 1, prepend=0)
            ids.append(made)
        rest = np.flatnonzero(hard)
        made = self._encoded([pieces[k] for k in rest])
        count[rest] = [len(x) for x in made]
        order = np.concatenate([soft, rest])
        first = np.empty(len(pieces), np.int64)
        first[order] = len(self.ids) + np.cumsum(count[order]) - count[order]
        self.ids = np.concatenate([self.ids, *ids, *made])
        place = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.entry = np.insert(self.entry, place, len(self.first) + np.arange(len(pieces)))
        self.keys = np.concatenate([self.keys, keys])
        self.first, self.count = np.concatenate([self.first, first]), np.concatenate([self.count, count])

    def _encoded(self, pieces: list[bytes]) -> list[np.ndarray]:
        if not pieces:
            return []
        return [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast([x.decode("utf-8", "replace") for x in pieces], add_special_tokens=False)]


_SPACE, _LETTER, _DIGIT, _MARK, _HARD = range(5)
_KIND = np.array([_SPACE if c in b"\t\n\v\f\r " else _HARD if c > 127 or c in b"'<" else _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _MARK for c in range(256)], np.uint8)
_LOW = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _hash(h: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(h * _ODD + key)


def _pieces(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in lower case, where pieces begin and end, and which of them need the whole tokenizer."""
    raw = np.frombuffer(joined, np.uint8)
    kind, low = _KIND[raw], _LOW[raw]
    # Latin letters of two bytes (U+00C0 to U+00FF but for two signs) have their lower case 32 further on.
    lead = np.flatnonzero(raw == 0xC3)
    second = raw[lead + 1]
    fine = (second != 0x97) & (second != 0xB7)
    kind[lead[fine]] = kind[lead[fine] + 1] = _LETTER
    low[lead[fine & (second < 0x9F)] + 1] += 0x20
    if (kind == _HARD).any():
        word = np.cumsum(kind == _SPACE)
        bad = np.zeros(word[-1] + 1, bool)
        bad[word[kind == _HARD]] = True
        own = bad[word] & (kind != _SPACE)
        kind[own] = _HARD
        low[own] = raw[own]
    edge = np.ones(len(kind), bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(kind))
    keep = kind[start] != _SPACE
    return low, start[keep], end[keep], kind[start[keep]] == _HARD


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text, cut at white space."""
    at = 0
    while at < len(text):
        found = _BLANK.search(text, at + PART_BYTES)
        stop = found.end() if found else len(text)
        yield text[at:stop]
        at = stop


_TOKENIZERS: dict[str, PieceIds] = {}


def _ids(path: str) -> PieceIds:
    """One tokenizer for each Python worker, kept between tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = PieceIds(path)
    return _TOKENIZERS[path]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, with_ids: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most `window` tokens.

    One row per piece: where it begins in its document, its ids (with_ids) and their CRC-32, its sequence
    and its offset there. A document's tokens end with the id `end`. Overlong documents are first cut into
    full windows; what is left is placed by best-fit decreasing, each piece in the tightest open window.

    Each task packs what it has read, in rounds of bounded size, so nothing is shuffled and no task holds
    more than a round; only the last windows of a round stay short. Input splits that are smaller than
    TASK_BYTES on average are read several to a task (without a shuffle), as else most windows would be last
    ones. A sequence id has the task's number in its upper bits: the same input splits give the same
    sequences when a task runs again.

    Null and empty texts are one piece with the id `end` alone. Repeated rows are packed each. A null
    doc_id stays null. No rows: no rows.
    """
    end_bytes = end.to_bytes(4, "little")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []
        docs_in = tokens_in = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            sequence, offset, more = best_fit_decreasing([r[2] for r in rows], window)
            base = task + made
            made += more
            for i in range(0, len(rows), 4096):
                part = rows[i : i + 4096]
                cols = [pa.array([r[k] for r in part], pa.int64()) for k in range(5)]
                cols += [pa.array([base + s for s in sequence[i : i + 4096]], pa.int64()), pa.array(offset[i : i + 4096], pa.int64())]
                if with_ids:
                    ids = pa.array(np.frombuffer(b"".join(r[5] for r in part), dtype="<u4").astype("i4"))
                    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(r[2] for r in part)]), pa.int32()), ids))
                yield pa.RecordBatch.from_arrays(cols, [*names, "ids"][: len(cols)])
            rows.clear()

        words = _ids(tokenizer)
        for batch in slices(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), words.of(text_bytes(batch)), strict=True):
                ids += end_bytes
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), total, piece if with_ids else None))
                docs_in, tokens_in = docs_in + 1, tokens_in + total
                if docs_in >= PACK_DOCS or tokens_in >= PACK_TOKENS:
                    yield from flush()
                    docs_in = tokens_in = 0
        if rows:
            yield from flush()
        tidy()

    short_batches(docs.sparkSession)
    source = narrowed(docs, "doc_id", "text")
    source = source.select(source.doc_id.cast("long").alias("doc_id"), "text")
    size = estimated_bytes(docs)
    if size is not None:
        source = source.coalesce(max(1, size // TASK_BYTES))
    return source.mapInArrow(packed, SCHEMA + (", ids array<int>" if with_ids else ""))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer(), with_ids=False)
