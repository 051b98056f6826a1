"""Chat formatting with loss masks that are aligned by offsets."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import short_batches, table

START, SEP, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: The model learns to write the texts of this role.
LEARNT = "assistant"


def escape(text: str) -> str:
    """No control string is left: between "<" and "|", however many backslashes are there, goes one more."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans (bytes of UTF-8) of the texts to learn, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        at += len(head.encode())
        size = len(body.encode())
        if role == LEARNT:
            spans.append((at, at + size))
        parts += (head, body, STOP)
        at += size + len(STOP)
    return "".join(parts), spans


def mask(spans: list[tuple[int, int]], starts: np.ndarray) -> np.ndarray:
    """1 for each token that begins within a span; both are sorted, so a binary search finds the ends.

    Control strings are tokens of their own on either side of a span, so no token is in two of them.
    """
    out = np.zeros(len(starts), np.int8)
    if spans:
        ends = np.searchsorted(starts, np.array(spans), "left")
        for a, z in ends:
            out[a:z] = 1
    return out


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: what render() was given."""
    turns = []
    for turn in formatted.split(START)[1:]:
        role, _, text = turn.removesuffix(STOP).partition(SEP)
        turns.append((unescape(role), unescape(text)))
    return turns


class Vocabulary(NamedTuple):
    """A byte-level vocabulary: its merge ranks, its pattern, and the file of the same for a tokenizer without limits."""

    ranks: str
    pattern: str
    whole: str


class Coder:
    """Ids of formatted conversations, where their tokens begin, and their bytes again."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import tiktoken

        with open(vocabulary.ranks, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        # One id is left to the vocabulary's own end mark.
        self.control = {x: len(ranks) + 1 + i for i, x in enumerate((START, SEP, STOP))}
        self.ranked = tiktoken.Encoding("chat", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=self.control)
        self.size = np.zeros(len(ranks) + 1 + len(self.control), np.int64)
        for token, i in [*ranks.items(), *((x.encode(), i) for x, i in self.control.items())]:
            self.size[i] = len(token)
        self.path, self.whole = vocabulary.whole, None

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.ranked.encode_to_numpy(text, allowed_special="all").astype(np.int32)
        except ValueError:  # white space without end is too much for the pattern there
            return self.ids_of_any(text)

    def ids_of_any(self, text: str) -> np.ndarray:
        """The same ids, more slowly."""
        if self.whole is None:
            from tokenizers import AddedToken, Tokenizer

            self.whole = Tokenizer.from_file(self.path)
            self.whole.add_special_tokens([AddedToken(x, normalized=False) for x in self.control])
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int32)

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token begins."""
        size = self.size[ids]
        return np.cumsum(size) - size

    def text(self, ids: np.ndarray) -> str:
        return self.ranked.decode_bytes(ids.tolist()).decode()


_CODERS: dict[Vocabulary, Coder] = {}


def coder(vocabulary: Vocabulary) -> Coder:
    if vocabulary not in _CODERS:
        _CODERS[vocabulary] = Coder(vocabulary)
    return _CODERS[vocabulary]


def learnt_text(vocabulary: Vocabulary, ids: np.ndarray, loss: np.ndarray) -> str:
    """All text under the mask, unescaped, decoded run by run from the ids."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loss, [0]])))
    return "".join(unescape(coder(vocabulary).text(ids[a:z])) for a, z in edges.reshape(-1, 2))


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows), kind))


def _rows(column: pa.ListArray) -> list[np.ndarray]:
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]


def format_chats(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, formatted, ids array<int>, loss_mask array<tinyint>.

    A conversation is rendered whole, in the order of turn (nulls first; then role, then text), and encoded
    once; the spans of assistant turns meet the tokens' offsets by binary search, both in bytes. Control strings in roles
    and texts are escaped, reversibly.

    A null role or text is empty; rows with a null conv_id are one conversation; repeated rows are turns
    each. No rows: no rows. A conversation is the unit of work, so it must fit into a task.
    """
    short_batches(rows.sparkSession)
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    chats = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = chats.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t.role, t.text)).alias("turns"))

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                b = whole.slice(i, 64)
                made = [render([tuple(x.values()) for x in turns]) for turns in b.column(1).to_pylist()]
                ids = [c.ids(text) for text, _ in made]
                masks = [mask(spans, c.starts(row)) for (_, spans), row in zip(made, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text for text, _ in made], pa.string()), _lists(ids, pa.int32()), _lists(masks, pa.int8())], ["conv_id", "formatted", "ids", "loss_mask"])

    return chats.mapInArrow(formatted, "conv_id long, formatted string, ids array<int>, loss_mask array<tinyint>")


def digests(formatted: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """What can be read back from formatted conversations."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, text, ids, loss in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _rows(b.column(2)), _rows(b.column(3)), strict=True):
                turns = parse(text)
                learnt = learnt_text(vocabulary, ids, loss)
                said = "".join(f"{role}\n{x}\n" for role, x in turns)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "ids", "loss_mask").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def default_vocabulary() -> Vocabulary:
    import public_tokenizers as p

    return Vocabulary(p.path("byte_bpe_50k.tiktoken"), p.PATTERN, p.path("byte_bpe_50k.json"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts are control strings."""
    hard = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], rows.schema))
    return digests(format_chats(rows, default_vocabulary()), default_vocabulary())
