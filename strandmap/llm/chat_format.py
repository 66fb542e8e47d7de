"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered with the template ``<|turn|>role<|body|>text<|end|>`` for each turn
and encoded once, with offsets. The three markers are special tokens, so no token reaches across
them. The spans of the assistant texts are sorted; each token's span is found in them by binary
search, and the loss mask holds the tokens that lie in one. Control strings inside roles and texts
are escaped reversibly: of ``<``, any number of backslashes, ``|`` one backslash more is written.

Conversations are streamed one at a time from partitions sorted by conversation and turn. Null texts
and roles count as empty; null conv_ids form one conversation; turns with one number, repeated
rows included, follow each other by role, then text. Rows with a null turn come first. Empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import tokenizer_path
from .common import tune

TURN, BODY, STOP = MARKERS = ("<|turn|>", "<|body|>", "<|end|>")
LOSS_ROLE = "assistant"
CLEAR, HIDDEN = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return CLEAR.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return HIDDEN.sub(r"<\1|", text)


@cache
def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in MARKERS])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the spans of the texts that are learned from."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
        at += len(head)
        if role == LOSS_ROLE:
            spans.append((at, at + len(body)))
        at += len(body) + len(STOP)
        out += [head, body, STOP]
    return "".join(out), spans


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Number of the span that each token (start, end) lies in, or -1; spans are sorted and disjoint."""
    if not spans or not len(offsets):
        return np.full(len(offsets), -1)
    starts, ends = (np.array(x) for x in zip(*spans, strict=True))
    k = np.searchsorted(starts, offsets[:, 0], side="right") - 1
    inside = (k >= 0) & (offsets[:, 1] <= ends[np.maximum(k, 0)]) & (offsets[:, 0] < offsets[:, 1])
    return np.where(inside, k, -1)


def format_conversation(turns: list[tuple[str, str]], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the rendered conversation, and for each its span number under the loss mask or -1."""
    text, spans = render(turns)
    e = tokenizer(path).encode(text, add_special_tokens=False)
    return np.array(e.ids, np.int64), mask(np.array(e.offsets, np.int64).reshape(-1, 2), spans)


def read_back(ids: np.ndarray, loss: np.ndarray, path: str) -> tuple[list[tuple[str, str]], list[str], int]:
    """Turns, texts under the mask and characters, from ids and mask alone."""
    decode = tokenizer(path).decode
    text = decode(ids.tolist(), skip_special_tokens=False) if len(ids) else ""
    turns = []
    for part in text.split(TURN)[1:]:
        role, _, rest = part.partition(BODY)
        turns.append((unescape(role), unescape(rest.removesuffix(STOP))))
    learned = [unescape(decode(ids[loss == k].tolist(), skip_special_tokens=False)) for k in np.unique(loss[loss >= 0]).tolist()]
    return turns, learned, len(text)


def _format(path: str, digest: bool):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for conv, own in groupby(rows(batches), key=lambda r: r[0]):
            ids, loss = format_conversation([(r or "", t or "") for _, r, t in own], path)
            if digest:
                turns, learned, chars = read_back(ids, loss, path)
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                text = "".join(learned)
                held.append((conv, len(turns), sha, len(text), hashlib.sha256(text.encode()).hexdigest(), chars))
            else:
                held.append((conv, ids.tolist(), (loss >= 0).tolist()))
            size += len(ids)
            if size > 200_000:
                yield batch(held)
                held, size = [], 0
        yield batch(held)

    def batch(held: list[tuple]) -> pa.RecordBatch:
        kinds = [("conv_id", pa.int64()), *([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())] if digest else [("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))])]
        cols = list(zip(*held, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])

    return run


def _ordered(conversations: DataFrame) -> DataFrame:
    tune(conversations.sparkSession)
    return conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_chats(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, ids, loss (true for tokens to learn from) of every conversation."""
    return _ordered(conversations).mapInArrow(_format(path or tokenizer_path("byte_bpe_50k.json"), False), "conv_id bigint, ids array<int>, loss array<boolean>")


def digests(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """What reading the formatted conversations back gives: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return _ordered(conversations).mapInArrow(_format(path or tokenizer_path("byte_bpe_50k.json"), True), schema)
