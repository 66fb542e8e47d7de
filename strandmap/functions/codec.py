"""Byte codecs of compressed graph records: variable-length numbers, runs, whole records.

Position-dependent bytes have no column form; the functions here work on bytes, and the columns
below apply them to Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def put_number(out: bytearray, n: int) -> None:
    """Seven bits a byte, lowest first, the top bit set on all but the last."""
    if n < 0:
        raise ValueError("negative number")
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_number(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return n, at


def _room(sigma: int) -> int:
    """Run lengths that fit beside a symbol in one byte; 0 if symbols need numbers of their own."""
    return 256 // sigma if sigma < 255 else 0


def put_run(out: bytearray, sigma: int, symbol: int, length: int) -> None:
    room = _room(sigma)
    if not room:
        put_number(out, symbol)
        put_number(out, length - 1)
    elif length < room:
        out.append(symbol + sigma * (length - 1))
    else:
        out.append(symbol + sigma * (room - 1))
        put_number(out, length - room)


def get_run(data: bytes, at: int, sigma: int) -> tuple[int, int, int]:
    room = _room(sigma)
    if not room:
        symbol, at = get_number(data, at)
        length, at = get_number(data, at)
        return symbol, length + 1, at
    symbol, length = data[at] % sigma, data[at] // sigma + 1
    at += 1
    if length == room:
        more, at = get_number(data, at)
        length += more
    return symbol, length, at


def encode_record(outgoing: list[tuple[int, int]], runs: list[tuple[int, int]]) -> bytes:
    """outgoing: (target, rank offset), targets must not fall; runs: (outrank, length)."""
    out, last = bytearray(), 0
    put_number(out, len(outgoing))
    for to, offset in outgoing:
        put_number(out, to - last)
        put_number(out, offset)
        last = to
    for symbol, length in runs:
        put_run(out, len(outgoing), symbol, length)
    return bytes(out)


def decode_record(data: bytes) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    sigma, at = get_number(data, 0)
    outgoing, to = [], 0
    for _ in range(sigma):
        step, at = get_number(data, at)
        offset, at = get_number(data, at)
        to += step
        outgoing.append((to, offset))
    runs = []
    while at < len(data):
        if not sigma:
            raise ValueError("bytes after a record without edges")
        symbol, length, at = get_run(data, at, sigma)
        runs.append((symbol, length))
    return outgoing, runs


def is_valid(data: bytes | None) -> bool:
    """Whether a record is consumed exactly and its symbols are in range."""
    try:
        outgoing, runs = decode_record(data or b"")
    except (IndexError, ValueError):
        return False
    return all(s < len(outgoing) for s, _ in runs)


RECORD = "outgoing array<struct<to:bigint,rank_offset:bigint>>, runs array<struct<outrank:bigint,len:bigint>>"


def _bytes(outgoing: pd.Series, runs: pd.Series) -> pd.Series:
    pairs = lambda x, a, b: [(int(r[a]), int(r[b])) for r in x]
    return pd.Series([encode_record(pairs(o, "to", "rank_offset"), pairs(r, "outrank", "len")) for o, r in zip(outgoing, runs, strict=True)])


def _structs(data: pd.Series) -> pd.DataFrame:
    rows = [decode_record(x) for x in data]
    return pd.DataFrame({"outgoing": [[{"to": a, "rank_offset": b} for a, b in o] for o, _ in rows], "runs": [[{"outrank": a, "len": b} for a, b in r] for _, r in rows]})


def _valid(data: pd.Series) -> pd.Series:
    return data.map(is_valid)


# pandas_udf needs the kinds of its arguments, which strings for annotations hide
for _f in (_bytes, _structs, _valid):
    _f.__annotations__ = {k: {"pd.Series": pd.Series, "pd.DataFrame": pd.DataFrame}[v] for k, v in _f.__annotations__.items()}


def record_bytes(outgoing: Column, runs: Column) -> Column:
    return F.pandas_udf(_bytes, "binary")(outgoing, runs)


def record_struct(data: Column) -> Column:
    return F.pandas_udf(_structs, RECORD)(data)


def record_valid(data: Column) -> Column:
    return F.pandas_udf(_valid, "boolean")(data)


def run_total(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda s, r: s + r["len"])
