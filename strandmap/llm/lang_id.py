"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in windows of WINDOW bytes, each from a zero state, forwards and
backwards. Every position gets a softmax over the learned languages from both hidden states;
a document's probabilities are the mean over all its positions. The network is trained here in
numpy by backpropagation through time (Adam), on a bounded sample: at most SAMPLE_DOCS rows a
language, of the MAX_LANGS languages with the most rows (both are parameters of ``sample``; languages
beyond them are not learned), a piece of SAMPLE_BYTES characters of each, from rows whose crc32(doc_id) mod 4
is not 2. Prediction reads the whole text and nothing else.

Null texts and texts without a letter get ``und`` and score 0. Null doc_ids are predicted like
others and never trained on. Empty tables give no rows; with nothing to learn from, every
document is ``und``. Ties between languages go to the smaller name. Repeated rows are predicted
alike; extra columns are ignored by ``predict`` and kept by ``identify``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts, tune

#: Bytes a window, hidden units a direction, windows in lockstep.
WINDOW, HIDDEN, LOCKSTEP = 128, 8, 2048
#: The bounded sample that training sees: rows a language, bytes a row, languages.
SAMPLE_DOCS, SAMPLE_BYTES, MAX_LANGS = 600, 256, 200
#: Training: bytes a window, windows a step, steps, Adam's step size.
TRAIN_WINDOW, TRAIN_BATCH, TRAIN_STEPS, RATE = 64, 192, 220, 0.02
#: Numbers that are no digits, such as fractions, are no letters either.
LETTER = regex.compile(r"\p{L}")


def soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: the squashing function of all gates, far cheaper than tanh."""
    y = np.abs(x)
    y += 1
    x /= y
    return x


class ByteGru:
    """Weights of both directions, stacked on axis 0, for the update, reset and candidate gates z,
    r, c: input tables Xz.. (2, 256, h), recurrent Uz.. (2, h, h), output V (2h, n) and bias b (n).

    z, r = 0.5 + 0.5 soft(.), c = soft(.), s' = s + z (c - s)."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 4):
        rng = np.random.Generator(np.random.PCG64(seed))
        n = len(langs)
        self.langs, self.h = langs, hidden
        self.p = {f"X{g}": rng.normal(0, 0.5, (2, 256, hidden)).astype(np.float32) for g in "zrc"}
        self.p |= {f"U{g}": rng.normal(0, hidden**-0.5, (2, hidden, hidden)).astype(np.float32) for g in "zrc"}
        self.p |= {"V": rng.normal(0, (2 * hidden) ** -0.5, (2 * hidden, n)).astype(np.float32), "b": np.zeros(n, np.float32)}

    def states(self, data: np.ndarray, lengths: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (2, T, B, h) of windows (T, B); a padded position leaves a state as it was.

        keep: gets what backpropagation needs of each step."""
        steps, size = data.shape
        out = np.empty((2, steps, size, self.h), self.p["b"].dtype)
        full = int(lengths.min())
        for d in (0, 1):
            s = np.zeros((size, self.h), out.dtype)
            (Xz, Xr, Xc), (Uz, Ur, Uc) = ([self.p[k + g][d] for g in "zrc"] for k in "XU")
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                at = data[t]
                z, r, c = s @ Uz, s @ Ur, Xc.take(at, 0)
                z += Xz.take(at, 0)
                r += Xr.take(at, 0)
                soft(z)
                z *= 0.5
                z += 0.5
                soft(r)
                r *= 0.5
                r += 0.5
                rs = r * s
                c += rs @ Uc
                soft(c)
                step = c - s
                step *= z
                live = None
                if t >= full:
                    live = (t < lengths)[:, None].astype(out.dtype)
                    step *= live
                if keep is not None:
                    keep.append((d, t, s, z, r, rs, c, live))
                s = np.add(s, step, out=out[d, t])
        return out

    def position_probs(self, s: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, n) of every position; states are within 1, so exp is safe."""
        steps, size = s.shape[1:3]
        p = s[0].reshape(-1, self.h) @ self.p["V"][: self.h]
        p += s[1].reshape(-1, self.h) @ self.p["V"][self.h :]
        p += self.p["b"]
        np.exp(p, out=p)
        p /= p @ np.ones((p.shape[1], 1), p.dtype)
        return p.reshape(steps, size, -1)

    def gradients(self, data: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions of windows (T, B), and its gradients, by
        backpropagation through time."""
        h, (steps, size), P = self.h, data.shape, self.p
        keep: list = []
        s = self.states(data, lengths, keep)
        live = (np.arange(steps)[:, None] < lengths).astype(s.dtype)
        dlog = self.position_probs(s)
        total = live.sum()
        loss = float(-(np.log(dlog[:, np.arange(size), y] + 1e-12) * live).sum() / total)
        dlog[:, np.arange(size), y] -= 1
        dlog *= live[:, :, None] / total
        flat = dlog.reshape(-1, dlog.shape[-1])
        g = {k: np.zeros_like(v) for k, v in P.items()}
        g["V"][:h], g["V"][h:] = s[0].reshape(-1, h).T @ flat, s[1].reshape(-1, h).T @ flat
        g["b"] = flat.sum(0)
        down = [flat @ P["V"][:h].T, flat @ P["V"][h:].T]
        down = [x.reshape(steps, size, h) for x in down]
        dx = {k: np.zeros((2, steps, size, h), s.dtype) for k in "zrc"}
        ds, last = np.zeros((size, h), s.dtype), None
        slope = lambda gate: 0.5 * (1 - np.abs(2 * gate - 1)) ** 2
        for d, t, before, z, r, rs, c, on in reversed(keep):
            if d != last:
                ds, last = np.zeros((size, h), s.dtype), d
            ds = ds + down[d][t]
            dnew = ds if on is None else ds * on
            dc = dnew * z * (1 - np.abs(c)) ** 2
            drs = dc @ P["Uc"][d].T
            dz, dr = dnew * (c - before) * slope(z), drs * before * slope(r)
            dx["z"][d, t], dx["r"][d, t], dx["c"][d, t] = dz, dr, dc
            g["Uz"][d] += before.T @ dz
            g["Ur"][d] += before.T @ dr
            g["Uc"][d] += rs.T @ dc
            ds = ds - dnew * z + drs * r + dz @ P["Uz"][d].T + dr @ P["Ur"][d].T
        for d in (0, 1):
            for k in "zrc":
                np.add.at(g["X" + k][d], data.reshape(-1), dx[k][d].reshape(-1, h))
        return loss, g


def to_windows(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def padded(windows: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows side by side (size, n), padded with zeros, and their lengths."""
    joined = b"".join(w.ljust(size, b"\0") for w in windows)
    data = np.frombuffer(joined, np.uint8).reshape(len(windows), size)
    return np.ascontiguousarray(data.T).astype(np.intp), np.fromiter(map(len, windows), np.int64, len(windows))


def train(rows: list[tuple[str, str]], steps: int = TRAIN_STEPS, hidden: int = HIDDEN, seed: int = 4) -> ByteGru | None:
    """A network for (text, lang) rows; None if there is nothing to learn from."""
    by: dict[str, list[bytes]] = {}
    for text, lang in sorted(rows):
        by.setdefault(lang, []).extend(w for w in to_windows(text.encode("utf-8", "replace")[:SAMPLE_BYTES], TRAIN_WINDOW) if len(w) >= 8 or len(text) < 8)
    by = {k: v for k, v in by.items() if v}
    if not by:
        return None
    langs = sorted(by)
    net, rng = ByteGru(langs, hidden, seed), np.random.Generator(np.random.PCG64(seed))
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for i in range(1, steps + 1):
        y = rng.integers(0, len(langs), TRAIN_BATCH)  # languages weigh alike, however rare
        data, lengths = padded([by[langs[k]][int(rng.integers(0, len(by[langs[k]])))] for k in y], TRAIN_WINDOW)
        _, g = net.gradients(data, lengths, y)
        norm = max(1.0, float(np.sqrt(sum((x * x).sum() for x in g.values()))))
        rate = RATE * (1 - 0.9 * i / steps)
        for k, x in g.items():
            x = x / norm
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            net.p[k] -= (rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return net


def document_probs(net: ByteGru, docs: list[str]) -> np.ndarray:
    """Mean position probabilities of each whole text (n docs, n languages)."""
    windows: list[bytes] = []
    owner: list[int] = []
    for i, t in enumerate(docs):
        own = to_windows(t.encode("utf-8", "replace"), WINDOW)
        windows += own
        owner += [i] * len(own)
    total, count = np.zeros((len(docs), len(net.langs))), np.zeros(len(docs))
    order = sorted(range(len(windows)), key=lambda i: len(windows[i]))  # windows of a length together
    for at in range(0, len(order), LOCKSTEP):
        ids = order[at : at + LOCKSTEP]
        data, lengths = padded([windows[i] for i in ids], max(len(windows[i]) for i in ids))
        probs = net.position_probs(net.states(data, lengths))
        if lengths.min() < len(data):
            probs *= (np.arange(len(data))[:, None] < lengths)[:, :, None]
        own = np.array([owner[i] for i in ids])
        np.add.at(total, own, probs.sum(0))
        np.add.at(count, own, lengths)
    return total / np.maximum(count, 1)[:, None]


def _predict(net: ByteGru | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            docs = texts(b)
            some = [i for i, t in enumerate(docs) if LETTER.search(t)]
            lang, score = ["und"] * len(docs), [0.0] * len(docs)
            if net and some:
                probs = document_probs(net, [docs[i] for i in some])
                for i, k, p in zip(some, probs.argmax(1), probs.max(1), strict=True):
                    lang[i], score[i] = net.langs[k], float(min(1.0, p))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d in b.column(0).to_pylist()]), pa.array(lang), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def sample(docs: DataFrame, rows: int = SAMPLE_DOCS, languages: int = MAX_LANGS) -> list[tuple[str, str]]:
    """At most rows labelled texts (pieces of at most SAMPLE_BYTES characters) of each language.

    Counts come from narrow columns; then a hash threshold for each language takes about twice
    the rows wanted, and of these the smallest hashes stay: the same rows however the table is
    partitioned."""
    fit = docs.where("lang is not null and text is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    h = F.xxhash64("doc_id", F.lit(4))
    share = (h.bitwiseAND(0xFFFFFF)) / F.lit(float(0x1000000))
    counts = {r[0]: r[1] for r in fit.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return []
    limit = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(2.0 * rows / n))])
    at = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.greatest(F.lit(1), F.length("text") - SAMPLE_BYTES)).cast("int") + 1
    got = fit.where(share < limit[F.col("lang")]).select("lang", h.alias("h"), F.substring("text", at, F.lit(SAMPLE_BYTES)).alias("piece")).where(F.col("piece").rlike(r"\p{L}"))
    by: dict[str, list[tuple[int, str]]] = {}
    for lang, k, piece in got.orderBy("h", "lang").limit(4 * rows * len(counts)).collect():
        by.setdefault(lang, []).append((k, piece))
    return [(piece, lang) for lang, v in by.items() for _, piece in sorted(v)[:rows]]


def predict(docs: DataFrame, net: ByteGru | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; trains on docs unless given a network."""
    tune(docs.sparkSession)
    net = net or train(sample(docs))
    return docs.select("doc_id", "text").mapInArrow(_predict(net), "doc_id bigint, held_out boolean, lang_pred string, score double")


def _keep(net: ByteGru | None, least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            docs = texts(b)
            some = [i for i, t in enumerate(docs) if LETTER.search(t)]
            keep = np.zeros(len(docs), bool)
            if net and some:
                keep[some] = document_probs(net, [docs[i] for i in some]).max(1) >= least
            yield b.filter(pa.array(keep))

    return run


def identify(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The documents whose language is recognised with at least this score, all columns kept."""
    tune(docs.sparkSession)
    return docs.mapInArrow(_keep(train(sample(docs)), least), docs.schema)
