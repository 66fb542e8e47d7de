"""Sampled segmentations with a SentencePiece vocabulary, and lossless decoding.

A text gets the model's word mark for each space and one in front, and is cut into units, each a
run of marks with the characters after it; no piece of the model crosses into a run of marks. Units of
more than UNIT characters are cut further, but only between two characters that no piece has side by
side, so that no segmentation is lost. What is longer than LONG after that goes block by block: a
forward pass keeps the sums of the last places at each block's start, as many as the longest piece has characters, rescaled, and the
backward pass makes each block's lattice again. Over a unit's lattice of
vocabulary pieces, forward filtering sums the weights of all segmentations of every prefix;
backward sampling then draws, from the end, each piece with its share of that sum. A piece weighs
exp(-TEMPERATURE log(2 + rank)), rank its place in the vocabulary; a character that is no piece is
written as byte pieces. All occurrences of a batch are sampled in lockstep. Substrings are looked up by
hash; every text is decoded and compared after that, and one that differs is sampled again by lookups
of the strings themselves.

The random number of a draw is a hash of the row key, the unit's number and the position, so a row's
segmentation does not depend on how the table is partitioned. A literal word mark in a text is
written as bytes, which keeps it apart from a space: decoding gives the text back exactly.

Null texts count as empty and have no pieces. Null doc_ids are a key of their own. Repeated rows get
the same segmentation. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import tokenizer_path
from .common import BATCH_BYTES, slices, tune

MARK = "▁"
#: Stands for a literal mark inside a unit; not a character of any text (a lone surrogate).
LITERAL = "\ud800"
UNIT, LONG, TEMPERATURE = 32, 4096, 0.5
#: Characters of the units that go through the tables together.
TOGETHER = 32_000
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Multiplier of the hash of a string's code points, and bits of a table of hashes.
HASH, MIX, SLOTS = np.uint64(0x9E3779B97F4A7C55), np.uint64(0xD6E8FEB86659FD93), 21



def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of hashes in the first and the second table."""
    shift = np.uint64(64 - SLOTS)
    return ((h * MIX) >> shift).astype(np.int64), (((h ^ (h >> np.uint64(29))) * HASH) >> shift).astype(np.int64)


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.is_byte = [sp.is_byte(i) for i in range(n)]
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if self.is_byte[i]}
        self.ids = {p: i for i, p in enumerate(self.piece) if not self.is_byte[i] and not sp.is_control(i) and not sp.is_unknown(i)}
        self.longest = max(map(len, self.ids))
        self.pairs = {x[i : i + 2] for x in self.ids for i in range(len(x) - 1)}
        assert not any(MARK in x.lstrip(MARK) for x in self.ids)  # units() cuts before runs of marks
        # hashes of the pieces and the tables that find() uses
        self.hashes = np.zeros(n + 1, np.uint64)
        self.slots = np.full((2, 1 << SLOTS), -1, np.int32)
        for p, i in self.ids.items():
            h = 0
            for c in p:
                h = (h * int(HASH) + ord(c) + 1) & (1 << 64) - 1
            self.hashes[i] = h
            at = [int(x[0]) for x in places(np.array([h], np.uint64))]
            k = 0 if self.slots[0, at[0]] < 0 else 1
            assert self.slots[k, at[k]] < 0
            self.slots[k, at[k]] = i
        # the bytes of all pieces, one after another
        raw = [bytes([int(p[3:5], 16)]) if b else p.replace(MARK, " ").encode() for p, b in zip(self.piece, self.is_byte, strict=True)]
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.fromiter(map(len, raw), np.int64, n)
        self.start = np.cumsum(self.size) - self.size
        self.weight = np.exp(-TEMPERATURE * np.log(2.0 + np.arange(n)))
        self.weight_or_none = np.append(self.weight, 0)  # where -1 is no piece

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte[b] for b in (MARK if char == LITERAL else char).encode("utf-8", "surrogatepass")]

    def lattice(self, unit: str) -> list[list[tuple[int, int]]]:
        """For each end 1..len: (length, id) of the pieces that end there; id -1 is a character as bytes."""
        out = []
        ids = self.ids
        for e in range(1, len(unit) + 1):
            own = [(k, i) for k in range(1, min(e, self.longest) + 1) if (i := ids.get(unit[e - k : e])) is not None]
            if not own or own[0][0] != 1:
                own.insert(0, (1, -1))
            out.append(own)
        return out

    def tables(self, units: list[str], before: np.ndarray | None = None, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward filtering: cumulative weights (unit, end, piece length) of the pieces that end at
        each place, their ids, and the sums of the last places (of units of one length). Substrings of
        all units are looked up together by their hashes, or by themselves if exact. before: such sums of
        the places in front of the units, which begin with the longest characters that led there."""
        size, longest = max(map(len, units)), self.longest
        n = np.fromiter(map(len, units), np.int64, len(units))
        w = np.zeros((len(units), size + 1, longest))
        ids = np.full((len(units), size + 1, longest), -1, np.int32)
        if exact:
            for u, unit in enumerate(units):
                for e, own in enumerate(self.lattice(unit)):
                    for k, i in own:
                        ids[u, e + 1, k - 1] = i
            w = self.weight_or_none[ids]
        else:
            chars = np.frombuffer("".join([u.ljust(size, "\0") for u in units]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, size).astype(np.uint64) + np.uint64(1)
            h = np.zeros_like(chars)
            for k in range(1, min(size, longest) + 1):  # h: hashes of the k characters from each start
                h = h[:, : size - k + 1] * HASH
                h += chars[:, k - 1 :]
                found = self.find(h)
                ids[:, k:, k - 1] = found
                w[:, k:, k - 1] = self.weight_or_none[found]
        one = w[:, 1:, 0]
        one[ids[:, 1:, 0] < 0] = self.weight[-1] / 256  # a character as bytes is rarer than any piece
        if n.min() < size:
            w[np.arange(size + 1) > n[:, None]] = 0
        forward = np.zeros((len(units), size + 1))
        forward[:, 0] = 1
        done = 0
        if before is not None:
            done = longest
            forward[:, : done + 1] = before
        for end in range(done + 1, size + 1):
            m, row = min(end, longest), w[:, end]
            row[:, :m] *= forward[:, end - m : end][:, ::-1]
            np.cumsum(row, axis=1, out=row)
            forward[:, end] = row[:, -1]
            if end % longest == 0:  # only ratios of the last sums matter; powers of two keep them exact
                last = forward[:, end - longest : end + 1]
                last[:] = np.ldexp(last, -np.frexp(last.max(1))[1][:, None])
        return w, ids, forward[:, -longest - 1 :]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none; two tables, the second for the
        few pieces whose slot in the first is taken."""
        one, two = places(h)
        first, second = self.slots[0][one], self.slots[1][two]
        out = np.where(self.hashes[first] == h, first, -1)
        return np.where((second >= 0) & (self.hashes[second] == h), second, out)


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def cut(word: str, pairs: set[str]) -> list[str]:
    """A run of marks with what follows, if long in parts, cut where none of the pairs stands."""
    if len(word) <= UNIT:
        return [word]
    cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs), len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def units(text: str, pairs: set[str]) -> list[str]:
    """The units of a text; their concatenation is the marked text."""
    if not text:
        return []
    return [u for word in WORDS.findall(MARK + text.replace(MARK, LITERAL).replace(" ", MARK)) for u in cut(word, pairs)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_key(doc_id: int | None) -> int:
    return int.from_bytes(hashlib.blake2b(str(doc_id).encode(), digest_size=8).digest(), "little")


def occurrences(p: Pieces, docs: pa.StringArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Units, and the numbers of those that each text consists of, one text behind the other, with
    the bounds of the texts. Texts with one space at a time are split as a whole batch."""
    odd = pc.match_substring(docs, "  ")
    for mark in (pc.match_substring(docs, MARK), pc.starts_with(docs, " "), pc.ends_with(docs, " "), pc.equal(docs, "")):
        odd = pc.or_(odd, mark)
    odd = odd.to_numpy(zero_copy_only=False)
    split = pc.split_pattern(docs.filter(pa.array(~odd)), " ")
    coded = split.flatten().dictionary_encode()
    names = [MARK + w for w in coded.dictionary.to_pylist()]
    number = dict(zip(names, range(len(names)), strict=True))

    def numbers(own: list[str]) -> np.ndarray:
        return np.fromiter((number.setdefault(u, len(number)) for u in own), np.int64, len(own))

    long = [j for j, u in enumerate(names) if len(u) > UNIT]
    runs = [numbers(cut(names[j], p.pairs)) for j in long]
    alone = [numbers(units(t, p.pairs)) for t in docs.filter(pa.array(odd)).to_pylist()]
    seq = np.concatenate([np.arange(len(names)), *runs, *alone])
    start, size = np.arange(len(names)), np.ones(len(names), np.int64)
    size[long] = [len(r) for r in runs]
    start[long] = len(names) + np.cumsum(size[long]) - size[long]
    # every text is a list of such runs: one a word, or one alone
    words = np.diff(split.offsets.to_numpy())
    many = np.ones(len(docs), np.int64)
    many[~odd] = words
    begin = np.zeros(int(many.sum()), np.int64)
    length = np.zeros(len(begin), np.int64)
    at = np.cumsum(many) - many
    inside = np.ones(len(begin), bool)
    inside[at[odd]] = False
    piece = coded.indices.to_numpy(zero_copy_only=False)
    begin[inside], length[inside] = start[piece], size[piece]
    length[~inside] = [len(r) for r in alone]
    begin[~inside] = len(seq) - length[~inside].sum() + np.cumsum(length[~inside]) - length[~inside]
    ends = np.cumsum(length)
    which = seq[np.repeat(begin - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]
    bounds = np.concatenate([[0], ends[at + many - 1]]) if len(docs) else np.zeros(1, np.int64)
    return list(number), which, bounds


def sample(p: Pieces, docs: list[str] | pa.StringArray, row_keys: list[int], exact: bool = False) -> list[np.ndarray]:
    """Piece ids of each text."""
    if isinstance(docs, list):
        docs = pa.array(docs, pa.string())
    names, which, bounds = occurrences(p, docs)
    if not len(which):
        return [np.zeros(0, np.int64) for _ in range(len(docs))]
    counts = np.diff(bounds)
    seed = mixed(np.repeat(np.array(row_keys, np.uint64), counts) + (np.arange(len(which)) - np.repeat(bounds[:-1], counts)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    # ids at the places where their pieces start, in the characters of all texts
    offset = np.cumsum(lengths[which]) - lengths[which]
    out = np.full(int(offset[-1] + lengths[which[-1]]), -2, np.int32)
    # units that occur, by length; their occurrences in the same order
    used = np.flatnonzero(np.bincount(which, minlength=len(names)))
    used = used[np.argsort(lengths[used], kind="stable")]
    rank = np.zeros(len(names), np.int64)
    rank[used] = np.arange(len(used))
    which = rank[which]
    lengths = lengths[used]
    order = np.argsort(which, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(which))])

    def draw(table: np.ndarray, ids: np.ndarray, occ: np.ndarray, u: np.ndarray, pos: np.ndarray, stop: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces from each place back to stop or before; place base is the tables' 0. What is left."""
        out_occ, left = [occ[:0]], [pos[:0]]
        while True:
            live = pos > stop
            if not live.all():
                out_occ.append(occ[~live])
                left.append(pos[~live])
                occ, u, pos = occ[live], u[live], pos[live]
            if not len(occ):
                return np.concatenate(out_occ), np.concatenate(left)
            r = (mixed(seed[occ] + pos.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            row = table[u, pos - base]
            k = np.minimum((row <= (r * row[:, -1])[:, None]).sum(1), p.longest - 1)
            got = ids[u, pos - base, k]
            pos = pos - k - 1
            out[offset[occ] + pos] = got

    at = 0
    while at < len(used):  # bounded tables, units of like length together
        to = min(at + 4000, len(used))
        while to - at > 1 and (to - at) * int(lengths[to - 1]) > TOGETHER:
            to = at + max(1, TOGETHER // int(lengths[to - 1]))
        own = [names[i] for i in used[at:to].tolist()]
        occ = order[first[at] : first[to]]
        u = which[occ] - at
        pos = lengths[which[occ]]
        if lengths[to - 1] <= LONG:
            table, ids, _ = p.tables(own, exact=exact)
            draw(table, ids, occ, u, pos, 0, 0)
            at = to
            continue
        for i, unit in enumerate(own):  # block by block
            o, q = occ[u == i], pos[u == i]
            starts = list(range(0, len(unit), LONG))
            sums = [None]
            for s in starts[:-1]:
                sums.append(p.tables([unit[max(0, s - p.longest) : s + LONG]], sums[-1], exact)[2])
            for s, before in zip(reversed(starts), reversed(sums), strict=True):
                base = max(0, s - p.longest)
                table, ids, _ = p.tables([unit[base : s + LONG]], before, exact)
                o, q = draw(table, ids, o, np.zeros(len(o), np.int64), q, s, base)
        at = to
    place = np.flatnonzero(out > -2)
    ids = out[place].astype(np.int64)
    cuts = np.searchsorted(place, np.append(offset, len(out))[bounds])
    bad = np.flatnonzero(ids < 0)
    if len(bad):  # characters as bytes
        o = np.searchsorted(offset, place[bad], side="right") - 1
        runs = [p.bytes_of(names[u][x]) for u, x in zip(used[which[o]].tolist(), (place[bad] - offset[o]).tolist(), strict=True)]
        n = np.ones(len(ids), np.int64)
        n[bad] = [len(x) for x in runs]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids, start = np.repeat(ids, n), ends[bad].tolist()
        for i, x in zip(start, runs, strict=True):
            ids[i : i + len(x)] = x
        cuts = ends[cuts]
    return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def checked(p: Pieces, docs: pa.StringArray, row_keys: list[int]) -> tuple[list[np.ndarray], list[bytes]]:
    """Piece ids of each text and the bytes that they decode to, which are the text's."""
    got = sample(p, docs, row_keys)
    back = [decode(p, g) for g in got]
    for i, (text, b) in enumerate(zip(docs.cast(pa.binary()).to_pylist(), back, strict=True)):
        if text != b:  # a hash met another string
            got[i] = sample(p, docs.slice(i, 1), row_keys[i : i + 1], exact=True)[0]
            back[i] = decode(p, got[i])
    return got, back


def decode(p: Pieces, ids: np.ndarray) -> bytes:
    """The text again, in UTF-8: bytes of byte pieces as they are, marks of other pieces as spaces,
    less the first."""
    ids = np.asarray(ids, np.int64)
    size = p.size[ids]
    ends = np.cumsum(size)
    at = np.repeat(p.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
    return p.blob[at].tobytes()[1:]


def _encode(path: str, digest: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in slices(batches, limit=BATCH_BYTES):
            got, back = checked(p, pc.fill_null(b.column(1), ""), [row_key(d) for d in b.column(0).to_pylist()])
            if digest:
                sha = [hashlib.sha256(x).hexdigest() for x in back]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(g) for g in got], pa.int64()), pa.array([zlib.crc32(g.astype("<u4").tobytes()) for g in got], pa.int64()), pa.array(sha)], names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.tolist() for g in got], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: a sampled segmentation of every whole text."""
    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_encode(path or tokenizer_path("piece_bpe_32k.model"), False), "doc_id bigint, ids array<int>")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256 (of the text that decoding gives)."""
    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_encode(path or tokenizer_path("piece_bpe_32k.model"), True), "doc_id bigint, n_pieces bigint, ids_crc32 bigint, decoded_sha256 string")
