"""Encoding with tokenizer files, fast on running text: a piece of text that was encoded before
comes from a bounded cache, and the ids of a batch are gathered in one array.

Both tokenizers cut a text into pre-tokens before anything else. A space after a non-space and
before a non-space always starts a new pre-token, and what is on its left does not change the
encoding of what is on its right. So a text is the concatenation of its pieces between such
spaces; each distinct piece is encoded by the tokenizer once. Texts with other runs of white
space around spaces go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A space whose neighbours make cutting there unsafe for a tokenizer that keeps white space.
UNSAFE = re.compile(r"\s (?:\s|\Z)|\A (?:\s|\Z)")
#: Pieces that stand behind such a space: empty ones and those that begin with white space.
BLANK = r"\A(?:[\t-\r\x1c- \x{85}\p{Z}]|\z)"
#: Pieces in the cache, and characters of a piece that may be cached.
CACHED, LONGEST = 300_000, 100
#: Words whose pre-tokens are plain to see: one or two words of Latin letters.
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
PLAIN = rf"\A(?P<a>{LETTERS})(?P<x>[.,]?)(?P<n>\n?)(?P<b>(?:{LETTERS})?)(?P<y>[.,]?)\z"
#: The printable characters that byte-level models write for the 256 byte values: printable Latin-1
#: stands for itself, the others follow from code point 256 on, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Stands between pieces that are encoded in one call; a pre-token of its own between spaces.
MARK, TOGETHER = "|", 4096
#: Stands between pre-tokens that go to the model as they are; it is written as it is.
CUT = "\n"
BYTE_CODES = np.array([ord(CUT) if chr(b) == CUT else ord(BYTE_CHARS.get(b, chr(b))) for b in range(256)], "<u2")


class Runs:
    """Runs of ids, one behind the other in one array; run 0 is empty."""

    def __init__(self):
        self.n = self.used = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def add(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of new runs of these sizes."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(size) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        at = np.arange(self.n, self.n + len(size))
        self.start[at], self.size[at] = self.used + np.cumsum(size) - size, size
        self.n, self.used = self.n + len(size), self.used + len(ids)
        return at

    def gather(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these runs, one behind the other, and where each ends."""
        size = self.size[runs]
        ends = np.cumsum(size)
        at = np.repeat(self.start[runs] - ends + size, size)
        at += np.arange(len(at))
        return self.ids[at], ends


class Pieces:
    """Pieces and the numbers of their runs; how many batches had them."""

    def __init__(self):
        self.words, self.run, self.uses = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, words: pa.StringArray) -> np.ndarray:
        """Run of each word, -1 where there is none."""
        if not len(self.run):
            return np.full(len(words), -1)
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        self.uses[at[at >= 0]] += 1
        return np.where(at >= 0, self.run[at], -1)

    def add(self, words: pa.StringArray, run: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.run, self.uses = np.concatenate([self.run, run]), np.concatenate([self.uses, np.ones(len(run), np.int64)])


class Encoder:
    """ids of whole texts; special strings are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True
        self.keeps_space = self.t.normalizer is None  # white space is part of the pre-tokens, else dropped
        self.mark = self.t.encode(" " + MARK, add_special_tokens=False).ids
        assert len(self.mark) == 1
        # the same model on pre-tokens that are cut already
        self.bare = Tokenizer(self.t.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(CUT)
        vocab = self.t.get_vocab()
        self.vocabulary = 1 + max(vocab.values())
        # ids that begin (or, for models that mark word ends, end) a pre-token of letters after a space
        self.edge = np.zeros(self.vocabulary, bool)
        suffix = self.t.model.end_of_word_suffix
        self.edge[[i for w, i in vocab.items() if (w.startswith(BYTE_CHARS[32]) if self.keeps_space else w.endswith(suffix))]] = True
        self.bare_mark = self.bare.encode(MARK, add_special_tokens=False).ids[0]
        self.stops = [np.array(self.t.encode(c, add_special_tokens=False).ids, np.uint32) for c in (".", ",", "\n")]
        self._empty()

    def _empty(self) -> None:
        """No runs but those of the stops; pieces after a space, and words of letters after none."""
        self.runs, self.where, self.after = Runs(), Pieces(), Pieces()
        self.dot, self.comma, self.line = (self.runs.add(x, np.array([len(x)]))[0] for x in self.stops)

    def _evict(self) -> None:
        """Keep the pieces seen most often, half the cache at most; their uses age."""
        least, old, was = 1, self.runs, self.where
        while (was.uses > least).sum() > CACHED // 2:
            least += 1 + least // 2
        kept = np.flatnonzero(was.uses > least)
        self._empty()
        self.where.add(was.words.take(pa.array(kept)), self.runs.add(old.gather(was.run[kept])[0], old.size[was.run[kept]]))
        self.where.uses = was.uses[kept] >> 1

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text by itself, without the cache, as little-endian unsigned 32-bit bytes."""
        out = []
        for at in range(0, len(texts), 64):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.t.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)]
        return out

    def _each(self, texts: list[str]) -> np.ndarray:
        """Runs of texts that are encoded each by itself."""
        raw = self.ids(texts)
        return self.runs.add(np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw], np.int64))

    def _marked(self, words: list[str]) -> np.ndarray:
        """Runs of pieces after a space; many in one call, split again at the marks."""
        out = []
        for at in range(0, len(words), TOGETHER):
            own = words[at : at + TOGETHER]
            ids = np.array(self.t.encode_batch_fast(["".join(f" {w} {MARK}" for w in own)], add_special_tokens=False)[0].ids, np.uint32)
            mark = ids == self.mark[0]
            ends = np.flatnonzero(mark)
            assert len(ends) == len(own)
            out.append(self.runs.add(ids[~mark], np.diff(ends, prepend=-1) - 1))
        return np.concatenate(out)

    def _stems(self, words: pa.StringArray, spaced: bool, keep: bool) -> np.ndarray:
        """Runs of words of Latin letters, each one pre-token (with its space, if spaced), which go
        straight to the model. keep: they come into the cache."""
        memory = self.where if spaced else self.after
        coded = words.dictionary_encode()
        run = memory.find(coded.dictionary)
        new = coded.dictionary.filter(pa.array(run < 0))
        made = [np.zeros(0, np.int64)]
        # the bytes of all words in a row, each with its space in front and a cut (and a mark) behind
        before, behind = " " if spaced and self.keeps_space else "", CUT if spaced else CUT + MARK + CUT
        for at in range(0, len(new), TOGETHER):
            part = pc.binary_join_element_wise(before, new.slice(at, TOGETHER), behind, "")
            raw = np.frombuffer(part.buffers()[2], np.uint8, np.frombuffer(part.buffers()[1], np.int32)[len(part)])
            shown = BYTE_CODES[raw].tobytes().decode("utf-16-le")
            ids = np.array(self.bare.encode_batch_fast([shown], add_special_tokens=False)[0].ids, np.uint32)
            if spaced:
                edges = np.flatnonzero(self.edge[ids])
                size = np.diff(edges, append=len(ids)) if self.keeps_space else np.diff(edges, prepend=-1)
            else:
                mark = ids == self.bare_mark
                size, ids = np.diff(np.flatnonzero(mark), prepend=-1) - 1, ids[~mark]
            assert len(size) == len(part) and size.sum() == len(ids)
            made.append(self.runs.add(ids, size))
        run[run < 0] = np.concatenate(made)
        if keep:
            memory.add(new, np.concatenate(made))
        return run[coded.indices.to_numpy(zero_copy_only=False)]

    def _plain(self, parts: pa.StructArray, keep: bool) -> tuple[np.ndarray, np.ndarray]:
        """Runs of words that PLAIN takes apart, and whether each is its stem and no more."""
        a, x, _, b, y = (parts.field(i) for i in range(5))
        cols = np.zeros((len(a), 5), np.int64)
        low = a if self.keeps_space else pc.utf8_lower(a)
        cols[:, 0] = self._stems(low, True, keep)
        for k, stop in ((1, x), (4, y)):
            stop = stop.dictionary_encode()
            cols[:, k] = np.array([{"": 0, ".": self.dot, ",": self.comma}[s] for s in stop.dictionary.to_pylist()], np.int64)[stop.indices.to_numpy(zero_copy_only=False)]
        two = pc.binary_length(b).to_numpy(zero_copy_only=False) > 0
        if two.any():
            cols[two, 2] = self.line
            cols[two, 3] = self._stems(b.filter(pa.array(two)), False, keep)
        more = cols[:, 1:].any(1)
        ids, ends = self.runs.gather(cols[more].ravel())
        out = cols[:, 0].copy()
        out[more] = self.runs.add(ids, np.diff(ends[4::5], prepend=0))
        return out, ~more & pc.equal(a, low).to_numpy(zero_copy_only=False)

    def _fill(self, words: pa.StringArray, keep: bool) -> np.ndarray:
        """Runs of pieces (after a space) that the cache lacks; keep: it gets them."""
        parts = pc.extract_regex(words, PLAIN)
        # a second word only after a line break, and no line break without one
        second = pc.not_equal(pc.binary_length(parts.field(3)), 0)
        fits = pc.and_(pc.equal(second, pc.not_equal(parts.field(2), "")), pc.or_(second, pc.equal(parts.field(4), "")))
        fits = pc.fill_null(pc.and_(pc.is_valid(parts), fits), False).to_numpy(zero_copy_only=False)
        out, known = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        if fits.any():
            out[fits], known[fits] = self._plain(parts.filter(pa.array(fits)), keep)
        odd = pc.match_substring(words, MARK).to_numpy(zero_copy_only=False) & ~fits
        some = ~fits & ~odd
        if some.any():
            out[some] = self._marked(words.filter(pa.array(some)).to_pylist())
        if odd.any():
            out[odd] = self._each([" " + w for w in words.filter(pa.array(odd)).to_pylist()])
        if keep:
            self.where.add(words.filter(pa.array(~known)), out[~known])
        return out

    def flat(self, texts: pa.StringArray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none null), one behind the other, each followed by the id end if
        there is one, and the bounds of the texts in them."""
        count = len(texts)
        if not count:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if len(self.where.run) + len(self.after.run) > CACHED:
            self._evict()
        split = pc.split_pattern(texts if self.keeps_space else pc.replace_substring(texts, "\n", " "), " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        first = bounds[:-1]
        coded = split.flatten().dictionary_encode()
        piece = coded.indices.to_numpy(zero_copy_only=False)
        whole = np.zeros(count, bool)  # texts that go to the tokenizer whole
        if self.keeps_space:
            blank = pc.match_substring_regex(coded.dictionary, BLANK).to_numpy(zero_copy_only=False)
            if blank.any():
                suspect = np.flatnonzero(np.logical_or.reduceat(blank[piece], first))
                whole[suspect] = [UNSAFE.search(texts[i].as_py()) is not None for i in suspect.tolist()]
        # pieces that are needed: those of whole texts are not, nor first ones that stand after no space
        needed = np.ones(len(piece), bool)
        if whole.any():
            needed = ~np.repeat(whole, np.diff(bounds))
        if self.keeps_space:
            needed[first] = False
        live = np.zeros(len(coded.dictionary), bool)
        live[piece[needed]] = True
        words = coded.dictionary.filter(pa.array(live))
        run = self.where.find(words)
        short = pc.less_equal(pc.utf8_length(words), LONGEST).to_numpy(zero_copy_only=False)
        new = (run < 0) & short
        if new.any():
            run[new] = self._fill(words.filter(pa.array(new)), True)
        n, used = self.runs.n, self.runs.used  # what comes now is for this batch alone
        new = (run < 0) & ~short
        if new.any():
            run[new] = self._fill(words.filter(pa.array(new)), False)
        table = np.zeros(len(coded.dictionary), np.int64)
        table[live] = run
        runs = np.where(needed, table[piece], 0)
        if self.keeps_space:
            for some, source in ((~whole, coded.dictionary.take(pa.array(piece[first[~whole]]))), (whole, texts.filter(pa.array(whole)))):
                if len(source):
                    runs[first[some]] = self._each(source.to_pylist())
        ids, ends = self.runs.gather(runs)
        self.runs.n, self.runs.used = n, used
        limits = np.concatenate([[0], ends[bounds[1:] - 1]])
        if end is not None:
            ids = np.insert(ids, limits[1:], end)
            limits += np.arange(count + 1)
        del split, coded, words
        pa.default_memory_pool().release_unused()  # or it keeps what the largest batch took
        return ids, limits

    def encode(self, texts: list[str]) -> list[bytes]:
        """As ids(), by way of the cache."""
        ids, bounds = self.flat(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


@cache
def encoder(path: str) -> Encoder:
    """One encoder, with its cache, for each worker process."""
    return Encoder(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
