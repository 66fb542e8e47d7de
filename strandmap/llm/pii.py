"""Personal data by base patterns and bootstrapped contextual extraction.

Base spans (email, ip, card, phone) come from fixed patterns over each whole text. They are the
seeds of a bootstrap that runs on Spark:

1. One pass over the texts lists every seed and every other token that looks like an identifier (a digit
   and six characters or more, apart from base spans), each with its contexts: the one and the two tokens
   before it on its line, in lower case, where they have no digit. What follows works on this narrow table.
2. A context is a pattern of a kind if SUPPORT distinct seed values of the kind or more stand after it.
   Patterns and the distinct values after them form a bipartite graph, over all documents.
3. Plain words after a pattern (tokens that are neither) count against it, each distinct one once. A pattern
   has no part in the graph if they alone keep it below CONFIDENCE, whatever the scores.
4. Scores are iterated: a pattern is as good as the mean score of its distinct values and plain words; an
   unseen value is as good as one minus the product of (1 - score) of its patterns; seeds score 1, words 0.
5. Unseen values after a pattern that ends at CONFIDENCE or more are accepted. They are seeds of the
   next generation, whose patterns may be new ones; it ends when no value is new.
6. The places of unseen values after accepted patterns become spans of the pattern's kind.

Plain words are counted in two passes: over one in PART of the texts, by a hash, which proves most
patterns of common words to have too many; then over all texts for those that are left. A task sends no
more words of a pattern than are needed to rule it out. Both save work and change no result.

Base spans always stay. Patterns go to the tasks in groups of BROADCAST at most, one pass each.

Null texts count as empty and have no spans. Rows are told apart by doc_id and text, so null doc_ids
and doc_ids that recur with other texts keep their own spans. Empty tables give no rows. Extra columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, slices, texts, tune

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENCE, ROUNDS, BROADCAST, PART = 5, 0.8, 3, 100_000, 16
#: Hashes of plain words that a task remembers, so as not to send them again.
SENT = 300_000
UNSEEN = -1
TRAILING = ".,;:!?)\"'"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Matches begin where a run of digits begins: what fails there would fail further on as well.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"\S+")
NUMBERED = re.compile(r"[0-9]\S*")
JOINTS = frozenset("().-+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards; linear in the text."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def base(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind in KINDS, in code points, by start; matches that fail a check are dropped."""
    ip = [m.span() for m in IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split("."))] if "." in text else []
    card = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                card.append(m.span())
    phone = [m.span() for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15] if "+" in text else []
    return [emails(text) if "@" in text else [], ip, card, phone]


def written(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, own in zip(KINDS, spans, strict=True) for a, b in own)


def identifier(token: str) -> bool:
    return len(token) >= 6 and DIGIT.search(token) is not None


def token_start(text: str, a: int) -> int:
    while a and not text[a - 1].isspace():
        a -= 1
    return a


def contexts(text: str, line: int, start: int) -> list[str]:
    """The token and the two tokens before start, a token's first place, on the line that begins at line;
    those without a digit."""
    size, at, words = 64, start, []
    while at > line and len(words) < 3:  # of three tokens the first may be cut
        at = max(line, start - size)
        words, size = text[at:start].split(), 4 * size
    words = [w.lower() for w in words[-2:]]
    found = [" ".join(words), words[-1]] if len(words) > 1 else words
    return [c for c in found if not DIGIT.search(c)]


def marks(text: str, spans: list[list[tuple[int, int]]]) -> list[tuple[int, int, int, list[str]]]:
    """(kind, start, end, contexts) of all seeds and unseen identifiers that have a context, by start."""
    own = [(a, e, k) for k, found in enumerate(spans) for a, e in found]
    if own or DIGIT.search(text):
        taken, reach, i = sorted(own), 0, 0
        for m in NUMBERED.finditer(text):
            a, e = token_start(text, m.start()), m.end()
            while i < len(taken) and taken[i][0] < e:
                reach = max(reach, taken[i][1])
                i += 1
            if reach <= a:
                e = a + len(text[a:e].rstrip(TRAILING))
                if identifier(text[a:e]):
                    own.append((a, e, UNSEEN))
    out, line, before = [], 0, 0
    for a, e, k in sorted(own):
        line = max(line, text.rfind("\n", before, a) + 1)
        before = a
        if left := contexts(text, line, max(line, token_start(text, a))):
            out.append((k, a, e, left))
    return out


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        cols: dict[str, list] = {k: [] for k in ("counts", "spans", "kind", "value", "a", "e", "left")}
        for t in texts(b):
            spans = base(t)
            cols["counts"].append([len(x) for x in spans])
            cols["spans"].append(written(spans))
            own = [(k, t[a:e], a, e, left) for k, a, e, left in marks(t, spans)]
            for i, name in enumerate(("kind", "value", "a", "e", "left")):
                cols[name].append([x[i] for x in own])
        n = [pa.array([c[i] for c in cols["counts"]], pa.int64()) for i in range(4)]
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *n, b.column(2), pa.array(cols["spans"]), *(pa.array(cols[c], pa.list_(k)) for c, k in zip(("kind", "value", "a", "e", "left"), kinds, strict=True))],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "h", "base", "kind", "value", "a", "e", "left"],
        )


def within(text: str) -> set[tuple[int, int]]:
    """(line, token), both by number, of the tokens that overlap a base span."""
    spans = sorted(s for own in base(text) for s in own)
    out, at, i, reach = set(), 0, 0, 0
    for n, line in enumerate(text.split("\n") if spans else ()):
        for k, m in enumerate(WORD.finditer(line)):
            while i < len(spans) and spans[i][0] < at + m.end():
                reach = max(reach, spans[i][1])
                i += 1
            if reach > at + m.start():
                out.add((n, k))
        at += len(line) + 1
    return out


def plain_words(text: str, heads: dict[str, dict[str, str]]) -> Iterator[tuple[str, str]]:
    """(context, word) of each plain word after a wanted context. heads: by a context's last token, by
    the token before that or nothing, the context."""
    inside = None
    for n, line in enumerate(text.split("\n")):
        before = last = ""
        for k, word in enumerate(line.lower().split()):
            if (hit := heads.get(last)) and not (DIGIT.search(word) and identifier(word.rstrip(TRAILING))):
                found = [c for c in ((hit.get(before) if before else None), hit.get("")) if c]
                if found and ("@" in word or DIGIT.search(word) or JOINTS.issuperset(word)):
                    inside = within(text) if inside is None else inside
                    found = found if (n, k) not in inside else []
                word_ = word.rstrip(TRAILING)
                for c in found:
                    yield c, word_
            before, last = last, word


def _plain(wanted: dict[str, int]):
    """(ch, word): hashes of wanted contexts and of the distinct plain words after them; a null word
    says that there are more than the number wanted of the context."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[str, dict[str, str]] = {}
        for c in wanted:
            first, _, last = c.rpartition(" ")
            heads.setdefault(last, {})[first] = c
        hashed = {c: xxhash.xxh64_intdigest(c.encode("utf-8", "surrogatepass"), 42) for c in wanted}
        words: dict[str, set[int]] = {}
        over: list[int] = []

        def flush() -> pa.RecordBatch:
            left = [hashed[c] for c, own in words.items() for _ in own] + over
            right = [w for own in words.values() for w in own]
            words.clear()
            null = np.arange(len(left)) >= len(right)
            cols = [pa.array(np.array(left, np.uint64).view(np.int64)), pa.array(np.array(right + [0] * len(over), np.uint64).view(np.int64), mask=null)]
            over.clear()
            return pa.RecordBatch.from_arrays(cols, names=["ch", "word"])

        for b in slices(batches):
            for t in texts(b):
                for c, w in plain_words(t, heads):
                    own = words.setdefault(c, set())
                    own.add(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))
                    if len(own) > wanted[c]:  # it has too many: no more of it
                        first, _, last = c.rpartition(" ")
                        del heads[last][first], words[c]
                        over.append(hashed[c])
            if sum(map(len, words.values())) > SENT:  # what comes again is sent again, which does no harm
                yield flush()
        yield flush()

    return run


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h"))


def counted(docs: DataFrame, new: DataFrame, confidence: float) -> DataFrame:
    """(c, plain) of new contexts (c, ids): the distinct plain words after them, null if these rule them out."""
    ceiling = (1 - confidence) / confidence

    def count(some: DataFrame, todo: DataFrame) -> DataFrame:
        groups, out = -(-todo.count() // BROADCAST), None
        for g in range(groups):  # a pass over the texts for about BROADCAST contexts
            own = {r.c: int(r.ids * ceiling + 1e-9) for r in todo.where(F.pmod(F.xxhash64("c"), F.lit(groups)) == g).collect()}
            got = some.select("text").mapInArrow(_plain(own), "ch bigint, word bigint").distinct().groupBy("ch").agg(F.count("word").alias("n"), F.count_if(F.col("word").isNull()).alias("over"))
            out = materialize(got if out is None else out.union(got), "plain")
        rows = todo.withColumn("ch", F.xxhash64("c"))
        rows = rows.join(out, "ch", "left") if out is not None else rows.select("*", F.lit(0).alias("n"), F.lit(0).alias("over"))
        n = F.coalesce("n", F.lit(0))
        return rows.select("c", "ids", F.when((F.coalesce("over", F.lit(0)) == 0) & (n <= F.floor(F.col("ids") * ceiling + 1e-9)), n).alias("plain"))

    part = materialize(count(docs.where(F.pmod("h", F.lit(PART)) == 0), new), "part")
    left = part.where("plain is not null").select("c", "ids")
    out = part.where("plain is null")
    if not left.isEmpty():
        out = out.union(count(docs, left))
    return materialize(out.select("c", "plain"), "counted")


def bootstrap(docs: DataFrame, scanned: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame | None:
    """Unseen identifiers (doc_id, h, a, e, kind), h the text's hash; None if no pattern is good enough."""
    docs = keyed(docs)
    rows = scanned.select("doc_id", "h", F.explode(F.arrays_zip("kind", "value", "a", "e", "left")).alias("m")).select("doc_id", "h", "m.kind", "m.value", "m.a", "m.e", F.explode("m.left").alias("c"))
    pairs = materialize(rows.groupBy("c", "value").agg(F.max("kind").alias("kind")), "pairs")
    totals = pairs.groupBy("c").agg(F.count("*").alias("ids"))
    accepted, counts, good = None, None, None
    while True:
        known = pairs if accepted is None else pairs.join(accepted.withColumnRenamed("kind", "k"), "value", "left").select("c", "value", F.when(F.col("kind") >= 0, F.col("kind")).otherwise(F.coalesce("k", F.lit(UNSEEN))).alias("kind"))
        n = known.where("kind >= 0").groupBy("c", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= support)
        best = n.groupBy("c").agg(F.max(F.struct("n", (-F.col("kind")).alias("k"))).alias("m")).select("c", (-F.col("m.k")).cast("int").alias("pattern"))
        kept = materialize(best.join(totals, "c"), "patterns")
        new = kept if counts is None else kept.join(counts, "c", "left_anti")
        if not new.isEmpty():
            more = counted(docs, new.select("c", "ids"), confidence)
            counts = more if counts is None else materialize(counts.union(more), "counts")
        if counts is None:
            return None
        live = kept.join(counts.where("plain is not null"), "c")
        graph = materialize(known.join(live, "c").withColumn("s", F.when(F.col("kind") >= 0, 1.0).otherwise(0.0)), "graph")
        size = (F.first("ids") + F.first("plain")).alias("size")
        score = graph.groupBy("c").agg((F.sum("s") / (F.first("ids") + F.first("plain"))).alias("p"))
        for _ in range(rounds - 1):
            unseen = graph.where("s = 0").join(score, "c").groupBy("value").agg((1 - F.exp(F.sum(F.log1p(-F.least("p", F.lit(0.999999)))))).alias("u"))
            score = graph.join(unseen, "value", "left").groupBy("c").agg(F.sum(F.greatest("s", F.coalesce("u", F.lit(0.0)))).alias("s"), size).select("c", (F.col("s") / F.col("size")).alias("p"))
            score = materialize(score, "scores")
        drop(good)
        good = materialize(score.where(F.col("p") >= confidence).join(kept, "c").select("c", "pattern"), "good")
        found = graph.where("s = 0").join(good.select("c"), "c").groupBy("value").agg(F.min("pattern").alias("kind"))
        found = materialize(found, "found")
        drop(graph)
        drop(kept)
        if found.isEmpty():
            break
        accepted = found if accepted is None else materialize(accepted.union(found), "accepted")
    drop(pairs)
    if accepted is None:
        return None
    return rows.where(F.col("kind") == UNSEEN).join(good, "c").groupBy("doc_id", "h", "a", "e").agg(F.min("pattern").alias("kind"))


def merged(own: list[tuple[int, int, int]], found: list[dict] | None) -> list[tuple[int, int, int]]:
    """Base spans (kind, a, e) and found ones, sorted; of found ones that overlap the first, then longest, stays."""
    rows, end = list(own), -1
    for x in sorted(found or (), key=lambda x: (x["a"], -x["e"])):
        if x["a"] >= end:
            rows.append((x["kind"], x["a"], x["e"]))
            end = x["e"]
    return sorted(rows)


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest columns of base and found spans."""
    for b in batches:
        r = b.to_pydict()
        sha, spans = [], []
        for own, more in zip(r["base"], r["found"], strict=True):
            sha.append(hashlib.sha256(own.encode()).hexdigest())
            if more:
                rows = [(KINDS.index(k), int(a), int(e)) for k, a, e in (x.split(":") for x in own.split(",") if x)]
                own = ",".join(f"{KINDS[k]}:{a}:{e}" for k, a, e in merged(rows, more))
            spans.append(own)
        yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sha), pa.array(spans)], names=[*b.schema.names[:5], "base_sha256", "spans"])


COUNTS = ", ".join(f"n_{k} bigint" for k in KINDS)


def scan(docs: DataFrame) -> DataFrame:
    """Base spans of every row and, for the bootstrap, all seeds and unseen identifiers with their contexts, as a table."""
    return materialize(keyed(docs).mapInArrow(_scan, f"doc_id bigint, {COUNTS}, h bigint, base string, kind array<int>, value array<string>, a array<bigint>, e array<bigint>, left array<array<string>>"), "spans")


def with_found(rows: DataFrame, h: Column, more: DataFrame, name: str) -> DataFrame:
    """rows and, as column name, the found spans of their doc_id and text; a null doc_id matches itself."""
    found = more.groupBy("doc_id", "h").agg(F.collect_list(F.struct("a", "e", "kind")).alias(name)).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), name)
    return rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (h == found["_h"]), "left").select(*(rows[c] for c in rows.columns), found[name])


def find(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) for every row."""
    tune(docs.sparkSession)
    scanned = scan(docs)
    more = bootstrap(docs, scanned, **how)
    if more is None:
        rows = scanned.withColumn("found", F.expr("cast(null as array<struct<a: bigint, e: bigint, kind: int>>)"))
    else:
        rows = with_found(scanned, scanned["h"], more, "found")
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS), "base", "found").mapInArrow(_merge, f"doc_id bigint, {COUNTS}, base_sha256 string, spans string")


def masked(text: str | None, found: list[dict] | None) -> str | None:
    """The text with each base or found span replaced by its kind; of overlapping spans the first is."""
    if not text:
        return text
    spans = merged([(k, a, e) for k, own in enumerate(base(text)) for a, e in own], found)
    if not spans:
        return text
    out, done = [], 0
    for a, e, k in sorted((a, e, KINDS[k]) for k, a, e in spans):
        if a >= done:
            out += [text[done:a], f"<{k}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def _redacted(extra: bool):
    """Batches of the documents' columns with new texts; extra: a last column has the found spans."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols, names = list(b.columns), list(b.schema.names)
            found = cols.pop().to_pylist() if extra else [None] * b.num_rows
            names = names[: len(cols)]
            i = names.index("text")
            new = [masked(t, f) for t, f in zip(cols[i].to_pylist(), found, strict=True)]
            cols[i] = pa.array(new, cols[i].type)
            if "n_chars" in names:
                n = names.index("n_chars")
                cols[n] = pa.array([None if t is None else len(t) for t in new], cols[n].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def redact(docs: DataFrame, **how) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; all columns and rows kept.

    Base spans are found again in each row's own text; only spans that the bootstrap adds need a join."""
    tune(docs.sparkSession)
    more = bootstrap(docs, scan(docs), **how)
    if more is None:
        return docs.mapInArrow(_redacted(False), docs.schema)
    return with_found(docs, F.xxhash64(docs["text"]), more, "_found").mapInArrow(_redacted(True), docs.schema)
