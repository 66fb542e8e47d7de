"""Each operator against brute force, on rows with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmap.llm import bpe, chat_format, common, embed_dedup, exact_dedup, lang_id, packing, pii, sample_pieces, sharding, simhash, token_table

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, key string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "x", "y") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = {"en": ["the", "and", "there", "with", "house", "thing"], "fr": ["le", "éte", "çou", "être", "vous", "aux"]}
    out = []
    for i in range(120):
        lang = rng.choice(["en", "fr"])
        out.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 80))), lang))
    base = " ".join(rng.choice(words["en"]) for _ in range(400))
    out += [(200 + i, base, "en") for i in range(10)]  # copies
    out += [(220, base.replace(" ", "\n"), "en"), (221, base + "  ", "en"), (222, base + " x", "en")]
    out += [(230, None, "en"), (231, "", None), (232, " \t\n", "fr"), (233, "123 ...", "en"), (234, "word " * 30000, "en"), (235, "a" * 100000, "en")]
    out += [(236, "mail a.b@c.de, ip 1.2.3.4 and 300.1.1.1, 4539 1488 0343 6467; +1 (650) 555-1234 \U0001f600x@y.z", "en")]
    out += [(0, out[0][1], "en"), (None, "no id here", "en"), (None, base, "en")]  # repeated row, null ids
    return out


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_empty_tables(spark):
    empty = docs_of(spark, [])
    for f in (exact_dedup.exact_groups, exact_dedup.exact_dedup, simhash.near_groups, simhash.near_dedup, pii.find, pii.redact, lang_id.predict, lang_id.identify, packing.pack_documents, sample_pieces.digests, sharding.assign):
        assert f(empty).count() == 0, f
    assert token_table.read(token_table.write(empty)).count() == 0
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
    assert chat_format.digests(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, rows, weak):
    name = (lambda c: bytes([len(c) % 3])) if weak else exact_dedup.digest
    out = exact_dedup.exact_groups(docs_of(spark, rows), name)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    want = []
    for i, t, _ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    assert got(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=str)


def test_chunks():
    rng = random.Random(1)
    data = bytes(rng.randrange(97, 122) for _ in range(300_000))
    parts = exact_dedup.chunks(data)
    assert b"".join(parts) == data and len(parts) > 20 and max(map(len, parts)) <= exact_dedup.MOST
    moved = exact_dedup.chunks(b"something before" + data)
    assert len(set(parts) & set(moved)) >= len(parts) - 2  # cuts follow content
    assert b"".join(exact_dedup.chunks(b"a" * 200_000)) == b"a" * 200_000


def test_golay_anchors():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 2000)
    leader, _ = simhash.tables()
    code = words ^ leader[simhash.remainder(words)]
    assert not simhash.remainder(code).any() and np.bitwise_count(words ^ code).max() <= 3
    fps = rng.integers(0, 1 << 63, 40).astype(np.int64)
    i, anchors = simhash.replicas(fps)
    have = set(zip(i.tolist(), anchors.tolist()))
    for k, fp in enumerate(fps.view(np.uint64).tolist()):
        for a in range(64):
            for b in range(a, 64):
                near = np.array([fp ^ (1 << a | 1 << b)], np.uint64).view(np.int64)
                assert (k, int(simhash.homes(near)[0])) in have


def slow_fingerprint(text):
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_near_groups(spark, rows):
    out = simhash.near_groups(docs_of(spark, rows))
    fps = [slow_fingerprint(t or "") for _, t, _ in rows]
    reach = list(range(len(rows)))
    for _ in rows:
        new = [min((reach[j] for j in range(len(rows)) if bin(fps[i] ^ fps[j]).count("1") <= 2)) for i in range(len(rows))]
        if new == reach:
            break
        reach = new
    least = {}
    for k, (i, _, _) in zip(reach, rows):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    want = [(i, f"{fp:016x}", least.get(k)) for (i, _, _), fp, k in zip(rows, fps, reach)]
    assert got(out, "doc_id", "fingerprint", "component_id") == sorted(want, key=str)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 300)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(350)] + [(5000, 5000 + i) for i in range(400)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    out = {r.node: r.component for r in common.components(df).collect()}
    want = {x: find(x) for x in parent if find(x) != x}
    assert {k: v for k, v in out.items() if k != v} == want


BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def slow_spans(text):
    out = []
    for kind, p in zip(pii.KINDS, BASE):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
                if not 13 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_random():
    rng = random.Random(7)
    bits = ["a", "@", ".", "b.c", "-", "1", "12", "255", "256", " ", "+", "4539148803436467", "(650)", "555", "_", "%", "é", "٣", "\n"]
    for _ in range(20000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert [(k, a, e) for k, own in zip(pii.KINDS, pii.base(t)) for a, e in own] == slow_spans(t), t


def test_pii_bootstrap(spark, rows):
    more = [(300 + i, f"some words. kontakt mail: user{i}@mail.example.com thanks", "en") for i in range(8)]
    more += [(320, "kontakt mail: user-at-7741-example now", "en"), (321, "the thing 12345678 and the house", "en")]
    data = [*rows, *more]
    out = {(r.doc_id, r.base_sha256): r for r in pii.find(docs_of(spark, data)).collect()}
    for i, t, _ in data:
        own = slow_spans(t or "")
        written = ",".join(f"{k}:{a}:{e}" for k, a, e in own)
        r = out[i, hashlib.sha256(written.encode()).hexdigest()]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in own) for x in pii.KINDS]
        if i == 320:  # unseen, found by its context
            assert r.spans == "email:14:34"
        else:
            assert r.spans == written
    clean = {r.doc_id: r for r in pii.redact(docs_of(spark, data)).where("doc_id >= 230").collect()}
    assert clean[320].text == "kontakt mail: <email> now" and clean[320].n_chars == len(clean[320].text)
    assert clean[236].text.startswith("mail <email>, ip <ip> and 300.1.1.1, <card>; <phone>") and clean[230].text is None


def test_language(spark, rows):
    out = lang_id.predict(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id in (230, 231, 232, 233):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    lang = {i: x for i, _, x in rows if i is not None and i < 120}
    held = [r for r in out if r.held_out and r.doc_id in lang]
    assert len(held) > 15 and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.9
    kept = {r.doc_id for r in lang_id.identify(docs_of(spark, rows)).collect()}
    assert not kept & {230, 231, 232, 233} and len(kept & set(range(120))) > 110


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = lang_id.ByteGru(["a", "b", "c"], 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, lengths = lang_id.padded([bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (7, 5, 7, 3)], 7)
    y = np.array([0, 1, 2, 1])
    _, g = net.gradients(data, lengths, y)
    for k, p in net.p.items():
        flat, i, e = p.reshape(-1), int(np.abs(g[k]).argmax()), 1e-6
        old = flat[i]
        flat[i] = old + e
        up = net.gradients(data, lengths, y)[0]
        flat[i] = old - e
        down = net.gradients(data, lengths, y)[0]
        flat[i] = old
        assert abs((up - down) / 2 / e - g[k].reshape(-1)[i]) < 1e-6, k


def test_encoder():
    rng = random.Random(1)
    bits = ["|", " | ", "a|b", " ", "  ", "\n", " \n", "\t", "a", "'s", "Don't", "é", "e\u0301", "\u0301", "Σ", "ΑΣ", "1", "23", ".", "!?", "\x1c", "\xa0", "\u3000", "日本", "<|endoftext|>", "\x00", "ß", "İ", "'", "\r\n", "\x85", "x", "The", "on.\nAnd"]
    texts = ["", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000))]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = bpe.Encoder(bpe.tokenizer_path(name))
        assert e.encode(texts) == e.ids(texts)
        assert [e.encode([t])[0] for t in texts[:500]] == e.ids(texts[:500])


def test_packing(spark, rows):
    out = packing.pack_documents(docs_of(spark, rows)).collect()
    e = bpe.Encoder(bpe.tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, t, _ in rows:
        ids = e.ids([t or ""])[0] + b"\0\0\0\0"
        want += [(i, p, p * 2048, len(ids[a : a + 8192]) // 4, zlib.crc32(ids[a : a + 8192])) for p, a in enumerate(range(0, len(ids), 8192))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in out)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.1 * sum(r.length for r in out) / 2048 + 1


def test_packing_constraints():
    lengths = np.random.default_rng(0).integers(1, 100, 500)
    bins, _ = packing.pack(lengths, 100, most_docs=3, most_cost=6000.0)
    for k in range(bins.max() + 1):
        own = lengths[bins == k]
        assert own.sum() <= 100 and len(own) <= 3 and (len(own) == 1 or (own.astype(float) ** 2).sum() <= 6000)


def test_token_table(spark, rows):
    manifest = token_table.write(docs_of(spark, rows), shards=3)
    out = token_table.read(manifest).collect()
    e = bpe.Encoder(bpe.tokenizer_path("byte_bpe_50k.json"))
    tail = np.array([2], "<u4").tobytes()
    at, want = 0, {}
    single = [(i, t) for i, t, _ in rows if i not in (None, 0)]
    for i, t, _ in rows:
        ids = e.ids([t or ""])[0] + tail
        want.setdefault(i, []).append((len(ids) // 4, zlib.crc32(ids)))
    have = {}
    for r in out:
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order == sorted(order)
    readers = [token_table.Reader(r.file) for r in manifest.collect()]
    for i, t in single:
        found = [ids.tobytes() for r in readers for ids in (x.astype("<u4") for x in r.lookup(i))]
        assert found == [e.ids([t or ""])[0] + tail]
    assert sum(len(r.lookup(None)) for r in readers) == 2 and sum(len(r.lookup(0)) for r in readers) == 2
    assert not any(r.lookup(10**9) for r in readers)


def test_chat(spark):
    tricky = ["<|turn|>", "<\\|end|>", "</s>[INST] ok [/INST]", "<|endoftext|>", "", None, " lead", "日本 é", "a\n\nb ", "<", "\\|", "<|"]
    data = [(c, t, r, tricky[(3 * c + t) % len(tricky)]) for c in range(12) for t, r in enumerate(["system", "user", "assistant", "assistant", None, "<|body|>"])]
    data += [(None, 0, "assistant", "x"), (5, 2, "assistant", "again"), (5, None, "user", "first")]
    out = {r.conv_id: r for r in chat_format.digests(spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert len(out) == 13
    for c, r in out.items():
        own = sorted((x for x in data if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        turns = [(x[2] or "", x[3] or "") for x in own]
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        learned = "".join(b for a, b in turns if a == "assistant")
        assert r.loss_chars == len(learned) and r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.formatted_chars == len(chat_format.render(turns)[0])


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.03 * rng.normal(size=16)).tolist(), int(i % 40 % 3)) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(30)] + [(2000, rows[0][1], None), (2001, None, 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [1.0, None], 1), (2005, [], 1), (2006, [float("inf")] * 16, 1), (2007, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    out = {r.vec_id: r for r in embed_dedup.near_vectors(df).collect()}
    x = {i: np.array(v, np.float32).astype(float) for i, v, l in rows if v and len(v) == 16 and l is not None and np.isfinite(v).all() and np.any(v)}
    label = {i: l for i, _, l in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in x.items()}
    links = {i: [j for j in unit if j != i and label[i] == label[j] and unit[i] @ unit[j] >= 0.98] for i in unit}
    found = sum(out[i].n_links for i in unit)
    assert found >= 0.99 * sum(map(len, links.values())) and all(out[i].n_links <= len(links[i]) for i in unit)
    exact = sum(out[i].n_links == len(links[i]) for i in unit)
    assert exact >= 0.99 * len(unit)
    for i in out:
        assert out[i].kept == (out[i].component_id == i)
        if i not in unit:
            assert out[i].n_links == 0 and out[i].component_id == i


def test_sampled_pieces(spark, rows):
    df = docs_of(spark, rows)
    out = got(sample_pieces.digests(df), "doc_id", "ids_crc32", "decoded_sha256")
    assert sorted(r[2] for r in out) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in rows)
    assert out == got(sample_pieces.digests(df.repartition(5)), "doc_id", "ids_crc32", "decoded_sha256")
    p = sample_pieces.pieces(bpe.tokenizer_path("piece_bpe_32k.model"))
    for t in ["▁a  b▁", " x", "\n\t", "日本語🙂", "", "a" * 100, "<0x41>", "\x00"]:
        assert sample_pieces.decode(p, sample_pieces.sample(p, [t], [1])[0]).decode() == t
    # the shares of all segmentations of one word
    unit = "▁ther"
    lattice = p.lattice(unit)

    def all_ways(end):
        if not end:
            return [([], 1.0)]
        return [(ids + [i], w * p.weight[i]) for k, i in lattice[end - 1] for ids, w in all_ways(end - k)]

    ways = all_ways(len(unit))
    total = sum(w for _, w in ways)
    n = 20000
    seen = {}
    for ids in sample_pieces.sample(p, ["ther"] * n, [sample_pieces.row_key(i) for i in range(n)]):
        seen[tuple(ids.tolist())] = seen.get(tuple(ids.tolist()), 0) + 1
    for ids, w in ways:
        assert abs(seen.get(tuple(ids), 0) / n - w / total) < 0.02


def test_shards(spark, rows):
    limit = 4000
    out = sharding.assign(docs_of(spark, [*rows, *[(900, "same text" * 100, "en")] * 20]), limit).collect()
    assert len(out) == len(rows) + 20
    size = {}
    for r in out:
        size[r.depth, r.bucket] = size.get((r.depth, r.bucket), 0) + r.n_bytes
    for r in out:
        assert r.shard_bytes == size[r.depth, r.bucket]
        assert r.shard_bytes <= limit or r.depth == sharding.DEEPEST
    # prefix-free
    for d, b in size:
        assert not any((e, b >> (d - e)) in size for e in range(d))
    assert {r.page for r in out if r.doc_id == 900} == {0, 1, 2, 3, 4}


def test_pii_null_and_repeated_ids(spark):
    texts = [f"kontakt mail: user{i}@mail.example.com thanks" for i in range(8)]
    texts += ["kontakt mail: user-at-7741-example now", "kontakt mail: other-at-99812-example", "ip 1.2.3.4 here", "nothing at all", None]
    docs = docs_of(spark, [(None if i % 2 else 5, t, "en") for i, t in enumerate(texts)])
    clean = sorted(str(r.text) for r in pii.redact(docs).collect())
    assert clean == sorted(["kontakt mail: <email> thanks"] * 8 + ["kontakt mail: <email> now", "kontakt mail: <email>", "ip <ip> here", "nothing at all", "None"])
    assert sorted(r.spans for r in pii.find(docs).collect()) == sorted([f"email:14:{14 + len(f'user{i}@mail.example.com')}" for i in range(8)] + ["email:14:34", "email:14:36", "ip:3:10", "", ""])


def test_embeddings_concentrated_label(spark):
    """Isolated pairs in a label whose vectors lie close together, in several cells and blocks; null ids name no component but carry it."""
    rng = np.random.default_rng(8)
    centre = np.ones(16) / 4

    def near(base, cosine):
        side = rng.normal(size=base.shape)
        side -= (side * base).sum(1, keepdims=True) * base
        return cosine * base + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=1, keepdims=True)

    x = near(np.tile(centre, (3000, 1)), 0.9**0.5)
    x = np.concatenate([x, near(x[:200], 0.983)])
    a = np.eye(16)[0]
    chain = [np.cos(t) * a + np.sin(t) * np.eye(16)[1] for t in (0, 0.15, 0.3)]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(9000, chain[0].tolist(), 1), (None, chain[1].tolist(), 1), (9002, chain[2].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    near_ones = x @ x.T >= 0.98
    np.fill_diagonal(near_ones, False)
    want = near_ones.sum(1)
    for how in ({}, {"cell": 300, "block": 16 * 100}):
        out = {r.vec_id: r for r in embed_dedup.near_vectors(df, **how).collect()}
        assert [out[i].n_links for i in range(len(x))] == want.tolist()
        least = list(range(len(x)))
        for _ in range(20):
            least = [min(least[j] for j in (i, *np.flatnonzero(near_ones[i]))) for i in range(len(x))]
        assert [out[i].component_id for i in range(len(x))] == least
        assert [out[i].component_id for i in (9000, None, 9002)] == [9000] * 3 and out[None].n_links == 2


def test_cells_meet_every_link():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 8))
    x[500:1000] = x[:500] + 0.04 * rng.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, cell, member = embed_dedup.cells(x, x[::100], 0.98)
    own, guests = {}, {}
    for r, c, m in zip(row.tolist(), cell.tolist(), member.tolist()):
        (own if m else guests).setdefault(r, set()).add(c)
    assert len(row) < 8 * len(x)
    for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1))):
        assert len(own[i]) == len(own[j]) == 1
        assert len(own[i] & own[j]) + len(own[i] & guests.get(j, set())) + len(own[j] & guests.get(i, set())) == 1


def test_pii_copies_of_a_plain_passage(spark):
    data = [(i, f"kontakt mail: user{i}@mail.example.com thanks", "en") for i in range(100)]
    data += [(200, "kontakt mail: user-at-7741-example now", "en")] + [(300 + i, "kontakt mail: siehe unten", "en") for i in range(60)]
    docs = docs_of(spark, data).repartition(6)
    assert {r.doc_id: r.spans for r in pii.find(docs).collect()}[200] == "email:14:34"
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[200] == "kontakt mail: <email> now" and clean[300] == "kontakt mail: siehe unten"
    # different plain words after it do count
    words = [(400 + i, f"kontakt mail: siehe{chr(97 + i // 26)}{chr(97 + i % 26)} unten", "en") for i in range(60)]
    assert {r.doc_id: r.spans for r in pii.find(docs_of(spark, data + words)).collect()}[200] == ""


@pytest.mark.parametrize("text, block", [("a b", 4096), ("a    b", 4096), ("thereandthere" * 3, 4096), ("thereandthere" * 6, 32)])
def test_sampled_pieces_shares(monkeypatch, text, block):
    """Shares of the pieces at every place equal those of forward and backward sums over the whole marked text."""
    monkeypatch.setattr(sample_pieces, "LONG", block, raising=False)
    p = sample_pieces.pieces(bpe.tokenizer_path("piece_bpe_32k.model"))
    whole = sample_pieces.MARK + text.replace(" ", sample_pieces.MARK)
    assert max(map(len, whole.split())) > 32 or " " in text
    lattice, size = p.lattice(whole), len(whole)
    weight = lambda i: p.weight[i] if i >= 0 else p.weight[-1] / 256
    front, back = [1.0] + [0.0] * size, [0.0] * size + [1.0]
    for e in range(1, size + 1):
        front[e] = sum(front[e - k] * weight(i) for k, i in lattice[e - 1])
    for e in range(size, 0, -1):
        for k, i in lattice[e - 1]:
            back[e - k] += weight(i) * back[e]
    n, seen = 6000, {}
    for ids in sample_pieces.sample(p, [text] * n, [sample_pieces.row_key(i) for i in range(n)]):
        at = 0
        for i in ids.tolist():
            seen[at, i] = seen.get((at, i), 0) + 1
            at += len(p.piece[i])
        assert at == size
    for e in range(1, size + 1):
        for k, i in lattice[e - 1]:
            share = front[e - k] * weight(i) * back[e] / front[size]
            assert i < 0 or abs(seen.get((e - k, i), 0) / n - share) < 0.03, (e, p.piece[i])


def test_sampled_pieces_long_runs():
    p = sample_pieces.pieces(bpe.tokenizer_path("piece_bpe_32k.model"))
    texts = ["a" * 20000, " " * 9000 + "x" + " " * 40, "日本語の文章" * 900, "https://a.b/" + "q7Zx%+" * 800, "a▁" * 3000, "\0" * 5000]
    for t, ids in zip(texts * 2, sample_pieces.sample(p, texts * 2, list(range(12)))):
        assert sample_pieces.decode(p, ids).decode() == t
    assert any(p.piece[i] == "▁" * 16 for i in sample_pieces.sample(p, [" " * 9000], [3])[0].tolist())


def test_dedup_null_and_repeated_ids(spark):
    data = [(5, "A text of some words"), (5, "B text of some words"), (3, "B text of some words"), (7, "C one"), (7, "C one"), (None, "D two"), (None, "D two"), (None, "E three"), (9, "E three"), (None, None), (None, "")]
    docs = docs_of(spark, [(i, t, "en") for i, t in data]).repartition(3)
    kept = got(exact_dedup.exact_dedup(docs), "doc_id", "text")
    assert len(kept) == 6 and set(kept) - {(None, None), (None, "")} == {(5, "A text of some words"), (3, "B text of some words"), (7, "C one"), (None, "D two"), (9, "E three")}
    fps = [slow_fingerprint(t or "") for _, t in data]
    reach = list(range(len(data)))
    for _ in data:
        reach = [min(reach[j] for j in range(len(data)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(data))]
    assert simhash.near_dedup(docs).count() == len(set(reach))


def test_near_groups_null_id_links(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    seen, i = [], 0
    while len(seen) < 3 and i < 4000:  # texts in a chain: neighbours within 2 bits, ends not
        i += 1
        chain = [" ".join(words), " ".join(words[:-1] + [f"x{i}"]), " ".join([f"y{i}", *words[1:-1], f"x{i}"])]
        a, b, c = map(simhash.fingerprint, map(simhash.shingle_hashes, chain))
        if 0 < (a ^ b).bit_count() <= 2 and 0 < (b ^ c).bit_count() <= 2 and (a ^ c).bit_count() > 2:
            seen = chain
    assert seen
    docs = docs_of(spark, [(1, seen[0], "en"), (None, seen[1], "en"), (2, seen[2], "en")])
    assert [r.component_id for r in simhash.near_groups(docs).collect()] == [1, 1, 1]
    assert got(simhash.near_dedup(docs), "doc_id") == [(1,)]


@pytest.mark.parametrize("shards", ["2", "64"])
def test_embeddings_do_not_depend_on_partitions(spark, shards):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + 0.02 * rng.normal(size=16)).tolist(), 0) for i in range(60)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        out = {r.vec_id: r.n_links for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [out[i] for i in range(60)] == ((x @ x.T >= 0.98).sum(1) - 1).tolist()


def slow_bootstrap(texts, support=5, confidence=0.8, rounds=3):
    """Spans of every text by the rules of the docstring, in plain loops over whole lists."""
    seen, plain, unseen_at = [], set(), []  # (context, value, kind), (context, word), (text, start, end, context, value)
    spans = [slow_spans(t) for t in texts]
    for i, t in enumerate(texts):
        at = 0
        for line in t.split("\n"):
            tokens = [(m.start() + at, m.end() + at, m[0].lower()) for m in re.finditer(r"\S+", line)]
            for k, (a, e, w) in enumerate(tokens):
                before = [x[2] for x in tokens[max(0, k - 2) : k]]
                left = [c for c in ([" ".join(before), before[-1]] if len(before) == 2 else before) if not re.search("[0-9]", c)]
                starts = [s for s in spans[i] if a <= s[1] < e]
                seen += [(c, t[s[1] : s[2]], pii.KINDS.index(s[0])) for s in starts for c in left]
                if any(s[1] < e and a < s[2] for s in spans[i]):
                    continue
                name = t[a:e].rstrip(".,;:!?)\"'")
                if len(name) >= 6 and re.search("[0-9]", name):
                    seen += [(c, name, -1) for c in left]
                    unseen_at += [(i, a, a + len(name), c, name) for c in left]
                else:
                    plain |= {(c, w.rstrip(".,;:!?)\"'")) for c in left}
            at += len(line) + 1
    kind = {}
    for c, v, k in seen:
        kind[c, v] = max(k, kind.get((c, v), -1))
    values, words = {}, {}
    for c, v in kind:
        values.setdefault(c, set()).add(v)
    for c, w in plain:
        words.setdefault(c, set()).add(w)
    known = {}
    while True:
        of = lambda c, v: kind[c, v] if kind[c, v] >= 0 else known.get(v, -1)
        pattern = {}
        for c, own in values.items():
            n = [sum(of(c, v) == k for v in own) for k in range(4)]
            if max(n) >= support and len(words.get(c, ())) <= len(own) * (1 - confidence) / confidence + 1e-9:
                pattern[c] = n.index(max(n))
        score = {c: sum(of(c, v) >= 0 for v in values[c]) / (len(values[c]) + len(words.get(c, ()))) for c in pattern}
        for _ in range(rounds - 1):
            u = {}
            for c in pattern:
                for v in values[c]:
                    if of(c, v) < 0:
                        u[v] = u.get(v, 1) * (1 - min(score[c], 0.999999))
            score = {c: sum(1 if of(c, v) >= 0 else 1 - u[v] for v in values[c]) / (len(values[c]) + len(words.get(c, ()))) for c in pattern}
        good = {c: k for c, k in pattern.items() if score[c] >= confidence}
        found = {}
        for c, k in good.items():
            for v in values[c]:
                if of(c, v) < 0:
                    found[v] = min(k, found.get(v, 9))
        if not found:
            break
        known |= {v: min(k, known.get(v, 9)) for v, k in found.items()}
    for i, a, e, c, _ in unseen_at:
        if c in good:
            spans[i].append((pii.KINDS[good[c]], a, e))
    return [",".join(f"{k}:{a}:{e}" for k, a, e in sorted(set(own), key=lambda s: (pii.KINDS.index(s[0]), s[1]))) for own in spans]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(12)
    ids = [f"user{i}" for i in range(40)]
    texts = [f"{rng.choice(['so', 'and', 'then'])} kontakt mail: {x}@mail.example.com thanks" for x in ids[:20]]
    texts += [f"kontakt mail: member-{i}-x now" for i in range(12)]  # found by their context
    texts += [f"the\nkonto inhaber member-{i}-x, or" for i in range(12)]  # these make a pattern of their own
    texts += ["konto inhaber other-99-y.", "konto inhaber third-1 " + "z" * 300 + " ip 1.2.3.4", "konto inhaber unbekannt", "kontakt mail: siehe\nmail: -"]
    texts += [f"host {i}.2.3.4 and the host 10.0.0.{i} and host name{i}" for i in range(30)]  # a bad pattern
    words = ["the", "host", "kontakt", "mail:", "+1 (650) 555-1234", "(", "-", "x1", "a@b.cd", "konto", "inhaber", "member-3-x", "İx", "12", "\n", "serial-77123"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    return texts


def test_pii_against_brute_force(spark, planted):
    want = slow_bootstrap(planted)
    docs = docs_of(spark, [(i, t, "en") for i, t in enumerate(planted)]).repartition(5)
    out = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert [out[i] for i in range(len(planted))] == want
    base_only = [",".join(f"{k}:{a}:{e}" for k, a, e in slow_spans(t)) for t in planted]
    added = [i for i, (x, y) in enumerate(zip(want, base_only)) if x != y]
    assert {20, 31, 32, 44} <= set(added)  # both generations


@pytest.mark.parametrize("name, value", [("BROADCAST", 2), ("PART", 1), ("PART", 1000), ("SENT", 1)])
def test_pii_limits_change_nothing(spark, monkeypatch, planted, name, value):
    monkeypatch.setattr(pii, name, value)
    docs = docs_of(spark, [(i, t, "en") for i, t in enumerate(planted)]).repartition(3)
    out = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert [out[i] for i in range(len(planted))] == slow_bootstrap(planted)


def test_shards_written_and_read(spark, rows, tmp_path):
    limit = 4000
    data = [*rows, *[(900, "same text" * 100, "en")] * 20, *[(901, text, "en") for text in ("a", "b", "a", None)]]
    docs = docs_of(spark, data).repartition(4).withColumn("depth", F.lit("mine"))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    sharding.write(docs, str(tmp_path / "out"), limit)
    files = spark.read.parquet(str(tmp_path / "out"))
    assert got(files, "doc_id", "text", "lang", "depth") == sorted(((i, t, lang, "mine") for i, t, lang in data), key=str)
    cols = ("doc_id", "n_bytes", "depth", "bucket", "shard_bytes")
    back, plan = sharding.read(spark, str(tmp_path / "out")), sharding.assign(docs, limit)
    assert got(back, *cols) == got(plan, *cols)
    size = {}
    for r in back.collect():
        size.setdefault((r.depth, r.bucket, r.page), []).append(r.n_bytes)
    assert all(sum(v) <= limit or len(v) == 1 for v in size.values())
    sharding.write(docs_of(spark, []), str(tmp_path / "none"), limit)
    assert sharding.read(spark, str(tmp_path / "none")).count() == 0


def test_letters_alone_are_letters(spark):
    learn = [(i, f"the house and the thing {i}" if i % 2 else f"le éte vous aux {i}", "en" if i % 2 else "fr") for i in range(60)]
    docs = docs_of(spark, learn + [(100 + i, t, "en") for i, t in enumerate(["½", "² ⑤", "ⅷ", "⑤ 12"])])
    out = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.predict(docs).collect()}
    assert all(out[100 + i] == ("und", 0.0) for i in range(4))


def test_languages_and_rows_are_parameters(spark):
    docs = docs_of(spark, [(i, f"text {i}", f"l{i % 7}") for i in range(300)])
    assert len({lang for _, lang in lang_id.sample(docs)}) == 7
    assert {lang for _, lang in lang_id.sample(docs, rows=5, languages=3)} < {f"l{i}" for i in range(7)}


def test_forward_pass_by_loops():
    """The pooled probabilities of a text against one position and unit after another."""
    net = lang_id.ByteGru(["a", "b", "c"], 3, seed=9)
    texts = ["the house", "é" * 200 + "x", "z"]
    P = {k: v.astype(float) for k, v in net.p.items()}
    squash = lambda x: x / (1 + abs(x))
    for text, got_probs in zip(texts, lang_id.document_probs(net, texts)):
        total, n = np.zeros(3), 0
        data = text.encode()
        for w in (data[i : i + lang_id.WINDOW] for i in range(0, len(data), lang_id.WINDOW)):
            states = []
            for d, order in ((0, range(len(w))), (1, range(len(w) - 1, -1, -1))):
                s, seen = [0.0] * 3, {}
                for t in order:
                    gate = lambda g, v: [P["X" + g][d][w[t]][j] + sum(v[i] * P["U" + g][d][i][j] for i in range(3)) for j in range(3)]  # noqa: E731, B023
                    z, r = ([0.5 + 0.5 * squash(x) for x in gate(g, s)] for g in "zr")
                    c = [squash(x) for x in gate("c", [a * b for a, b in zip(r, s)])]
                    s = [a + k * (b - a) for a, k, b in zip(s, z, c)]
                    seen[t] = s
                states.append(seen)
            for t in range(len(w)):
                h = states[0][t] + states[1][t]
                e = np.exp([P["b"][k] + sum(h[i] * P["V"][i][k] for i in range(6)) for k in range(3)])
                total += e / e.sum()
                n += 1
        assert np.abs(total / n - got_probs).max() < 1e-4


@pytest.mark.parametrize("most_docs, most_cost", [(None, None), (3, 5000.0), (5, None), (None, 3000.0)])
def test_packing_choice_by_loops(most_docs, most_cost):
    """Every piece's bin against a search of all open bins, scored in plain numbers."""
    lengths = np.random.default_rng(4).integers(1, 101, 400)
    cap, docs, cost = 100, most_docs or 100, most_cost or 100.0 * 100
    w = [x / c for x, c in zip(packing.WEIGHTS, (cap, docs, cost))]
    bins, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = (int(lengths[i]), 1, float(lengths[i]) ** 2)
        fits = [b for b in bins if all(r >= x for r, x in zip(b["rest"], need))]
        if not fits:
            fits = [{"rest": [cap, docs, max(cost, need[2])], "own": []}]
            bins += fits
        dot = lambda b: sum((c - r) * x * v / c for r, x, v, c in zip(b["rest"], need, w, (cap, docs, cost)))
        top = max(map(dot, fits))
        near = [b for b in fits if dot(b) >= top - 1e-12]
        free = lambda b: sum(((r - x) * v) ** 2 for r, x, v in zip(b["rest"], need, w))
        low = min(map(free, near))
        best = [b for b in near if free(b) <= low * (1 + 1e-12)]
        where[i] = best
        best[0]["own"].append(i)
        best[0]["rest"] = [r - x for r, x in zip(best[0]["rest"], need)]
    made, offsets = packing.pack(lengths, 100, most_docs, most_cost)
    assert made.max() + 1 == len(bins)
    content = lambda groups: sorted(sorted(int(lengths[i]) for i in g) for g in groups)
    assert content([b["own"] for b in bins]) == content([np.flatnonzero(made == k) for k in range(len(bins))])


def test_sampled_pieces_hash_collisions(monkeypatch):
    """With hashes that meet other strings, texts still come back whole."""
    p = sample_pieces.Pieces(bpe.tokenizer_path("piece_bpe_32k.model"))
    find = p.find
    wrong = int(p.ids["the"])
    monkeypatch.setattr(p, "find", lambda h: np.where((find(h) < 0) & (h % np.uint64(11) == 0), wrong, find(h)))
    import pyarrow as pa

    texts = [f"there and thing {i} zq▁x  y" for i in range(50)]
    raw = [sample_pieces.decode(p, x).decode("utf-8", "replace") for x in sample_pieces.sample(p, texts, list(range(50)))]
    assert raw != texts
    ids, back = sample_pieces.checked(p, pa.array(texts), list(range(50)))
    assert [b.decode() for b in back] == texts


def test_token_table_wide_ids(tmp_path):
    for ids, width in (([1, 70_000], 4), ([1, 65_535], 2)):
        with open(tmp_path / f"{width}", "wb") as f:
            w = token_table.Writer(f, width)
            w.add(token_table.key_of(3), np.array(ids, np.uint32))
            w.close()
        assert token_table.Reader(str(tmp_path / f"{width}")).lookup(3)[0].tolist() == ids
    with open(tmp_path / "x", "wb") as f, pytest.raises(ValueError):
        token_table.Writer(f, 2).add(token_table.key_of(3), np.array([70_000], np.uint32))


def test_token_table_shards_by_size(spark, monkeypatch):
    monkeypatch.setattr(token_table, "SHARD_DOCS", 10)
    docs = docs_of(spark, [(i if i < 150 else None, f"text {i}", "en") for i in range(300)])
    manifest = token_table.write(docs)
    assert manifest.count() >= 25  # the rows without an id as well
    assert token_table.read(manifest).count() == 300


def test_other_tables_with_clashing_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist(), 0, f"n{i}", i, 2.0) for i in range(20)] + [(99, None, 0, "x", 1, 0.0)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, node string, rep bigint, n double")
    assert embed_dedup.near_vectors(vectors).count() == 21
    talk = spark.createDataFrame([(1, 0, "user", "hi", "x", 3), (1, 1, "assistant", "ho", "y", 4)], "conv_id bigint, turn bigint, role string, text string, loss string, ids int")
    assert [(r.n_turns, r.loss_chars) for r in chat_format.digests(talk).collect()] == [(2, 2)]


def test_packing_with_binding_limits(spark, rows):
    """Documents and attention cost bind: more sequences, each within all three."""
    docs = docs_of(spark, rows)
    bins = {}
    for r in packing.pack_documents(docs, most_docs=4, most_cost=1024.0**2).collect():
        bins.setdefault(r.sequence_id, []).append(r.length)
    wide = packing.pack_documents(docs).select("sequence_id").distinct().count()
    assert len(bins) > wide
    assert all(sum(v) <= 2048 and len(v) <= 4 and (len(v) == 1 or sum(x * x for x in v) <= 1024**2) for v in bins.values())


def test_replicas_are_not_broadcast(spark):
    """The classes' files are small, their replicas are about 61 times as many rows."""
    classes = common.materialize(spark.range(2000).select((F.col("id") * 7919).alias("fp"), F.col("id").alias("rep")), "classes")
    plan = simhash.links(classes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Broadcast")


def test_groups_send_no_documents_through_the_driver(spark, rows, monkeypatch):
    """Files of copies are small however many rows they hold, so that Spark would broadcast a row for each document."""
    plans, materialize = {}, simhash.materialize

    def seen(df, name):
        plans[name] = broadcasts(df)
        return materialize(df, name)

    monkeypatch.setattr(simhash, "materialize", seen)
    out = simhash.near_groups(docs_of(spark, rows))
    assert broadcasts(out) == 0
    assert plans and not any(plans.values())
    assert out.count() == len(rows)


def test_components_of_many_edges(spark, monkeypatch):
    """Beyond FEW_EDGES nothing is broadcast; the components are the same, a hub's too, and no table of a round is left."""
    edges = [(i, i + 1) for i in range(0, 200)] + [(5000 + i, 5000) for i in range(300)] + [(900 + i % 7, 910 + i) for i in range(60)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    few = got(common.components(df), "node", "component")
    plans, paths, dropped, materialize, drop = [], [], [], common.materialize, common.drop

    def seen(df, name):
        plans.append(broadcasts(df))
        out = materialize(df, name)
        paths.append(out._strandmap_path)
        return out

    monkeypatch.setattr(common, "materialize", seen)
    monkeypatch.setattr(common, "drop", lambda df: (dropped.append(getattr(df, "_strandmap_path", None)), drop(df)))
    monkeypatch.setattr(common, "FEW_EDGES", 0, raising=False)
    assert got(common.components(df), "node", "component") == few
    assert not any(plans)
    assert set(paths) - set(dropped) == {paths[-1]}
