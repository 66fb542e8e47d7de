"""The queries against their SQL on a small folder of tables with nulls, copies, long words and planted cases."""

import random

import numpy as np
import pytest

from strandmap.llm import queries

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, gen = random.Random(21), np.random.default_rng(21)
    words = ["the", "House", "thing", "and", "é" * 20, "x" * 45, "日本", "of", "with"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [texts[0] + " ", texts[1], None, "", " \n\t", "one", "one two", texts[2] + " end", "W" * 200 + " a b c"]
    texts += ["mail a.b@c.de x@y.z, ip 1.2.3.4 256.1.1.1 00001.2.3.4", "4539 1488 0343 6467 and 4539-1488-0343-6468 +1 (650) 555-1234", "@a.b é@b.c +12 1.2.3.4.5.6.7.8"]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    base = gen.normal(size=(12, 8))
    vectors = [(i, (base[i % 12] + 0.05 * gen.normal(size=8)).tolist(), i % 3) for i in range(120)]
    vectors += [(200, vectors[0][1], 0), (201, vectors[0][1], None), (202, None, 0), (203, [0.0] * 8, 0), (204, [float("nan")] * 8, 1), (205, [1.0, None], 1), (206, [], 1)]
    tricky = ["<|turn|>", "<\\|end|>", "", None, " lead", "日本 é", "<\\\\|x", "ok"]
    turns = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(tricky)) for c in range(20) for t in range(rng.randint(1, 6))]
    path = tmp_path_factory.mktemp("tables")
    for name, rows, schema in (
        ("documents", docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        ("embeddings", vectors, "vec_id bigint, embedding array<float>, label int"),
        ("conversations", turns, "conv_id bigint, turn bigint, role string, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(path / f"{name}.parquet"))
    return str(path)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    out = queries.QUERIES[name](spark, folder)
    want = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(out.columns)
    have = sorted((tuple(r[c] for c in cols) for r in out.collect()), key=str)
    assert have == sorted(want.fetchall(), key=str)
    if name == "op5_embedding_dedup":
        assert sum(r[1] for r in have) > 100
    if name == "op1_pii":
        assert sum(r[1] for r in have) >= 2 and sum(r[3] for r in have) >= 1
