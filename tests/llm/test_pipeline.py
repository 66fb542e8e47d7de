"""The pipeline against its stages by brute force."""

import corpus_pipeline
from strandmap.llm import lang_id, pii, simhash


def test_pipeline(spark, tmp_path):
    texts = [f"the house and the thing with number {i} there and with that other thing " * 3 for i in range(30)] + ["le éte çou être vous aux " * (3 + i) for i in range(30)]
    rows = [(i, t, "en" if i < 30 else "fr") for i, t in enumerate(texts)]
    rows += [(100, texts[3] + " ", "en"), (101, texts[3], "en"), (102, None, "en"), (103, "12 34", "en"), (104, "the house and the mail a@b.cd with that thing there", "en")]
    df = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {i: t for i, t, _ in rows if t and lang_id.LETTER.search(t)}
    best = {}
    for i, t in kept.items():
        best.setdefault("".join(t.split()), []).append((-len(t), i))
    kept = {i: kept[i] for i in (min(v)[1] for v in best.values())}
    fp = {i: simhash.fingerprint(simhash.shingle_hashes(t)) for i, t in kept.items()}
    reach = {i: i for i in fp}
    for _ in fp:
        reach = {i: min(reach[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 2) for i in fp}
    want = {i for i in fp if reach[i] == i}
    assert {r.doc_id for r in out} == want and 100 in want and 3 not in want and 102 not in want
    assert pii.base("the mail <email> with") == [[], [], [], []]
    docs = df.schema
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.names
    assert {r.doc_id: r.text for r in stage.collect()}[104] == "the house and the mail <email> with that thing there"


def test_pipeline_of_nothing(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_clashing_columns(spark, tmp_path):
    """Columns that are named like those that the operators make inside come through."""
    rows = [(i, f"the house and the thing {i % 4} with mail a{i}@b.cd there and so on", "en", "s", None, f"h{i}", i, "k", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, node bigint, kind string, recipe int")
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert {(r.doc_id, r.h, r.node, r.kind, r.recipe) for r in out.collect()} <= {(i, f"h{i}", i, "k", 1) for i in range(12)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 12


def test_near_stage_broadcasts_no_replicas(spark, tmp_path, monkeypatch):
    plans, components = [], simhash.components

    def seen(links):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return components(links)

    monkeypatch.setattr(simhash, "components", seen)
    docs = spark.createDataFrame([(i, f"the house and number {i % 7} there", "en", "s", None) for i in range(20)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert corpus_pipeline.near(spark, docs, str(tmp_path)).count() <= 7
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
