import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import WORDS
from tests.llm.test_dedup import brute
from tidewright.llm import decontaminate, linededup, toxicity
from tidewright.session import materialise


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialise(stage(spark, docs, sf), f"stage{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        if k == 0:
            model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert out.count() == toxicity.score(docs, model).where("score < 0.5").count() < docs.count()
        if k == 1:
            assert out.count() == docs.count() and out.where(F.length("text") != F.col("n_chars")).count() == 0
        if k == 2:
            classes = brute([(r.doc_id, r.text) for r in docs.collect()])
            assert {r.doc_id for r in out.collect()} == {c for _, c, _ in classes}
        if k == 3:
            hit = {r.doc_id for r in decontaminate.overlaps(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - hit
        if k == 4:
            assert out.count() == docs.count() and out.where("taken > 2 * size").count() == 0
        docs = out


def test_run_is_the_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_passages_go_wherever_they_begin(spark, sf):
    rng = random.Random(6)
    plain = lambda n: [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(n)]
    said = plain(90)
    shouted = [f"{w.upper()}!!" for w in plain(90)]
    docs = [(100 * p + k, " ".join(plain(20 + k) + passage + plain(25))) for p, passage in enumerate((said, shouted)) for k in range(20)]
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), sf).collect()}
    for i, text in docs:
        inner = (said, shouted)[i // 100]
        left = sum(w in inner for w in got[i].split())
        assert (got[i] == text) if i % 100 == 0 else left < 60, i


def test_lines_join_to_the_text(spark):
    texts = ["a\x01b \x02 c\x02a, d\x02b e\n\n f.  g! ", "", " \n", "one", "é " * 50, "x" * 100_000 + " y" * 30, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", linededup.lines("t").alias("p")).collect()
    assert [r.p and "".join(r.p) for r in rows if r.t and r.t.strip()] == [t.lstrip() for t in texts if t and t.strip()]
    assert rows[-1].p is None


def test_odd_and_empty_documents_pass_all_stages(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(14, 1, 1), (11, 1, 0), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing like this stands anywhere in the documents of this test at all"), (2, None), (3, "")], "item_id long, text string")
    for name, docs in (("odd", spark.read.parquet(f"{odd}/documents.parquet")), ("none", empty)):
        folder = f"{tmp_path}/{name}"
        docs.withColumn("node", F.lit(1)).withColumn("score", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert (not got) if name == "none" else {1, 4, 10, 12} <= {r.doc_id for r in got}
        assert len({r.doc_id for r in got if r.doc_id in (6, 7, 8)}) <= 1  # copies
