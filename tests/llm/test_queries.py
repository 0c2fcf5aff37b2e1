import pytest
from pyspark.sql import functions as F

from tests.oracle import rows, same
from tidewright.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    same(q.QUERIES[name](spark, sf), q.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op9_license_scan"])
def test_odd_rows_match_sql(spark, odd, name):
    same(q.QUERIES[name](spark, odd), q.ORACLE_SQL[name], odd)


def test_odd_documents_lose_lines_as_in_sql(spark, odd):
    same(q.QUERIES["op3_line_dedup"](spark, odd), q.ORACLE_SQL["op3_line_dedup"], odd)


def test_odd_pages_match_sql(spark, tmp_path):
    big = "<p>" + "ä" * 200
    rows = [(1, "a", big, 1), (1, "a", big, 2), (None, None, big, 3), (2, "b\r\nc", None, 4), (3, "", "", 5), (4, "x", big, 6), (4, "y", "other" * 30, 7), (0, "z", "x" * 200_000, 8)]
    spark.createDataFrame(rows, "page_id long, url string, html string, digest long").write.parquet(f"{tmp_path}/pages.parquet")
    same(q.QUERIES["op2_warc"](spark, str(tmp_path)), q.ORACLE_SQL["op2_warc"], str(tmp_path))


def test_odd_conversations_match_sql(spark, tmp_path):
    rows = [(1, 0, "user", "a", 1), (1, 0, "user", "a", 1), (1, 1, "assistant", None, 2), (2, None, None, "<|end|>\\l[", 3), (2, 1, "assistant", "é" * 50_000, 4), (3, 1, "assistant", "", 5), (3, 1, "user", "b", 6)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss long").write.parquet(f"{tmp_path}/conversations.parquet")
    same(q.QUERIES["op6_chat_format"](spark, str(tmp_path)), q.ORACLE_SQL["op6_chat_format"], str(tmp_path))


@pytest.mark.parametrize("name", [f"op{n}_" for n in range(1, 14)])
def test_every_operator_is_registered(name):
    assert len([x for x in q.QUERIES if x.startswith(name)]) == 1


def test_reruns_agree(spark, sf):
    one, two = (q.QUERIES["op7_mix"](spark, sf) for _ in range(2))
    assert rows(one.columns, [tuple(r) for r in one.collect()]) == rows(two.columns, [tuple(r) for r in two.collect()])


def test_extra_columns_are_harmless(spark, odd):
    from tidewright.llm import decontaminate, jaccard, licenses, linededup, mixing, quality, toxicity

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("kept", "n_words", "k", "t", "p", "r", "o", "pos", "node", "score", "predicted", "size", "key", "uid", "n_lines", "first", "block", "labels", "item_id", "class_id", "target", "taken", "n")])
    bench = spark.createDataFrame([(1, "nothing like this stands anywhere in the documents of this test")], "item_id long, text string")
    n = docs.count()
    assert quality.quality(clash).count() == n
    assert linededup.line_dedup(clash).count() == n
    assert licenses.scan(clash).count() == n
    assert jaccard.classes(clash).count() == n
    assert mixing.taken(clash).count() == n
    assert decontaminate.clean(clash, bench).count() == n
    labels = spark.createDataFrame([(14, 1, 1), (11, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(clash, toxicity.fit(clash, labels)).count() == n


def test_extra_columns_of_pages_and_turns_are_harmless(spark):
    from tidewright.llm import chat, html, warc

    clash = [F.lit(1).alias(c) for c in ("digest", "bytes", "kind", "refers_to", "first", "n", "text", "n_chars", "archive", "offset", "payload", "t", "loss", "formatted", "content", "held")]
    pages = spark.createDataFrame([(1, "u", "<p>" + "word " * 300 + "</p>"), (2, None, None)], "page_id long, url string, html string").select("*", *clash)
    assert html.extract(pages).count() == 2 and warc.read_archives(warc.write_archives(pages)).count() == 2
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, words string").withColumn("parts", chat.text_parts(F.col("words"))).select("*", *clash)
    assert chat.digests(chat.format_chat(turns)).first().n_turns == 2


def test_empty_tables(spark, empty):
    from tidewright.llm import chat, decontaminate, html, jaccard, licenses, linededup, mixing, quality, toxicity, warc

    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    turns = spark.createDataFrame([], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    for df in (
        quality.quality(empty),
        linededup.line_dedup(empty),
        licenses.scan(empty),
        jaccard.classes(empty),
        jaccard.unique(empty),
        mixing.taken(empty),
        decontaminate.overlaps(empty, bench),
        decontaminate.clean(empty, bench),
        toxicity.score(empty, toxicity.fit(empty, labels)),
        html.extract(pages),
        warc.read_archives(warc.write_archives(pages)),
        chat.digests(chat.format_chat(turns)),
    ):
        assert df.count() == 0
