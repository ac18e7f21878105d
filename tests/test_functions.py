"""Highlighting, SQL functions, sources, streaming, and the entry module."""

import importlib

import pytest
from pyspark.sql import functions as F

from textloom.functions import registry
from textloom.functions.highlight import highlight, snippet
from textloom.functions.spans import minimal, spans
from textloom.plans.query import parse
from textloom.sources import files
from textloom.sources.index import MANY, PENDING_ROWS, IndexFailure, SearchIndex
from textloom.streaming.ingest import ingest


def test_highlight():
    q = parse('"big bad wolf" OR beer')
    assert highlight("the big bad wolf ate a big grey wolf", q) == "the <b>big bad wolf</b> ate a big grey wolf"
    assert highlight("craft pale beer and more beer", q) == "craft pale <b>beer</b> and more <b>beer</b>"
    assert highlight("send an e-mail, then e mail", parse("e-mail"), "[", "]") == "send an [e-mail], then [e mail]"
    assert highlight("nothing", q) == "nothing" and highlight("", q) == ""


def test_snippet():
    text = "filler " * 50 + "the big bad wolf" + " filler" * 50
    assert snippet(text, parse('"big bad wolf"'), 8) == "…filler the <b>big bad wolf</b> filler filler filler…"
    assert snippet("a b c", parse("z"), 2) == "a b…"
    assert snippet("a b c", parse("a"), 0) == "" and snippet("...", parse("a")) == ""


def test_intervals():
    assert minimal([(0, 5), (1, 4), (1, 4), (6, 9), (7, 8)]) == [(1, 4), (7, 8)]
    places = {"a": [0, 5], "b": [2, 6]}
    assert spans(parse("a b"), lambda leaf: places[leaf.text]) == [(0, 2), (2, 5), (5, 6)]


def test_sql_functions(spark, tmp_path):
    registry.register(spark)
    one = lambda sql: spark.sql(sql).first()[0]
    assert one("SELECT text_match('Raw DENIM jacket', '(denim OR chino) -stretch')") is True
    assert one("SELECT text_match(CAST(NULL AS STRING), 'a')") is None
    assert one("SELECT search_distance('MSKU0007919', 'msku00079')") == 1.0
    assert one("SELECT search_distance('a', 'zzzz')") == float("inf")
    assert one("SELECT search_match('a', '')") is False
    assert one("SELECT highlight('a b', 'b')") == "a <b>b</b>"
    assert one("SELECT snippet('a b', 'b')") == "a <b>b</b>"
    with pytest.raises(Exception, match='invalid query "-only": negation needs a positive term beside it'):
        one("SELECT text_match('x', '-only')")
    index = SearchIndex.build(spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string"), f"file://{tmp_path}/x")
    registry.register_index(index, "x")
    want = {r.doc_id: r.score for r in index.score("a^2 b", matching=False).collect()}
    assert one("SELECT bm25_score_x('a b', 'a^2 b')") == pytest.approx(want[1])
    assert '"matches": true' in one("SELECT explain_score_x('a b', 'a^2 b')")
    assert one("SELECT live_docs FROM x_stats") == 2 and one("SELECT docs FROM x_segments") == 2
    assert index.cache().ids("a").count() == 1
    assert index.cache_stats().first().tables >= 0
    index.uncache()


def test_sources(spark, tmp_path):
    (tmp_path / "l.txt").write_text("one\ntwo\n")
    assert [r.text for r in files.lines(spark, f"{tmp_path}/l.txt").collect()] == ["one", "two"]
    (tmp_path / "q.tsv").write_text('exact\t"a b"\t3\n')
    assert tuple(files.query_set(spark, f"{tmp_path}/q.tsv").first()) == ("exact", '"a b"', 3)
    (tmp_path / "c.csv").write_text("1,x\n")
    assert tuple(files.csv_documents(spark, f"{tmp_path}/c.csv", "doc_id long, text string").first()) == (1, "x")
    (tmp_path / "p.xml").write_text('<posts>\n  <row Id="7" Title="A &amp; B" Body="&lt;p&gt;x &amp;lt; y&lt;/p&gt;" />\n</posts>\n')
    assert tuple(files.posts_xml(spark, f"{tmp_path}/p.xml").first()) == (7, "A & B x < y")
    files.write_tsv(spark.createDataFrame([(1, "a b")], "i long, t string"), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").first()[0] == "1\ta b"


def test_segments_are_checked_merged_when_due_and_estimated(spark, tmp_path):
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    index = SearchIndex.build(docs((1, "a b"), (2, "b c")), f"file://{tmp_path}/i")
    assert not index.due() and index.selectivity("b") == 1.0 and index.selectivity("zebra") == 0.0
    index.append(docs((3, "c d")))
    sized = lambda *sizes: SearchIndex(spark, "x", {"segments": [{"bytes": b} for b in sizes]})
    assert not sized(100, 25).due() and sized(100, 26).due() and not sized().due()
    assert sized(100, 50).due(budget=300) and not sized(100, 50).due(budget=299)
    assert sized(10_000, *[1] * MANY).due() and not sized(10_000, *[1] * (MANY - 1)).due()
    index.verify()
    folder = tmp_path / "i" / "segments" / index.manifest["segments"][0]["name"] / "docs"
    for part in folder.glob("*.parquet"):
        part.unlink()
    with pytest.raises(IndexFailure):
        index.verify()
    assert SearchIndex.empty(spark, f"file://{tmp_path}/e").selectivity("a") == 0.0


def test_one_large_append_stays_pending(spark, tmp_path):
    """Above PENDING_ROWS, too: there is nothing to join it with; a second one is joined with it."""
    some = lambda a, b: spark.range(a, b).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    index = SearchIndex.build(some(0, 5), f"file://{tmp_path}/i")
    index.append(some(5, PENDING_ROWS + 10))
    assert [(r.pending, r.docs, r.postings) for r in index.segments().collect()] == [(False, 5, 10), (True, PENDING_ROWS + 5, 2 * PENDING_ROWS + 10)]
    assert tuple(index.stats().select("segments", "live_docs", "pending_docs", "generation").first()) == (1, PENDING_ROWS + 10, PENDING_ROWS + 5, 2)
    index.append(some(PENDING_ROWS + 10, PENDING_ROWS + 11))
    assert sorted((r.pending, r.docs) for r in index.segments().collect()) == [(False, 5), (False, PENDING_ROWS + 6)]


def test_postings_are_made_where_their_documents_are(spark, tmp_path, monkeypatch):
    """No word or posting is dealt out by range, in building or in merging, and texts are joined without sorting them."""
    rows = spark.range(0, 40).select(F.col("id").alias("doc_id"), F.concat(F.lit("a w"), "id").alias("text"))
    monkeypatch.setattr(type(rows), "repartitionByRange", lambda *_: pytest.fail("dealt out by range"))
    index = SearchIndex.build(rows.filter("doc_id < 20"), f"file://{tmp_path}/i")
    index.append(rows.filter("doc_id >= 20"))
    index.delete(rows.filter("doc_id % 10 = 3"))
    index.compact()
    assert index.count("a") == 36 and index.count("w3 OR w4") == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = index.search("a -w4")
        assert "SortMergeJoin" not in found._jdf.queryExecution().toString() and found.count() == 35
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tombstones_go_when_they_hide_nothing(spark, tmp_path):
    """A first batch has nothing to replace; a flush keeps the tombstones that older segments need."""
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    index = SearchIndex.empty(spark, f"file://{tmp_path}/i")
    index.upsert(docs((1, "a"), (2, "a")))
    assert index.manifest["tombstones"] == []
    written = index.manifest["segments"]
    assert index.flush() == 2 and index.manifest["segments"] == [written[0] | {"pending": False}]
    index.upsert(docs((2, "b")))
    index.upsert(docs((3, "a"), (2, "c")))
    assert len(index.manifest["tombstones"]) == 2
    index.flush()
    assert len(index.manifest["tombstones"]) == 2 and {r.doc_id for r in index.ids("a").collect()} == {1, 3} and index.count("b") == 0
    index.compact()
    assert index.manifest["tombstones"] == [] and index.manifest["buried"] == {} and index.count("a OR c") == 3


def test_stream(spark, tmp_path):
    schema = "doc_id long, text string"
    for i, rows in enumerate(([(1, "big wolf"), (2, "bad")], [(1, "gone"), (3, "wolf")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        index = SearchIndex.load(spark, f"file://{tmp_path}/i") if i else SearchIndex.empty(spark, f"file://{tmp_path}/i")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        ingest(stream, index, f"{tmp_path}/offsets", flush_rows=1).awaitTermination()
    assert {r.doc_id for r in index.refresh().ids("wolf").collect()} == {3}
    assert {r.doc_id for r in index.docs().collect()} == {1, 2, 3}


def test_names_of_the_package():
    import textloom

    assert textloom.SearchIndex is SearchIndex and textloom.parse is parse and textloom.highlight is highlight
    assert all(callable(getattr(textloom, name)) for name in textloom.__all__)
    with pytest.raises(AttributeError):
        textloom.absent  # noqa: B018


def test_entry_module():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_document_statistics_split_no_text_by_expression(spark):
    from textloom import catalogue

    found = catalogue.QUERIES["doc_stats"](spark, "/root/testdata/sf0.001")
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 1
