"""Golden results on small tables, and that Columns, the Python evaluator and the index agree."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions.patterns import typo, within
from textloom.functions.spans import Document
from textloom.operators import match, score, searchbox
from textloom.plans.query import QueryError, parse
from textloom.sources.index import IndexFailure, SearchIndex

PROSE = ["the big bad wolf ate a big grey wolf", "a wolf that is big and bad", "craft pale beer and more beer", "beer made by a craft brewer", "send an e-mail to the wolf", "email the big bad wolf"]
LATER = [(7, "big bad wolf again"), (8, "bad big wolf"), (9, "a big and bad wolf")]


@pytest.fixture(scope="module")
def prose(spark):
    rows = [(i + 1, t) for i, t in enumerate(PROSE)] + [(100 + i, f"filler {i}") for i in range(1, 2001)] + [(5000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


POSITIONAL = [
    ('"big bad wolf"', {1, 6}), ('"bad big wolf"', set()), ('"big _ wolf"', {1, 6}), ('"[big large] grey wolf"', {1}), ('"big wolf"~1', {1, 6}), ("big THEN/2 bad", {1, 2, 6}), ("big NEAR/2 bad", {1, 2, 6}),
    ("[craft email] beer^2", {3, 4}), ("craft THEN/1 beer", {3}), ("beer NEAR/3 craft", {3, 4}), ("e-mail", {5}), ("email", {6}), ("AT LEAST 2 OF [craft beer wolf]", {3, 4}), ("ALL OF [big wolf]", {1, 2, 6}), ('wolf AND NOT "big bad"', {2, 5}), ('wolf -"big bad" -e-mail', {2}),
]


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


@pytest.mark.parametrize("q, want", POSITIONAL)
def test_positional_goldens(prose, q, want):
    assert ids(match.search(prose, q)) == want


def test_later_rows_scores_and_index(spark, prose, tmp_path):
    index = SearchIndex.build(prose, f"file://{tmp_path}/i")
    for q, want in POSITIONAL:
        assert ids(index.ids(q)) == want, q
    index.append(spark.createDataFrame(LATER, "doc_id long, text string"))
    assert ids(index.ids('"big bad wolf"')) == {1, 6, 7}
    assert ids(index.ids('wolf AND NOT "big bad"')) == {2, 5, 8, 9}
    assert ids(index.ids("big THEN/1 bad")) == {1, 2, 6, 7, 9}
    want = {3: 6.4936, 8: 4.6597, 1: 4.5339, 7: 3.9855, 4: 3.6984, 6: 3.4817, 9: 3.4817, 2: 2.7791, 5: 2.7791}
    assert {r.doc_id: round(r.score, 4) for r in index.score("wolf OR beer").collect()} == want
    everything = prose.unionByName(spark.createDataFrame(LATER, "doc_id long, text string"))
    assert {r.doc_id: round(r.score, 4) for r in score.scores(everything, "wolf OR beer").collect()} == want
    for frame in (index.explain('"big bad" wolf^2'), score.explain(everything, '"big bad" wolf^2')):
        e = frame.filter("doc_id = 1").first().explanation
        assert (e.score, e.matches, e.doc_terms, e.avg_doc_terms, e.docs) == (16.567984, True, 7, 2.015431, 2009.0)
        assert [(x.term, x.df, x.tf, x.weight, x.idf, x.score) for x in e.terms] == [("wolf", 7, 2, 2.0, 5.590987, 9.067775), ("big", 6, 2, 1.0, 5.734088, 4.649932), ("bad", 6, 1, 1.0, 5.734088, 2.850277)]
    assert index.flush() == 3 and ids(index.ids('"big bad wolf"')) == {1, 6, 7}
    index.upsert(spark.createDataFrame([(7, "quiet now"), (1, None)], "doc_id long, text string"))
    assert ids(index.ids('"big bad wolf"')) == {1, 6}
    index.delete(spark.createDataFrame([(6,)], "doc_id long"))
    assert ids(index.ids('"big bad wolf"')) == {1} and index.dead_docs() == 2
    old = SearchIndex.load(spark, f"file://{tmp_path}/i")
    index.vacuum()
    assert ids(index.ids("wolf")) == {1, 2, 5, 8, 9} and index.dead_docs() == 0 and index.doc_count() == 2008
    with pytest.raises(IndexFailure):
        old.truncate()
    assert old.refresh().manifest == index.manifest
    assert index.estimate("wolf") == 5 and index.doc_freq("wolf") == 5
    with pytest.raises(IndexFailure, match="is not a search index"):
        SearchIndex.load(spark, f"file://{tmp_path}/none")
    index.truncate()
    assert index.stats().first().live_docs == 0 and ids(index.ids("wolf")) == set()


def test_filler_counts(spark):
    df = spark.range(1, 20001).select(F.col("id").alias("doc_id"), F.concat(F.lit("filler "), "id", F.when(F.col("id") % 7 == 0, " seven").otherwise(""), F.when(F.col("id") % 11 == 0, " eleven").otherwise("")).alias("text"))
    found = match.search_many(df, ["seven", "seven eleven", "seven OR eleven", "filler -seven -eleven"]).groupBy("q").count().collect()
    assert {r.q: r["count"] for r in found} == {"seven": 2857, "seven eleven": 259, "seven OR eleven": 4416, "filler -seven -eleven": 15584}


def test_identifiers(spark, tmp_path):
    made = spark.range(1, 20001).select(F.col("id").alias("doc_id"), F.concat(F.lit("MSKU"), F.lpad((F.col("id") * 7919 % 10000000).cast("string"), 7, "0"), F.lit(" "), F.lpad((F.col("id") * 104729 % 1000000000).cast("string"), 9, "0")).alias("text"))
    extra = [(20001, "MSKU7777777 999999999"), (20002, "MRKU7777770 888888888"), (20003, "MSKU0007918 555555555"), (20004, "XMSKU0007919 000000001")]
    index = SearchIndex.build(made, f"file://{tmp_path}/ids", with_grams=True)
    for q, n in (("msku00079*", 2), ("*07919*", 6), ("msku00* -*9*", 44), ("msku0007919 OR 000104729", 1)):
        assert index.count(q) == n == match.search(made, q).count(), q
    assert [r.text for r in match.search(made, "msku0007991~").collect()] == ["MSKU0007919 000104729"]
    everything = made.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    index.append(spark.createDataFrame(extra, "doc_id long, text string"))
    for q, k, typos, want in (("msku0007919", 6, 2, [0, 2, 3, 4, 4, 4]), ("msku00079", 4, 2, [1, 1, 1, 2]), ("msku0007919", 6, 1, [0, 2, 3])):
        assert [r.tier for r in searchbox.top(everything, q, k, "doc_id", max_typos=typos).collect()] == want
        assert [r.tier for r in index.box_top(q, k, typos).collect()] == want


def test_typos_as_column(spark):
    rng = random.Random(2)
    for q in ("abca", "aabbcac", "éab1c"):
        texts = ["".join(rng.choice("abcé1") for _ in range(rng.randint(1, 9))) for _ in range(1500)]
        for k in (1, 2):
            rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", typo(F.col("t"), q, k).alias("hit")).collect()
            assert [r.t for r in rows if r.hit != within(r.t, q, k)] == []


def random_query(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        w = rng.choice(["ale", "beer", "craft", "dark", "ember", "fox"])
        return rng.choice([w, w, w, f"{w[:2]}*", f"*{w[1:3]}*", f"{w}~", f"{w}^2"])
    sub = lambda: random_query(rng, depth - 1)
    kind = rng.randrange(8)
    if kind == 0:
        return f"({sub()} {sub()})"
    if kind == 1:
        return f"({sub()} OR {sub()})"
    if kind == 2:
        return f"({sub()} -{sub()})"
    if kind == 3:
        return f"({sub()} {rng.choice(['THEN', 'NEAR'])}/{rng.randint(0, 3)} {sub()})"
    if kind == 4:
        return f"(AT LEAST 2 OF [{sub()} {sub()} {sub()}])"
    words = [rng.choice(["ale", "beer", "craft", "_", "[dark fox]"]) for _ in range(rng.randint(2, 3))]
    return f'"{" ".join(["ale", *words])}"' + rng.choice(["", "~1", "~2"])


def brute(q, text):
    return Document(text).matches(q)


def test_random_queries_agree(spark, tmp_path):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["ale", "beer", "craft", "dark", "ember", "fox", "café"]) for _ in range(rng.randint(0, 13))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = SearchIndex.build(df, f"file://{tmp_path}/r", with_grams=True)
    sources = ["ale -(beer -craft)", "ale -(beer OR (craft -dark))", "ale -(\"beer craft\" OR (dark -fox))"]
    while len(sources) < 30:
        s = random_query(rng, 2)
        try:
            parse(s)
        except QueryError:
            continue
        sources.append(s)
    found = {(r.q, r.doc_id) for r in match.search_many(df, sources).collect()}
    for s in sources:
        q = parse(s)
        want = {i for i, t in enumerate(texts) if brute(q, t)}
        assert {i for source, i in found if source == s} == want, s
    for s in sources[:8]:
        assert ids(index.ids(s)) == {i for i, t in enumerate(texts) if brute(parse(s), t)}, s


def test_positional_queries_and_scores_analyse_once(spark):
    """One scan and no union for positions; scores group no rows again and sort for no join."""
    df = spark.createDataFrame([(1, "of all the"), (1, "of all the"), (2, "the of 日本"), (3, None), (4, "Of THE ofthe")], "doc_id long, text string").repartition(2)
    plan = lambda found: found._jdf.queryExecution().optimizedPlan().toString()
    found = match.search(df, "of THEN/2 the")
    assert "Union" not in plan(found) and sorted(r.doc_id for r in found.collect()) == [1, 1, 4]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        terms, stats = score.scored_terms(df, "of the^2 of*")
        assert "SortMergeJoin" not in score.scored_terms(df, "of the^2")[0]._jdf.queryExecution().toString()
        assert stats == score.Collection(4, 3 + 3 + 4 + 3)
        assert sorted((r.doc_id, r.term, r.tf, r.df, r.matches) for r in terms.collect()) == [(1, "of", 1, 4, True), (1, "of", 1, 4, True), (1, "the", 1, 4, True), (1, "the", 1, 4, True), (2, "of", 1, 4, True), (2, "the", 1, 4, True), (4, "of", 1, 4, True), (4, "ofthe", 1, 1, True), (4, "the", 1, 4, True)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
