"""The pipeline's stages against brute force, each on its own input."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline
from test_decontamination import brute as leaking
from test_exact_dedup import wanted as exact_wanted
from test_minhash import components
from textloom.llm import toxicity
from textloom.llm.common import keep, read

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]


def test_each_stage_against_brute_force(spark):
    docs = read(spark, SF, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    def after(name, docs):
        out = keep(stages[name](spark, docs, SF), "stage")
        assert out.columns == columns
        return out, [(r.doc_id, r.text) for r in docs.collect()], {r.doc_id for r in out.collect()}

    model = toxicity.train(docs, read(spark, SF, "labels"))
    one, rows, kept = after("toxicity", docs)
    assert kept == {i for i, t in rows if model.score(t or "") < toxicity.THRESHOLD}
    two, rows, kept = after("exact dedup", one)
    assert kept == {i for i, _, _, stays, _ in exact_wanted(rows) if stays}
    three, rows, kept = after("near dedup", two)
    assert kept == {i for i, (_, _, stays) in components(rows, 5).items() if stays}
    four, rows, kept = after("decontamination", three)
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    assert kept == {i for i, _ in rows} - {i for i, *_ in leaking(rows, items)}
    packed = stages["packing"](spark, four, SF).collect()
    assert {r.doc_id for r in packed} == kept
    ran = corpus_pipeline.run(spark, SF).collect()
    # how a document is cut may depend on the partitions; that all its tokens are there doesn't
    tokens = lambda pieces: {i: sum(r.length for r in pieces if r.doc_id == i) for i in kept}
    assert {r.doc_id for r in ran} == kept and tokens(ran) == tokens(packed)


def test_repeated_ids_lose_no_text_and_copies_go_by_row(spark):
    schema = read(spark, SF, "documents").schema
    words = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcdef"]
    texts = [(3, "same text"), (7, "same text"), (7, "a wholly different text"), (9, words[0]), (9, words[0]), (9, words[1]), (None, words[1]), (None, words[2]), (5, words[2] + " more"), (5, words[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], schema).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    kept = sorted(((r.doc_id, r.text) for r in stages["exact dedup"](spark, docs, SF).collect()), key=str)
    assert kept == sorted([(3, "same text"), (7, "a wholly different text"), (9, words[0]), (9, words[1]), (None, words[2]), (5, words[2] + " more"), (5, words[3])], key=str)
    kept = sorted(((r.doc_id, r.text) for r in stages["near dedup"](spark, docs, SF).collect()), key=str)
    assert kept == sorted([(3, "same text"), (7, "a wholly different text"), (9, words[0]), (9, words[1]), (5, words[2] + " more"), (5, words[3])], key=str)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_nulls_and_empty_tables(spark, name):
    schema = read(spark, SF, "documents").schema
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0
    rows = [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "x y", "en", "s", 3)]
    out = stage(spark, spark.createDataFrame(rows, schema), SF).collect()
    if name == "packing":
        assert sum(r.length for r in out) == 3 + 1 + 1 + 1  # "x y" and four ends, some pieces cut at powers of two
    else:
        assert len(out) == {"toxicity": 4, "exact dedup": 2, "near dedup": 4, "decontamination": 4}[name]
