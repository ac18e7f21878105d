import zlib

import pytest

from rows import awkward, by_id, documents
from textloom.llm import toxicity


def labelled(n=240):
    """Toxic documents hold one bad sentence among good ones."""
    rows, labels = [], []
    good = ["the river runs past the old mill", "we met at noon near the station", "rain fell over the quiet fields", "she wrote a letter to the council"]
    bad = ["you filthy worthless scumbag", "what a stupid scumbag you are", "shut up worthless filthy pig"]
    for i in range(n):
        own = [good[(i * k + k) % 4] for k in range(1, 6)]
        if i % 2:
            own.insert(i % 5, bad[i % 3])
        rows.append((i, ". ".join(own) + f". Page {i}."))
        labels.append((i, 1, i % 2))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_the_offending_sentence_is_found_from_document_labels_alone(spark):
    rows, labels = labelled()
    model = toxicity.train(documents(spark, rows), spark.createDataFrame(labels, LABELS))
    found = by_id(toxicity.score_documents(documents(spark, rows), model))
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 3 == 1:  # held out
            assert (found[i].score >= toxicity.THRESHOLD) == bool(i % 2)
    for i, text in rows[1:40:2]:
        spans = model.offending(text)
        assert len(spans) == 1
        start, end, _ = spans[0]
        assert any(w in text[start:end] for w in ("scumbag", "worthless"))


def test_noisy_or_of_sentences():
    model = toxicity.Model({f: 8.0 for f in toxicity.word_features("bad").tolist()})
    text = "good day. bad. so bad! fine"
    p = model.sentence_probabilities(text)
    clean = 1.0
    for x in p:
        clean *= 1 - x
    assert len(p) == 4 and model.score(text) == pytest.approx(1 - clean)


def test_edges(spark):
    rows, labels = labelled(60)
    docs = documents(spark, [*rows, *[(i, t) for i, t in awkward() if i is None or i >= 100]])
    table = spark.createDataFrame([*labels, (1, 0, 0), (2, None, None), (None, 1, 1), (9999, 1, 1)], LABELS)
    model = toxicity.train(docs, table)
    scored = toxicity.score_documents(documents(spark, awkward()), model).collect()
    assert len(scored) == len(awkward()) and all(0 <= r.score <= 1 for r in scored)
    assert all(r.score == 0 for r in scored if r.doc_id in (0, 1, 2, 3))
    none = spark.createDataFrame([], LABELS)
    assert toxicity.train(docs, none).weights == {} and toxicity.score_documents(documents(spark, []), model).count() == 0
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() <= docs.count()


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows, labels = labelled(90)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    turned = [(i, q, 1 - t if held(i) else t) for i, q, t in labels]
    docs = documents(spark, rows)
    assert toxicity.train(docs, spark.createDataFrame(labels, LABELS)).weights == toxicity.train(docs, spark.createDataFrame(turned, LABELS)).weights


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    found = by_id(toxicity.op10(spark, sf))
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in found and found[r.doc_id].held_out]
    right = sum(found[r.doc_id].predicted == r.toxic for r in labels)
    assert len(labels) > 50 and right >= 0.95 * len(labels)


@pytest.mark.parametrize("joint", ["", "_", "/", "​", "。"])
def test_what_stands_late_in_a_long_word_is_learnt_and_found(joint):
    good = ["河水流過舊磨坊旁邊的田野", "我們中午在車站附近見面", "細雨落在安靜的田野上面", "她寫了一封信給議會代表"]
    bad = ["你這骯髒無用的人渣快滾", "多麼愚蠢骯髒無用的人渣"]
    texts = []
    for i in range(160):
        own = [good[(i * k + k) % 4] for k in range(1, 25)]
        if i % 2:
            own.insert(8 + i % 15, bad[i // 2 % 2])
        texts.append(joint.join(own))
    model = toxicity.fit(texts[:80], [i % 2 for i in range(80)])
    assert [model.score(t) >= toxicity.THRESHOLD for t in texts[80:]] == [bool(i % 2) for i in range(80)]
    assert all(len(w) <= toxicity.WINDOW for w in model.known)


def test_windows_hold_every_passage_of_a_word():
    for n in (65, 96, 97, 128, 129, 200, 1001):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        found = list(toxicity.windows(word))
        assert all(any(word[i : i + 32] in w for w in found) for i in range(n - 31))
        together = set().union(*(toxicity.word_features(w).tolist() for w in found))
        assert together == set(toxicity.word_features(word).tolist())


def test_length_alone_decides_nothing():
    features = lambda word, x: dict.fromkeys(toxicity.word_features(word).tolist(), x / len(toxicity.word_features(word)))
    model = toxicity.Model(features("scumbag", 16.0) | features("zilch", 3.0))
    lines = [f"line {k} ok" for k in range(200_000)]
    assert model.score("\n".join(lines)) < 0.01
    assert model.score("\n".join(["zilch", *lines[:9]] * 20_000)) < 0.5 and model.score("zilch\n" * 200_000) < 0.5
    assert model.score("\n".join([*lines[:150_000], "you scumbag", *lines[150_000:]])) > 0.9
