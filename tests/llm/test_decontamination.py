import math
import random
from collections import Counter

import pytest

from rows import awkward, documents
from textloom.llm import decontamination as D


def vocabulary(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    return rng, lambda n: " ".join(rng.choice(words) for _ in range(n))


def test_wand_retrieves_what_a_full_scan_scores_above_the_threshold():
    rng, prose = vocabulary(1)
    index = D.Index([(i, prose(rng.randint(1, 150))) for i in range(60)])
    for _ in range(150):
        source = rng.choice(index.items).words
        words = source[: rng.randint(1, 80)] + prose(rng.randint(0, 60)).encode().split()
        terms = sorted({index.vocabulary[w] for w in words if w in index.vocabulary})
        scores = Counter()
        for t in terms:
            for p, x in index.postings[t]:
                scores[p] += x
        for least in (0.2, 0.6, 0.95):
            wanted = {p for p, x in scores.items() if x >= least}
            found = index.wand(terms, least)
            assert {p for p, _ in found} == wanted
            assert all(math.isclose(x, scores[p]) for p, x in found)


def brute(rows, items):
    out = []
    for i, text in rows:
        words = D.words_of(text or "")
        have = D.shingles(words)
        for k, t in items:
            shares = D.Item(k, t or "").words and D.Item(k, t or "").overlaps(have, words)
            if shares:
                out.append((i, k, *shares))
    return sorted(out, key=repr)


def cases():
    rng, prose = vocabulary(2)
    items = [(i, f"{prose(rng.randint(3, 30))}? {prose(rng.randint(1, 40))}.") for i in range(40)] + [(50, prose(200)), (51, "short one"), (52, ""), (53, None), (None, prose(30))]
    rows = awkward()
    for n in range(120):
        k, t = rng.choice(items)
        words = (t or "").split()
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            if words:
                words[rng.randrange(len(words))] = prose(1)
        if rng.random() < 0.3:
            words = words[: len(words) // 2]
        rows.append((300 + n, f"{prose(rng.randint(0, 200))} {' '.join(words).upper()} {prose(rng.randint(0, 200))}"))
    return rows, items


@pytest.mark.parametrize("block", [D.BLOCK_ITEMS, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_ITEMS", block)
    rows, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    wanted = brute(rows, items)
    assert len(wanted) > 30
    found = D.find(documents(spark, rows), benchmark).collect()
    assert sorted(((r.doc_id, r.item_id, r.overlap, r.question_overlap, r.answer_overlap) for r in found), key=repr) == wanted
    assert all(r.bm25 >= D.LEAST - 1e-6 for r in found)


def test_the_filter_keeps_rows_whole_and_only_clean_ones(spark):
    rows, items = cases()
    docs = documents(spark, rows)
    kept = D.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns
    bad = {i for i, *_ in brute([r for r in rows if r[0] is not None], items)}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, _ in rows if i is not None and i not in bad)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find(documents(spark, awkward()), none).count() == 0
    assert D.drop_contaminated(documents(spark, [(1, "x")]), none).count() == 1
    assert D.find(documents(spark, []), spark.createDataFrame([(1, "a b c d e f")], none.schema)).count() == 0


def test_a_passage_boundary_hides_nothing(spark):
    _, prose = vocabulary(3)
    item = prose(40)
    rows = [(n, f"{prose(n)} {item} {prose(100)}") for n in range(0, 140, 3)]
    found = D.find(documents(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == [i for i, _ in rows]


def test_parts_far_apart_and_rare_words_hide_nothing(spark):
    rng, prose = vocabulary(4)
    items = [(n, f"{prose(30)}? {prose(30)}.") for n in range(20)]
    rows = [(n, f"{t.split('?')[0]} {prose(128 + 40 * n)} {t.split('?')[1]}") for n, t in items]
    # three insertions in each, and items of a template whose few other words weigh most
    for n, t in items:
        words = t.split()
        for at in (45, 30, 15):
            words[at:at] = prose(150).split()
        rows.append((100 + n, " ".join(words)))
    template = prose(46).split()
    for n in range(20, 60):
        words = [f"rare{n}x{k}" for k in range(5)] + template + [f"rare{n}y{k}" for k in range(5)]
        items.append((n, " ".join(words)))
        rows.append((100 + n, f"{prose(50)} {' '.join([*prose(5).split(), *words[5:-5], *prose(4).split()])} {prose(50)}"))
        rows.append((200 + n, f"{prose(50)} {' '.join(words[5:])} {prose(50)}"))
    wanted = brute(rows, items)
    assert {(n, n) for n in range(20)} <= {x[:2] for x in wanted} and {(200 + n, n) for n in range(20, 60)} <= {x[:2] for x in wanted}
    found = D.find(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.item_id, r.overlap, r.question_overlap, r.answer_overlap) for r in found), key=repr) == wanted


def test_unspaced_scripts_and_foreign_signs(spark):
    rng = random.Random(5)
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(n))
    ask, reply = han(20), han(20)
    item = f"{ask}\uff1f{reply}"
    # inside a sentence, with other signs, with two characters changed; then half of it, and none
    rows = [(1, han(30) + ask + reply + han(30)), (2, f"{han(5)}\u300c{ask}\u300d\u3002{reply}\u3002"), (3, f"x {item[:9]}{han(1)}{item[10:35]}{item[35:]} y"), (4, han(9) + ask + han(40)), (5, han(100))]
    found = D.find(documents(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in found) == [1, 2, 3] and found[0].item_id == 1
