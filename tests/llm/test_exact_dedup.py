import hashlib
import re
from collections import defaultdict

import pyarrow as pa

from rows import awkward, documents
from textloom.llm import exact_dedup
from textloom.llm.exact_dedup import OpenTable, exact_groups, grace


def wanted(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((i, len(t or "")))
    out = []
    for content, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(content.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=repr)


def test_groups_against_brute_force(spark):
    rows = awkward() + [(200 + i, "hot  text" + " " * (i % 7)) for i in range(300)]
    found = exact_groups(documents(spark, rows))
    assert sorted(map(tuple, found.collect()), key=repr) == wanted(rows)
    assert exact_groups(documents(spark, [])).count() == 0


def test_small_tables_fold_and_spill_to_the_same_groups(spark, monkeypatch, tmp_path):
    rows = [(i, f"text {i % 37}") for i in range(400)]
    entries = [(hashlib.sha256(t.encode()).digest(), t.encode(), 1, len(t), i) for i, t in rows]
    columns = list(zip(*entries, strict=True))
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[a : a + 50], k) for c, k in zip(columns, kinds, strict=True)], ["digest", "content", "n", "chars", "doc_id"]) for a in range(0, 400, 50)]
    (tmp_path / "s").mkdir()
    buckets = list(grace(iter(batches), tmp_path / "s", table_bytes=700))
    assert len(buckets) > 1  # it did split
    found = {e[1]: (e[2][0], e[2][1][1]) for b in buckets for e in b}
    assert len(found) == sum(map(len, buckets)) == 37
    for k in range(37):
        own = [i for i, t in rows if t == f"text {k}"]
        assert found[f"text {k}".encode()] == (len(own), min(own))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_the_table_compares_contents_when_digests_collide():
    table = OpenTable()
    for n in range(3):
        for content in (b"a", b"b", b"c"):
            entry, new = table.entry(b"same digest.....", content)
            assert new == (n == 0) and entry[1] == content
    assert len(table.entries) == 3


def test_contents_decide_inside_a_task(monkeypatch):
    monkeypatch.setattr(exact_dedup, "TABLE_BYTES", 1)  # a table of one entry: nothing is folded, nothing lost
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3], pa.int64()), pa.array([1, 1, 2], pa.int64()), pa.array([b"x", b"x", b"y "], pa.binary())], ["doc_id", "chars", "text"])
    out = [r for b in exact_dedup._fold(iter([batch])) for r in b.to_pylist()]
    assert [(r["content"], r["n"], r["doc_id"]) for r in out] == [(b"x", 1, 1), (b"x", 1, 2), (b"y", 1, 3)]
