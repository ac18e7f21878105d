"""The registered queries on the smallest tables; those with SQL against it."""

import re
import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parents[2]), str(Path(__file__).parents[1])]
import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
#: The columns that each query's contract states.
COLUMNS = {
    1: "doc_id start length ids_crc32 doc_tokens sequence_id offset", 2: "doc_id n_shingles component_id kept", 3: "doc_id n_bytes n_removed n_spans kept_sha256",
    4: "page_id payload_bytes payload_digest record_type refers_to", 5: "doc_id keep_id group_size kept text_sha256", 6: "doc_id held_out n_tokens n_known train_tokens base_score score",
    7: "doc_id item_id", 8: "doc_id n_bytes n_tokens over_limit", 9: "doc_id", 10: "doc_id held_out score predicted",
}


def test_one_query_for_each_operator():
    found = sorted(int(m[1]) for q in entry.queries() if (m := re.match(r"op(\d+)_", q)))
    assert found == list(range(1, 11)) and "pipeline" in entry.queries()


def test_columns(spark):
    for name, run in entry.queries().items():
        if m := re.match(r"op(\d+)_", name):
            df = run(spark, SF)
            assert set(COLUMNS[int(m[1])].split()) <= set(df.columns), name


def test_against_sql(spark):
    db = oracle.database(SF)
    for name in ("op2_minhash", "op3_suffix_dedup", "op4_warc", "op5_exact_dedup"):
        assert not oracle.differences(entry.queries()[name](spark, SF), entry.oracle_sql()[name], db)
