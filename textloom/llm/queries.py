"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import decontamination, exact_dedup, maxent, minhash, packing, secrets, suffix_dedup, token_counts, toxicity, warc

QUERIES = {
    "op1_packing": packing.op1,
    "op2_minhash": minhash.op2,
    "op3_suffix_dedup": suffix_dedup.op3,
    "op4_warc": warc.op4,
    "op5_exact_dedup": exact_dedup.op5,
    "op6_maxent": maxent.op6,
    "op7_decontamination": decontamination.op7,
    "op8_token_counts": token_counts.op8,
    "op9_secrets": secrets.op9,
    "op10_toxicity": toxicity.op10,
}

ORACLE_SQL = {
    "op2_minhash": minhash.ORACLE,
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op4_warc": warc.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
}
