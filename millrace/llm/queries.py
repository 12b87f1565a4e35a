"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from millrace.llm import decontaminate, exact_dedup, license_scan, packing, shards, simhash, token_counts, token_files, toxicity, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_simhash": simhash.op2_simhash,
    "op3_token_files": token_files.op3_token_files,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_warc": warc.op7_warc,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_size_tiered_shards": shards.op10_size_tiered_shards,
}
ORACLE_SQL = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op6_license_scan": license_scan.ORACLE,
    "op7_warc": warc.ORACLE,
    "op10_size_tiered_shards": shards.ORACLE,
}
