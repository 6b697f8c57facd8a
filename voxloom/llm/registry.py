"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, decontaminate, exact, fim, lines, merkle, minhash, packing, quality, substring, toxicity, urls, warc


def queries() -> dict:
    found = [
        warc.op1_warc,
        minhash.op2_minhash_near_duplicates,
        decontaminate.op3_benchmark_decontamination,
        packing.op4_packing,
        quality.op5_quality,
        toxicity.op6_toxicity,
        ann.op7_nearest_neighbours,
        urls.op8_url_filter,
        substring.op9_substring_dedup,
        lines.op10_line_dedup,
        exact.op11_exact_dedup,
        merkle.op12_merkle_manifest,
        fim.op13_fill_in_middle,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.OP1_SQL,
        "op3_benchmark_decontamination": decontaminate.OP3_SQL,
        "op8_url_filter": urls.OP8_SQL,
        "op10_line_dedup": lines.OP10_SQL,
        "op11_exact_dedup": exact.OP11_SQL,
        "op12_merkle_manifest": merkle.OP12_SQL,
        "op13_fill_in_middle": fim.OP13_SQL,
    }
