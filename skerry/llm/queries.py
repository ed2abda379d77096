"""The corpus operators' queries, by name, and SQL for those that it can express."""

from __future__ import annotations

from . import exact, minhash, mixing, packing, passages, token_counts, toxicity, urls, vectors, warc


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_warc_revisits": warc.op2_warc_revisits,
        "op3_near_vectors": vectors.op3_near_vectors,
        "op4_passages": passages.op4_passages,
        "op5_mixing": mixing.op5_mixing,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_url_rules": urls.op7_url_rules,
        "op8_exact_dedup": exact.op8_exact_dedup,
        "op9_minhash": minhash.op9_minhash,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_revisits": warc.SQL, "op3_near_vectors": vectors.SQL, "op5_mixing": mixing.SQL, "op8_exact_dedup": exact.SQL}
