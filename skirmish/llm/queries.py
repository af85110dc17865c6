"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, embedding_dedup, licenses, lm_score, packing, parity_join, pii, sharding, toxicity, url_filter

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op2_sharding": sharding.op2_sharding,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_packing": packing.op7_packing,
    "op8_pii": pii.op8_pii,
    "op9_licenses": licenses.op9_licenses,
    "op10_parity_join": parity_join.op10_parity_join,
}

ORACLE = {
    "op1_embedding_dedup": embedding_dedup.SQL,
    "op10_parity_join": parity_join.SQL,
    "op2_sharding": sharding.SQL,
}
