"""Registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from tickweave.llm import bpe, decontaminate, exact_dedup, langid, near_dedup, pii, secrets, sharding, toxicity, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_langid": langid.op2_langid,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_secrets": secrets.op4_secrets,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_sharding": sharding.op7_sharding,
    "op8_pii": pii.op8_pii,
    "op9_warc": warc.op9_warc,
    "op10_decontamination": decontaminate.op10_decontamination,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op7_sharding": sharding.OP7_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_decontamination": decontaminate.OP10_SQL,
}
