"""Queries and oracle SQL of this package."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import decontam, html, langid, minhash, mixing, quality, repeats, sharding, token_file, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_warc": warc.op2_warc,
    "op3_html": html.op3_html,
    "op4_token_file": token_file.op4_token_file,
    "op5_repeats": repeats.op5_repeats,
    "op6_language": langid.op6_language,
    "op7_mixing": mixing.op7_mixing,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_minhash": minhash.op9_minhash,
    "op10_sharding": sharding.op10_sharding,
}

ORACLES = {
    "op1_quality_rules": quality.ORACLE,
    "op2_warc": warc.ORACLE,
    "op5_repeats": repeats.ORACLE,
    "op8_decontamination": decontam.ORACLE,
    "op9_minhash": minhash.ORACLE,
    "op10_sharding": sharding.ORACLE,
}

if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
