"""The corpus operators' queries and their SQL twins."""

from __future__ import annotations

from marginalia.llm import near_dup, op1_pii, op2_quality, op3_shard, op4_language, op6_warc, op7_mix, op8_toxicity, op9_rules, op10_decontaminate


def op5_near_duplicates(spark, sf_dir: str):
    return near_dup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {
    "op1_pii": op1_pii.op1_pii,
    "op2_quality": op2_quality.op2_quality,
    "op3_shard": op3_shard.op3_shard,
    "op4_language": op4_language.op4_language,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_warc": op6_warc.op6_warc,
    "op7_mix": op7_mix.op7_mix,
    "op8_toxicity": op8_toxicity.op8_toxicity,
    "op9_rules": op9_rules.op9_rules,
    "op10_decontaminate": op10_decontaminate.op10_decontaminate,
}

ORACLE = {
    "op3_shard": op3_shard.oracle(),
    "op6_warc": op6_warc.SQL,
    "op7_mix": op7_mix.SQL,
    "op9_rules": op9_rules.SQL,
}
