"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last
return the columns of documents. run() writes what a stage returns to the shared folder and reads it
back, so a lost executor costs the running stage at most; what a stage needed besides goes then.

Defined cases, in every stage: a null text counts as empty and is kept by the first and third stage; empty
texts are one group of copies; null languages and sources stay null, a null source is a source of its own;
rows that repeat are rated alike, one of them stays after the second stage, and the fourth gives all rows of
an id the same number of copies; of a group's ties the smallest doc_id stays; an empty table gives none;
without labels or benchmark nothing is rejected for them; further columns pass through unchanged.
"""

from __future__ import annotations

from marginalia.llm import near_dup, op3_shard, op7_mix, op8_toxicity, op10_decontaminate
from marginalia.llm.common import discard, scratch, stash


def toxicity(spark, docs, sf_dir):
    """Documents that the nearest labelled examples call toxic go; the others stay as they are."""
    return op8_toxicity.without_toxic(docs, op8_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays (five-word shingles, similarity 0.8 or more)."""
    return near_dup.deduplicate(docs)


def decontamination(spark, docs, sf_dir):
    """Documents with a benchmark passage, exact or within its edit budget, go."""
    return op10_decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark, docs, sf_dir):
    """Every document as often as its source's rate and its hash say."""
    return op7_mix.mix(docs)


def sharding(spark, docs, sf_dir):
    """Every document with its slot and shard."""
    return op3_shard.place(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("sharding", sharding),
]

#: The neighbour votes of the first stage have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        if n == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch(spark) as keep:
            kept = keep(stash(stage(spark, docs, sf_dir), "stage"))
        if n:
            discard(docs)
        docs = kept
