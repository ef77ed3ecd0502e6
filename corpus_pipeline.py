"""The corpus pipeline: five stages over documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  A stage works on all rows that its
predecessor kept, and its decisions take effect:

1. toxicity: documents predicted toxic go;
2. near dedup: one document of each group of near copies stays;
3. suffix dedup: strings of 200 bytes that occur twice or more are cut out;
4. decontamination: documents with benchmark items go;
5. mix: sources are mixed to their targets, one row for each taken copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import op2_decontamination, op3_hyperminhash, op6_suffix_dedup, op9_toxicity, op10_source_mix
from lattica.llm.common import cut

STAGES = [
    ("toxicity", op9_toxicity.stage),
    ("near_dedup", op3_hyperminhash.stage),
    ("suffix_dedup", op6_suffix_dedup.stage),
    ("decontamination", op2_decontamination.stage),
    ("mix", op10_source_mix.stage),
]

#: The learned score, the verified links and the byte-level repeats are not SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  Between stages the lineage is cut in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else cut(docs), sf_dir)
    return docs
