"""A training corpus in five stages; each one's rows are written and read again by the next.

1. quality: documents that the line field rejects go (score below KEEP);
2. near-duplicates: of each group of documents linked by a Jaccard similarity of 0.8 or more of their
   five-word shingles, which SimHash tiles and MinHash bands propose, the one with the smallest id stays;
3. repeated passages: bytes of 200-byte strings that stand more than once go, in all places;
4. decontamination: documents that hold a passage near a benchmark item go;
5. tokens: texts are encoded and decoded by the byte-level vocabulary, with digests of both.

All but the last stage return the columns of documents. Rows without a doc_id and repeated ids are
rows like any other; empty tables pass through all.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from phosfold.llm import bpe, decontaminate, near_copies, quality, suffix_dedup
from phosfold.llm.common import materialize
from phosfold.llm.toxicity import held_out

#: A document is rejected when bad is likelier than good.
KEEP = 0.5


def good_documents(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels, ~held_out(F.col("doc_id"), 4, 2)), KEEP)


def without_near_duplicates(spark, docs, sf_dir):
    return near_copies.keep_one(docs)


def without_repeated_passages(spark, docs, sf_dir):
    return suffix_dedup.remove_repeats(docs)


def without_benchmark(spark, docs, sf_dir):
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark, docs, sf_dir):
    # workers serve the other stages as well, beside which remembered words would lie
    return bpe.token_report(docs, bpe.byte_vocabulary(), forget=True)


STAGES = [
    ("quality_classifier", good_documents),
    ("simhash_near_dedup", without_near_duplicates),
    ("suffix_array_dedup", without_repeated_passages),
    ("benchmark_decontamination", without_benchmark),
    ("bpe_round_trip", tokens),
]

#: No stage but the fourth is expressible in SQL; tests hold the pipeline against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
