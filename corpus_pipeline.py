"""The corpus pipeline: five operators of ``quarry.llm`` in order, each stage on what the last kept.

1. toxicity: documents that the classifier rejects go
2. line dedup: repeated lines go, documents stay
3. SimHash near-dedup: one document of each group stays
4. benchmark decontamination: documents that contain a benchmark item go
5. best-fit packing: what is left becomes token sequences

Defined results:

* A document whose lines all go keeps its row with an empty text; null, empty and such texts are one
  near-duplicate group, so one of them stays.
* Rows with a null id are documents like others, but neither count nor lose repeated lines, and benchmark
  decontamination keeps or drops all of them together.
* Repeated rows of a document are one document to line dedup; near-dedup leaves one of them.
* Columns beyond those of ``documents`` pass through unchanged, whatever their names; ``n_chars`` follows
  the text. The last stage returns pieces.
* An empty table gives an empty result, and labels or items that are missing reject nothing.

What a stage writes for its own use goes when it has ended, what lies between stages when the next one
has, and both also when one fails.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, linededup, packing, simhash, toxicity
from quarry.llm.common import Scratch


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), scratch=scratch)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    return linededup.dedup(docs, scratch)


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    return simhash.keep_one(docs, scratch)


def stage_decontam(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), scratch=scratch)


STAGES = [
    ("toxicity", stage_toxicity),
    ("line dedup", stage_line_dedup),
    ("SimHash near-dedup", stage_simhash),
    ("benchmark decontamination", stage_decontam),
    ("best-fit packing", stage_packing),
]

#: A trained classifier and a packing search are not SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: Scratch | None = None
    for _, stage in STAGES:
        own, kept = Scratch(spark), Scratch(spark)
        try:
            out = kept.keep(stage(spark, out, sf_dir, own))
        except BaseException:
            kept.drop()
            raise
        finally:
            own.drop()
            if before:
                before.drop()
        before = kept
    return out
