"""The corpus pipeline: language ID, near-dedup, repeated passages, personal data, packing, over all documents.

Each stage takes (spark, documents, folder of the tables) and gives the documents that go on; the last gives the
sequences. Language dictionaries and the personal-data model are fitted on the documents that reach their stage.
Documents without an id pass every stage but the last, which puts them in no sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import catalog, common, langid, packing, pii, simhash, suffix_dedup


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedupe(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_lengths(docs, catalog.tokenizer_file("byte_bpe_50k.tiktoken")))


STAGES = [("language_id", identify), ("simhash", near_dedup), ("suffix_dedup", cut_repeats), ("pii", redact), ("packing", pack)]

#: No SQL expresses compression, suffix sorting or column generation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bin_id, doc_id, piece, start, length) of all documents; each stage's documents are written once for the next."""
    docs = catalog.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        then = common.materialise(stage(spark, docs, sf_dir), name)
        common.discard(docs)
        docs = then
    packed = STAGES[-1][1](spark, docs, sf_dir)  # reads the materialised lengths alone
    common.discard(docs)
    return packed
