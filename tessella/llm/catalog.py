"""Queries of this subpackage, one for each operator with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import html_diff, langid, lattice, packing, permutation, pii, sentencepiece, simhash, suffix_dedup, token_count


def tokenizer_file(name: str) -> str:
    """A vocabulary file: in the folder that TOKENIZERS_DIR names, else in that of the installed package."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), check=True)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op5_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_copies(table(spark, sf_dir, "embeddings"))


def op6_html_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract(table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_lengths(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken")))


QUERIES = (op1_sentencepiece, op2_token_counts, op3_permutation_index, op4_language_id, op5_lattice_dedup, op6_html_diff, op7_suffix_dedup, op8_simhash, op9_pii, op10_packing)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


#: All pairs of different vectors, their components, and the rows of each; equal to the lattice's unless it misses a link.
LATTICE_SQL = """
with recursive given as (
  select vec_id, list_transform(max(embedding), lambda x: x::double) as v from embeddings
  where vec_id is not null and embedding is not null group by vec_id
), reps as (
  select min(vec_id) as id, count(*)::bigint as n_copies, v, list_dot_product(v, v) as nn from given group by v
), links as (
  select a.id as a, b.id as b from reps a join reps b on a.id <> b.id
  where a.nn > 0 and b.nn > 0 and list_dot_product(a.v, b.v) >= 0.95 * sqrt(a.nn) * sqrt(b.nn)
), reach(a, b) as (
  select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a
), root as (
  select a as id, least(a, min(b)) as group_id from reach group by a
), degree as (
  select a as id, count(*)::bigint as n_links from links group by a
)
select g.vec_id, coalesce(t.group_id, r.id) as group_id, r.n_copies, coalesce(d.n_links, 0)::bigint as n_links
from given g join reps r on g.v = r.v left join root t on t.id = r.id left join degree d on d.id = r.id
where t.id is not null or (r.n_copies > 1 and r.nn > 0)
"""


#: All windows of 50 words as strings, the words that repeated ones cover, and the runs of those.
SUFFIX_SQL = r"""
with one as (
  select doc_id, arg_max(text, {'n': length(text), 't': text}) as text from documents where doc_id is not null and text is not null group by doc_id
), split as (
  select doc_id, list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '') as w from one
), windows as (
  select doc_id, pos, array_to_string(w[pos + 1:pos + 50], ' ') as win from (select doc_id, w, unnest(range(0, len(w) - 49)) as pos from split where len(w) >= 50)
), repeated as (
  select win, min({'d': doc_id, 'a': pos}) as first from windows group by win having count(*) > 1
), covered as (
  select doc_id, word, bool_or(later) as removed from (
    select doc_id, unnest(range(pos, pos + 50)) as word, {'d': doc_id, 'a': pos} <> first as later from windows join repeated using (win))
  group by doc_id, word
)
select doc_id, min(word)::int as start_word, (max(word) + 1)::int as end_word, removed from (
  select *, word - row_number() over (partition by doc_id, removed order by word) as run from covered)
group by doc_id, removed, run
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_lattice_dedup": LATTICE_SQL, "op7_suffix_dedup": SUFFIX_SQL}
