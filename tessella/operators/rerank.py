"""Reranking (R1-R5): pairs of a query and a document get a logit, the logit a chance, and chances a rank.

Pairs come from a join or a search, so that a query meets its candidates, not the whole corpus. The default
logit is the number of distinct tokens that both texts have, less ``midpoint``; a model gives its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text, vector
from tessella.schema import extended


def overlap_logit(query: Column, document: Column, midpoint: float = 3.0) -> Column:
    both = F.array_intersect(F.array_distinct(text.tokens(query)), F.array_distinct(text.tokens(document)))
    return F.size(both).cast("double") - F.lit(midpoint)


def compute_scores(pairs: DataFrame, logit: Column) -> DataFrame:
    """Pairs with relevance_score, the sigmoid of the logit, rounded to 6 places."""
    return pairs.withColumn("relevance_score", F.round(vector.sigmoid(logit), 6))


def yes_no_scores(pairs: DataFrame, no: Column, yes: Column) -> DataFrame:
    """R2: the chance of "yes" of the two tokens' logits."""
    return pairs.withColumn("relevance_score", F.round(vector.softmax2(no, yes), 6))


def rank(scored: DataFrame, query: list[str], order: list[str], top_k: int | None = None) -> DataFrame:
    """With the 1-based rank of each document for its query; all documents unless top_k is given.

    Ties keep the order of the order columns.
    """
    window = Window.partitionBy(*query).orderBy(F.desc("relevance_score"), *order)
    out = scored.withColumn("rank", F.row_number().over(window).cast("long"))
    return out if top_k is None else out.filter(F.col("rank") <= top_k)


def above(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """P9."""
    return scored.filter(F.col("relevance_score") > threshold)


class Reranker:
    """A scoring function over (query, document) texts, called on Arrow batches of at most batch_size pairs.

    score gets two lists of strings and gives a logit for each pair. Without it the token overlap is used, in the JVM.
    """

    def __init__(self, score: Callable[[list[str], list[str]], list[float]] | None = None, batch_size: int = 32, midpoint: float = 3.0) -> None:
        self.score, self.batch_size, self.midpoint = score, batch_size, midpoint

    def compute_scores(self, pairs: DataFrame, query: str = "query", document: str = "document") -> DataFrame:
        if self.score is None:
            return compute_scores(pairs, overlap_logit(F.col(query), F.col(document), self.midpoint))
        score, size = self.score, self.batch_size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q, d = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (query, document))
                out: list[float] = []
                for at in range(0, len(q), size):
                    out += [float(x) for x in score(q[at : at + size], d[at : at + size])]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, "__logit"])

        scored = pairs.mapInArrow(run, extended(pairs.schema, __logit="double"))
        return compute_scores(scored, F.col("__logit")).drop("__logit")

    def rerank(self, queries: DataFrame, documents: DataFrame, top_k: int | None = None) -> DataFrame:
        """Every query (query) with every document (document) of a candidate list, which is what the caller made it.

        Both sides are given an index by their order of text, unless they have doc_idx. The smaller side is asked for by
        its size: at most 10,000 queries are sent to the tasks, more raise an error, for then a search should make the pairs.
        """
        some = queries.select("query").distinct().limit(10_001).collect()
        if len(some) > 10_000:
            raise ValueError("rerank takes at most 10,000 queries at once: find candidates by a search first")
        asked = F.array(*[F.lit(r["query"]) for r in some]) if some else F.array().cast("array<string>")
        pairs = documents.withColumn("query", F.explode(asked))
        order = ["doc_idx"] if "doc_idx" in documents.columns else ["document"]
        return rank(self.compute_scores(pairs), ["query"], order, top_k)
