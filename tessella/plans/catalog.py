"""Registry of named queries: each takes (spark, folder of the tables) and works on whole tables.

Searches take as queries the rows of embeddings whose id is divisible by 100, or all benchmark items, against all rows. Where
the embeddings stand in for the tokens of a document, ten consecutive ids are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text, vector
from tessella.operators import adapters, chunk, media, pooling, rerank, search
from tessella.operators.embed import HashingEmbedder
from tessella.plans.oracles import SQL
from tessella.sources import files
from tessella.sources.media import base64_images as decoded_images

DIM = 64
_QUERIES: dict = {}


def query(f):
    _QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), F.col("label").cast("long").alias("label"))


def _asked(rows: DataFrame) -> DataFrame:
    return rows.filter(F.pmod("doc_id", F.lit(100)) == 0).withColumnRenamed("doc_id", "query_id")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as the token vectors of documents of ten; the last two tokens are padding."""
    pos = F.pmod("doc_id", F.lit(10))
    return _vectors(spark, d).select(F.floor(F.col("doc_id") / 10).cast("long").alias("doc"), pos.alias("pos"), "vec", (pos < 8).cast("int").alias("mask"))


def _rounded(c: Column) -> Column:
    return F.transform(c.cast("array<double>"), lambda x: F.round(x, 6) + F.lit(0.0))


# Embedding and vector arithmetic


@query
def embed_hash_dense(spark: SparkSession, d: str) -> DataFrame:
    return HashingEmbedder(DIM).embed(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


@query
def embed_hash_sparse(spark: SparkSession, d: str) -> DataFrame:
    return HashingEmbedder(DIM, sparse=True).embed(table(spark, d, "benchmark").select("item_id", "text"), "text").drop("text")


@query
def l2_norm(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select(F.col("doc_id").alias("vec_id"), F.round(vector.norm(F.col("vec")), 6).alias("norm"))


@query
def l2_normalized(spark: SparkSession, d: str) -> DataFrame:
    doubled = F.transform("vec", lambda x: x.cast("double") * 3)
    return _vectors(spark, d).select(F.col("doc_id").alias("vec_id"), _rounded(vector.l2_normalize(doubled)).alias("unit"))


@query
def centroid_mean(spark: SparkSession, d: str) -> DataFrame:
    return search.centroids(_vectors(spark, d), "label", DIM).select("label", _rounded(F.col("centroid")).alias("centroid"))


# Search


def _knn(spark: SparkSession, d: str, metric: str, k: int = 10) -> DataFrame:
    rows = _vectors(spark, d)
    return search.knn(_asked(rows), rows, k, metric, skip_self=True)


@query
def knn_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "cosine")


@query
def dot_topk(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "dot")


@query
def l2_topk(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "l2").select("query_id", "doc_id", (-F.col("score") + F.lit(0.0)).alias("distance"), "rank")


@query
def neg_distance_score(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "l2", 5)


@query
def argmax_label(spark: SparkSession, d: str) -> DataFrame:
    best = search.best_hit(_knn(spark, d, "cosine", 1))
    return search.enrich(best, _vectors(spark, d).select("doc_id", "label"))


@query
def pairs_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.pairs_topk(_vectors(spark, d), 10)


@query
def ivf_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return search.ivf_topk(_asked(rows).select("query_id", "vec"), rows, search.centroids(rows, "label", DIM), 10, 3)


@query
def clip_logits(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    hits = search.knn(_asked(rows), search.centroids(rows, "label", DIM), 10, "dot", id_col="label", vec_col="centroid")
    return hits.select("query_id", F.col("doc_id").alias("label"), F.round(F.col("score") * F.exp(F.lit(1.5)), 5).alias("logit"), "rank")


@query
def maxsim_topk(spark: SparkSession, d: str) -> DataFrame:
    own = _tokens(spark, d).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vec"))), lambda x: x["vec"]).alias("multi"))
    return search.maxsim(own.filter(F.pmod("doc", F.lit(10)) == 0).select(F.col("doc").alias("query_id"), "multi"), own.withColumnRenamed("doc", "doc_id"), 10)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    parts = chunk.explode(docs, chunk.fixed_chunks(F.col("text"), 1000), ["doc_id"])
    return parts.withColumn("chunk_id", F.col("doc_id") * 65536 + F.col("chunk_idx"))


def _benchmark(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _semantic(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = HashingEmbedder(DIM)
    asked = e.embed(_benchmark(spark, d), "query", "vec")
    corpus = e.embed(_chunks(spark, d), "chunk", "vec")
    hits = search.knn(asked, corpus, k, id_col="chunk_id")
    return hits.withColumnRenamed("doc_id", "chunk_id")


@query
def semantic_search_docs(spark: SparkSession, d: str) -> DataFrame:
    hits = _semantic(spark, d, 10)
    return hits.select("query_id", F.floor(F.col("chunk_id") / 65536).cast("long").alias("doc_id"), F.pmod("chunk_id", F.lit(65536)).cast("long").alias("chunk_idx"), "score", "rank")


@query
def search_rerank(spark: SparkSession, d: str) -> DataFrame:
    hits = _semantic(spark, d, 100).select("query_id", "chunk_id")
    pairs = hits.join(_chunks(spark, d).select("chunk_id", "chunk"), "chunk_id").join(_benchmark(spark, d), "query_id")
    scored = rerank.compute_scores(pairs, rerank.overlap_logit(F.col("query"), F.col("chunk"), 10.0))
    return rerank.rank(scored, ["query_id"], ["chunk_id"], 10).select("query_id", "chunk_id", "relevance_score", "rank")


def _doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token"))


@query
def sparse_tf(spark: SparkSession, d: str) -> DataFrame:
    return search.term_weights(_doc_tokens(spark, d)).withColumn("weight", F.round("weight", 6))


@query
def sparse_idf(spark: SparkSession, d: str) -> DataFrame:
    return search.idf_of_texts(table(spark, d, "documents")).withColumn("idf", F.round("idf", 6))


def _sparse(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return search.sparse_search(_benchmark(spark, d).withColumnRenamed("query", "text"), table(spark, d, "documents"), k)


@query
def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return _sparse(spark, d)


@query
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    e = HashingEmbedder(DIM)
    corpus = e.embed(table(spark, d, "documents").select("doc_id", "text"), "text", "vec")
    dense = search.knn(e.embed(_benchmark(spark, d), "query", "vec"), corpus, 10)
    return search.rrf([dense, _sparse(spark, d)], 10)


# Pooling


@query
def pool_mean(spark: SparkSession, d: str) -> DataFrame:
    return pooling.mean_pool(_tokens(spark, d), DIM).select("doc", _rounded(F.col("vec")).alias("vec"))


@query
def pool_cls(spark: SparkSession, d: str) -> DataFrame:
    return pooling.cls_pool(_tokens(spark, d)).select("doc", _rounded(F.col("vec")).alias("vec"))


@query
def pool_last(spark: SparkSession, d: str) -> DataFrame:
    return pooling.last_pool(_tokens(spark, d)).select("doc", _rounded(F.col("vec")).alias("vec"))


@query
def sparse_log1p_max(spark: SparkSession, d: str) -> DataFrame:
    return pooling.sparse_max_pool(_tokens(spark, d), DIM).select("doc", _rounded(F.col("vec")).alias("vec"))


@query
def ctx_window_similarity(spark: SparkSession, d: str) -> DataFrame:
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(-5, -1)
    rows = _tokens(spark, d).withColumn("before", F.collect_list("vec").over(before)).filter(F.size("before") > 0)
    return rows.select("doc", "pos", F.round(vector.cosine(F.col("vec"), vector.mean_of(F.col("before"), DIM)), 6).alias("similarity"))


# Text


@query
def chunk_fixed_overlap(spark: SparkSession, d: str) -> DataFrame:
    return chunk.explode(table(spark, d, "documents"), chunk.fixed_chunks(F.col("text"), 1000, 100), ["doc_id"])


@query
def chunk_sentence_pack(spark: SparkSession, d: str) -> DataFrame:
    return chunk.explode(table(spark, d, "documents"), chunk.sentence_packs(F.col("text"), 50), ["doc_id"])


@query
def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    return chunk.markdown_chunks(table(spark, d, "documents"), "text", ["doc_id"], 1000, 100)


@query
def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    return chunk.semantic_chunks(table(spark, d, "documents"), HashingEmbedder(DIM).encode, keep=["doc_id"])


@query
def chunk_cumulative(spark: SparkSession, d: str) -> DataFrame:
    e = HashingEmbedder(DIM)
    return chunk.semantic_chunks(table(spark, d, "documents"), e.encode, "cumulative", keep=["doc_id"], threshold=0.5, counts=e.counts)


@query
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return chunk.html_to_markdown(table(spark, d, "pages").select("page_id", "html")).drop("html")


@query
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.html_strip(F.col("html")).alias("text"))


@query
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


@query
def link_unwrap(spark: SparkSession, d: str) -> DataFrame:
    title, url = text.html_title(F.col("html")), F.col("url")
    link = F.concat(F.lit("see ["), title, F.lit("]("), url, F.lit(") and !["), title, F.lit("]("), url, F.lit(")"))
    return table(spark, d, "pages").select("page_id", text.link_unwrap(link).alias("text"))


@query
def blank_line_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.blank_line_clean(F.col("text")).alias("text"))


@query
def usage_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.sum(text.word_count(F.col("text"))).alias("tokens"))


@query
def basename_ext(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.basename(F.col("url")).alias("basename"), text.extension(F.col("url")).alias("extension"))


@query
def prompt_templates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark")
    return rows.select("item_id", text.query_prompt(F.lit("Find passages"), F.col("text")).alias("query"), text.document_prompt(F.col("text")).alias("document"))


@query
def title_body(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.title_of(F.col("text")).alias("title"), text.body_of(F.col("text")).alias("body"))


@query
def search_tag(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("<search>a</search> "), F.when(F.col("turn") > 0, F.concat(F.lit("<search>"), F.col("text"), F.lit("</search>"))).otherwise(F.lit("")))
    whole = F.when(F.col("role") != "system", made).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.last_tag(whole, "search").alias("found"))


@query
def lossy_decode(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))
    return table(spark, d, "benchmark").select("item_id", text.lossy_decode(raw).alias("text"))


@query
def base64_images(spark: SparkSession, d: str) -> DataFrame:
    raw = F.base64(F.concat(F.unhex(F.lit("89504E47")), F.col("text").cast("binary")))
    rows = decoded_images(table(spark, d, "documents").select("doc_id", raw.alias("payload")), "payload")
    return rows.select("doc_id", "image_kind", F.octet_length("image").cast("long").alias("n_bytes"))


@query
def overlap_from_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.overlap_of(F.col("n_chars"), F.lit(0.25)).alias("overlap"))


@query
def median_stddev(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.round(F.median(F.col("n_chars").cast("double")), 6).alias("median"), F.round(F.stddev_pop("n_chars"), 4).alias("deviation"))


@query
def cumulative_tokens(spark: SparkSession, d: str) -> DataFrame:
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.sum(text.word_count(F.col("text"))).over(so_far).alias("tokens"))


# Reranking: a conversation's answers are the candidates of its questions


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    asked = rows.filter("role = 'user'").select("conv_id", F.col("turn").alias("query_turn"), F.col("text").alias("query"))
    answers = rows.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("doc_turn"), F.col("text").alias("document"))
    return asked.join(answers, "conv_id")


_PAIR = ["conv_id", "query_turn", "doc_turn"]


@query
def rerank_scores(spark: SparkSession, d: str) -> DataFrame:
    return rerank.Reranker().compute_scores(_pairs(spark, d)).select(*_PAIR, "relevance_score")


@query
def rerank_rank(spark: SparkSession, d: str) -> DataFrame:
    scored = rerank.Reranker().compute_scores(_pairs(spark, d))
    return rerank.rank(scored, ["conv_id", "query_turn"], ["doc_turn"]).select(*_PAIR, "relevance_score", "rank")


@query
def rerank_softmax2(spark: SparkSession, d: str) -> DataFrame:
    yes = rerank.overlap_logit(F.col("query"), F.col("document"), 0.0)
    return rerank.yes_no_scores(_pairs(spark, d), F.lit(3.0), yes).select(*_PAIR, "relevance_score")


@query
def rerank_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rerank.above(rerank.Reranker().compute_scores(_pairs(spark, d)), 0.5).select(*_PAIR, "relevance_score")


# Sources and joins


@query
def files_to_index(spark: SparkSession, d: str) -> DataFrame:
    return files.not_indexed(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query
def enrich_left_join(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    return search.enrich(table(spark, d, "documents").select("doc_id", "lang", "source"), labels)


@query
def count_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("files"))


@query
def distinct_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source").dropDuplicates()


@query
def union_all(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    return docs.unionByName(table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id")))


@query
def page_rows(spark: SparkSession, d: str) -> DataFrame:
    return media.page_rows(table(spark, d, "documents").withColumn("pages", F.split("text", "\n")), "pages", ["doc_id"])


# Buffers, audio, video, requests


@query
def buffer_flush_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = media.buffers(table(spark, d, "documents").select("doc_id"), "doc_id", 100)
    return rows.groupBy("buffer").agg(F.count("*").alias("chunks"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withColumn("no_speech_prob", F.col("value") - F.floor("value")).withColumn("avg_logprob", -F.pmod("event_id", F.lit(10)) / F.lit(10.0))


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    return media.speech_only(_segments(spark, d), F.col("no_speech_prob"), F.col("avg_logprob"), 0.6, -0.5)


@query
def no_speech_filter(spark: SparkSession, d: str) -> DataFrame:
    return _spoken(spark, d).select("event_id", F.round("no_speech_prob", 6).alias("no_speech_prob"), "avg_logprob")


@query
def audio_windows(spark: SparkSession, d: str) -> DataFrame:
    window = media.tumbling_windows(F.col("ts"), 30).alias("window")
    return _spoken(spark, d).groupBy(window).agg(F.count("*").alias("segments"), F.min("event_id").alias("first"))


@query
def avg_logprob(spark: SparkSession, d: str) -> DataFrame:
    rows = _segments(spark, d).withColumn("segment", F.floor(F.col("event_id") / 10).cast("long"))
    return media.average_logprob(rows, "segment", "no_speech_prob")


@query
def frame_sampling(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "events").select(F.col("user_id").alias("video"), F.col("event_id").alias("frame"))
    return media.sample_frames(frames, 30, 300).select("video", F.col("frame").alias("source_frame"), "frame_index")


@query
def mixed_input_validation(spark: SparkSession, d: str) -> DataFrame:
    return media.mixed_inputs(table(spark, d, "conversations"), "conv_id", F.col("role") == "system")


@query
def response_index(spark: SparkSession, d: str) -> DataFrame:
    return media.response_index(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "index")


# Sinks


def _stored(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "text", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"))
    rows = rows.withColumn("modified", F.lit("2024-01-01 00:00:00")).withColumn("created", F.lit("2024-01-01 00:00:00"))
    return HashingEmbedder(DIM).embed(rows, "text", "embedding")


@query
def adapter_flat5(spark: SparkSession, d: str) -> DataFrame:
    return adapters.flat5(_stored(spark, d))


@query
def adapter_payload(spark: SparkSession, d: str) -> DataFrame:
    return adapters.point_payload(_stored(spark, d)).select("id", "vector", "payload.*")


@query
def adapter_metadata(spark: SparkSession, d: str) -> DataFrame:
    return adapters.id_values_metadata(_stored(spark, d))


@query
def adapter_columnar(spark: SparkSession, d: str) -> DataFrame:
    return adapters.columnar(_stored(spark, d).withColumn("buffer", F.floor(F.col("doc_id") / 100).cast("long")), "buffer")


@query
def adapter_capped(spark: SparkSession, d: str) -> DataFrame:
    return adapters.capped5(_stored(spark, d)).drop("embeddings")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
