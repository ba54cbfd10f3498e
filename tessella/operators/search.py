"""Vector search: exact nearest rows, pairs, late interaction, sparse scores, rank fusion, centroids.

A stated set of queries meets the whole corpus in one pass over it. Queries whose vectors fit ``small_bytes``, which is
checked, go along with the tasks; each task multiplies a batch with all of them and passes on its k best a query.
More queries meet the corpus in cells of (stripe of the corpus, set of queries). Neither way writes a pair that isn't among
the best. Scores are doubles rounded to 6 places and ties go to the lesser id, so results don't depend on the layout.

Rows with a null id, a null vector or a null element aren't found; a corpus vector of another length than the queries'
isn't either. The cosine of a zero vector to any other is 0.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import batches as parts
from tessella.functions import vector

SMALL_BYTES = 32 << 20
HIT = "query_id long, doc_id long, score double"


def _rows(df: DataFrame, id_col: str, vec_col: str, name: str, *keep: str) -> DataFrame:
    out = df.select(F.col(id_col).cast("long").alias(name), F.col(vec_col).cast("array<double>").alias("vec"), *(F.col(c).cast("long").alias(c) for c in keep))
    return out.filter(f"{name} is not null and vec is not null and forall(vec, x -> x is not null)")


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if len(column) else np.empty((0, dim))


class _Best:
    """The k best rows of each query so far."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, metric: str, skip_self: bool) -> None:
        self.ids, self.k, self.metric, self.skip_self = ids, k, metric, skip_self
        self.v, self.size = v, np.sqrt((v * v).sum(1))
        self.best_id, self.best = np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), -np.inf)

    def scores(self, v: np.ndarray) -> np.ndarray:
        out = self.v @ v.T
        if self.metric == "cosine":
            scale = self.size[:, None] * np.sqrt((v * v).sum(1))[None]
            out = np.divide(out, scale, out=np.zeros_like(out), where=scale > 0)
        elif self.metric == "l2":  # by differences: expanding the square would cancel for near vectors
            out = -np.sqrt(np.stack([((v - q) ** 2).sum(1) for q in self.v])) if len(self.v) else out
        return np.round(out, 6) + 0.0

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        for at in range(0, len(ids), 4096):
            self.offer(ids[at : at + 4096], self.scores(v[at : at + 4096]))

    def offer(self, own: np.ndarray, s: np.ndarray) -> None:
        """Rows with their scores, a row of s a query."""
        if self.skip_self:
            s[self.ids[:, None] == own[None]] = -np.inf
        better = s >= self.best[:, -1:]
        for i in np.flatnonzero(better.any(1)):
            j = np.flatnonzero(better[i] & (s[i] > -np.inf))
            both_id, both = np.concatenate([self.best_id[i], own[j]]), np.concatenate([self.best[i], s[i, j]])
            order = np.lexsort((both_id, -both))[: self.k]
            self.best_id[i], self.best[i] = both_id[order], both[order]

    def rows(self) -> list[pa.Array]:
        q, k = np.nonzero(self.best > -np.inf)
        return [pa.array(self.ids[q], pa.int64()), pa.array(self.best_id[q, k], pa.int64()), pa.array(self.best[q, k], pa.float64())]


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def knn(
    queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", query_id: str = "query_id", query_vec: str = "vec",
    id_col: str = "doc_id", vec_col: str = "vec", skip_self: bool = False, small_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best rows for each query; metric cosine, dot or l2 (minus the distance)."""
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    if k < 1:
        raise ValueError("k must be positive")
    asked, rows = _rows(queries, query_id, query_vec, "query_id"), _rows(corpus, id_col, vec_col, "doc_id")
    first = asked.select(F.size("vec").alias("dim")).first()
    spark = corpus.sparkSession
    if first is None or first["dim"] < 1:
        return spark.createDataFrame([], HIT + ", rank long")
    dim = first["dim"]
    asked, rows = asked.filter(F.size("vec") == dim), rows.filter(F.size("vec") == dim)
    most = max(1, small_bytes // (8 * dim))
    some = asked.limit(most + 1).toArrow()
    if some.num_rows <= most:
        ids, v = some["query_id"].to_numpy(), _matrix(some["vec"], dim)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(ids, v, k, metric, skip_self)
            for b in batches:
                best.add(b.column(0).to_numpy(), _matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays(best.rows(), ["query_id", "doc_id", "score"])

        return _top(rows.mapInArrow(run, HIT), k)
    return _top(_cells(asked, rows, k, metric, dim, skip_self), k)


def _cells(asked: DataFrame, rows: DataFrame, k: int, metric: str, dim: int, skip_self: bool, query_rows: int = 4096, corpus_rows: int = 1 << 16, within: str | None = None) -> DataFrame:
    """The best rows of each cell of (set of queries, stripe of the corpus), with within also of one value of that column."""
    sets, stripes = (max(1, -(-df.count() // n)) for df, n in ((asked, query_rows), (rows, corpus_rows)))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(sets))).withColumn("stripe", spread(stripes))
    right = rows.withColumn("stripe", F.pmod(F.xxhash64("doc_id"), F.lit(stripes))).withColumn("part", spread(sets))

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        best = _Best(q["query_id"].to_numpy(), _matrix(q["vec"], dim), k, metric, skip_self)
        best.add(c["doc_id"].to_numpy(), _matrix(c["vec"], dim))
        return pa.table(best.rows(), names=["query_id", "doc_id", "score"])

    keys = ["stripe", "part", *([within] if within else [])]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, HIT)


def best_hit(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of the best row of each query."""
    best = F.max_by(F.struct("doc_id", "score"), F.struct("score", -F.col("doc_id"))).alias("b")
    return hits.groupBy("query_id").agg(best).select("query_id", "b.doc_id", "b.score")


def pairs_topk(rows: DataFrame, k: int, id_col: str = "doc_id", vec_col: str = "vec", tile: int = 4096) -> DataFrame:
    """(a, b, score), a < b: the k most similar pairs by cosine (V7).

    Rows are cut into tiles; each pair of tiles is a cell that passes on its k best pairs.
    """
    own = _rows(rows, id_col, vec_col, "id")
    first = own.select(F.size("vec").alias("dim")).first()
    if first is None:
        return rows.sparkSession.createDataFrame([], "a long, b long, score double")
    dim = first["dim"]
    own = own.filter(F.size("vec") == dim)
    tiles = max(1, -(-own.count() // tile))
    placed = own.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    cells = cells.select("id", "vec", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))

    def cell(t: pa.Table) -> pa.Table:
        ids, v, at = t["id"].to_numpy(), _matrix(t["vec"], dim), t["tile"].to_numpy()
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
        found: list[np.ndarray] = [np.empty((0, 2), np.int64)]
        score: list[np.ndarray] = [np.empty(0)]
        floor = -np.inf
        for s in range(0, len(left), 512):
            q = left[s : s + 512]
            c = _Best(ids[q], v[q], 1, "cosine", False).scores(v[right])
            c[ids[q][:, None] == ids[right][None]] = -np.inf
            if i == j:
                c[ids[q][:, None] > ids[right][None]] = -np.inf
            if c.size > k:
                floor = max(floor, np.partition(c.ravel(), c.size - k)[c.size - k])
            x, y = np.nonzero((c >= floor) & (c > -np.inf))
            found.append(np.sort(np.stack([ids[q][x], ids[right][y]], 1), axis=1))
            score.append(c[x, y])
        pair, value = np.concatenate(found), np.concatenate(score)
        top = np.lexsort((pair[:, 1], pair[:, 0], -value))[:k]
        return pa.table({"a": pair[top, 0], "b": pair[top, 1], "score": value[top]})

    return cells.groupBy("i", "j").applyInArrow(cell, "a long, b long, score double").orderBy(F.desc("score"), "a", "b").limit(k)


def maxsim(queries: DataFrame, docs: DataFrame, k: int, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """(query_id, doc_id, score, rank) by late interaction (V5): the sum over query tokens of the best dot product with a token of the document.

    queries (query_id, multi) and docs (doc_id, multi) hold a vector a token. Documents without tokens aren't found. The
    queries' tokens have to fit small_bytes; more of them are taken in several passes over the documents.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("multi").cast("array<array<double>>").alias("multi")).filter("query_id is not null and size(multi) > 0")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("multi").cast("array<array<double>>").alias("multi")).filter("doc_id is not null and size(multi) > 0")
    first = asked.select(F.size(F.col("multi")[0]).alias("dim")).first()
    if first is None:
        return docs.sparkSession.createDataFrame([], HIT + ", rank long")
    dim = first["dim"]
    whole = f"forall(multi, v -> size(v) = {dim} and forall(v, x -> x is not null))"
    asked, rows = asked.filter(whole), rows.filter(whole)
    token = 8 * dim
    total = asked.agg(F.sum(F.size("multi").cast("long"))).first()[0] or 0
    passes = max(1, -(-total * token // small_bytes))
    out = None
    for p in range(passes):  # one pass unless the queries outgrow what tasks may hold
        table = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).toArrow()
        part = _top(rows.mapInArrow(_maxsim(table, dim, k), HIT), k)
        out = part if out is None else out.unionByName(part)
    return out


#: Of late interaction: numbers of a block of dot products, and of the pairs that are offered at once.
BLOCK = 1 << 20


def _maxsim(asked: pa.Table, dim: int, k: int, block: int = BLOCK):
    ids = asked["query_id"].to_numpy()
    multi = asked["multi"].combine_chunks()
    multi = pa.concat_arrays(multi.chunks) if isinstance(multi, pa.ChunkedArray) else multi
    counts = np.diff(multi.offsets.to_numpy()).astype(np.int64)
    tokens = multi.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    end = np.cumsum(counts)
    begin = end - counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(ids, np.zeros((len(ids), 1)), k, "dot", False)
        for whole in batches:
            most = np.diff(whole.column(1).offsets.to_numpy()).max(initial=1)
            step = max(1, min(256, block // (32 * int(most)), block // max(1, len(ids))))  # documents
            for at in range(0, whole.num_rows if len(ids) else 0, step):
                b = whole.slice(at, step)
                lists = b.column(1)
                size = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                score = np.empty((len(ids), b.num_rows))
                q = 0
                while q < len(ids):  # queries whose tokens fit a block with these documents', one at least
                    to = max(q + 1, int(np.searchsorted(end, begin[q] + block // len(flat), "right")))
                    near = np.maximum.reduceat(flat @ tokens[begin[q] : end[to - 1]].T, np.cumsum(size) - size, axis=0)  # (documents, query tokens)
                    score[q:to] = np.add.reduceat(near, begin[q:to] - begin[q], axis=1).T
                    q = to
                best.offer(b.column(0).to_numpy(), np.round(score, 6) + 0.0)
        yield pa.RecordBatch.from_arrays(best.rows(), ["query_id", "doc_id", "score"])

    return run


def centroids(rows: DataFrame, group: str, dim: int, vec_col: str = "vec") -> DataFrame:
    """(group, centroid): the mean vector of each group, by one partial aggregate a dimension."""
    mean = F.array(*[F.avg(F.get(vec_col, F.lit(k)).cast("double")) for k in range(dim)])
    return rows.filter(F.col(vec_col).isNotNull()).groupBy(group).agg(mean.alias("centroid"))


def ivf_topk(queries: DataFrame, corpus: DataFrame, lists: DataFrame, k: int, probes: int, list_col: str = "label") -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine among the rows of the probes lists whose centroids are nearest.

    queries (query_id, vec), corpus (doc_id, vec, list_col), lists (list_col, centroid). Each list is joined with the
    queries that probe it in cells of bounded size, so the work is that of the probed lists alone and a long list is split.
    """
    near = knn(queries, lists, probes, "cosine", id_col=list_col, vec_col="centroid").select("query_id", F.col("doc_id").alias(list_col))
    asked = near.join(_rows(queries, "query_id", "vec", "query_id"), "query_id")
    rows = _rows(corpus, "doc_id", "vec", "doc_id", list_col)
    first = asked.select(F.size("vec").alias("dim")).first()
    if first is None:
        return corpus.sparkSession.createDataFrame([], HIT + ", rank long")
    return _top(_cells(asked, rows.filter(F.size("vec") == first["dim"]), k, "cosine", first["dim"], True, within=list_col), k)


def term_weights(tokens: DataFrame) -> DataFrame:
    """(doc_id, token, weight) of (doc_id, token): ln(1 + how often) (A6, the sparse shape of E10)."""
    return tokens.groupBy("doc_id", "token").agg(F.log1p(F.count("*").cast("double")).alias("weight"))


def idf(tokens: DataFrame, n_docs: int) -> DataFrame:
    """(token, df, idf) of (doc_id, token): ln(1 + (N - df + 0.5) / (df + 0.5)) (V9)."""
    return _idf(tokens.distinct(), n_docs)


def _idf(different: DataFrame, n_docs: int) -> DataFrame:
    """The idf of tokens that each document has once."""
    df = different.groupBy("token").agg(F.count("*").cast("long").alias("df"))
    return df.withColumn("idf", F.log1p((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def sparse_topk(query_tokens: DataFrame, doc_tokens: DataFrame, n_docs: int, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) by the sum over common tokens of both weights times the idf.

    query_tokens (doc_id, token) are joined with the documents' tokens as with an inverted file; tokens that no query has
    leave before anything is counted, and sums are partial aggregates, so a token that every document has doesn't weigh on
    one task.
    """
    doc_tokens = doc_tokens.join(query_tokens.select("token").distinct(), "token", "left_semi").select("doc_id", "token")
    w = term_weights(doc_tokens)
    q = term_weights(query_tokens).select(F.col("doc_id").alias("query_id"), "token", F.col("weight").alias("query_weight"))
    q = q.join(_idf(w, n_docs).select("token", "idf"), "token")  # both uses of w share its shuffle
    met = w.join(q, "token").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("query_weight") * F.col("idf")), 6).alias("score"))
    return _top(met, k)


def idf_of_texts(docs: DataFrame) -> DataFrame:
    """idf() over (doc_id, text): a task counts the documents of its tokens before anything moves, so no row is written a document's token.

    A null id is no document to df, though its row counts in N.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    n_docs, one = docs.count(), one_text_per_id(docs)
    counted = one.select(F.col("doc_id").isNotNull().alias("real"), "text").mapInArrow(parts.tidy(_document_counts), "token string, n long")
    df = counted.groupBy("token").agg(F.sum("n").alias("df"))
    return df.withColumn("idf", F.log1p((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def _document_counts(batches: Iterator[pa.RecordBatch], most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """(token, n) of (real, text): in how many of the texts a token is, in parts of some tokens."""
    found: Counter[bytes] = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        token, n = pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())
        found.clear()
        whole = pa.RecordBatch.from_arrays([token, n], ["token", "n"])
        for at in range(0, whole.num_rows, 1 << 14):
            yield whole.slice(at, 1 << 14)

    for whole in batches:
        for b in parts.slices(whole, 1):
            for real, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = set(parts.tokens(t)) if t else ()
                if real:
                    found.update(own)
                else:
                    found.update(dict.fromkeys(own, 0))
            if len(found) >= most:
                yield from flush()
    yield from flush()


#: Stands for a null id among numbers.
_NO_ID = -(1 << 63)


def one_text_per_id(docs: DataFrame, few: int = 1_000_000) -> DataFrame:
    """(doc_id, text) with the texts of an id that is repeated joined by line feeds. Only the ids are counted; where few are repeated only their texts move."""
    repeated = docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__id"))
    n = repeated.count()
    if not n:
        return docs
    joined = lambda df: df.groupBy("doc_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    if n > few:
        return joined(docs)
    ids, same = F.broadcast(repeated), F.col("doc_id").eqNullSafe(F.col("__id"))
    return docs.join(ids, same, "left_anti").unionByName(joined(docs.join(ids, same, "left_semi")))


def sparse_search(queries: DataFrame, docs: DataFrame, k: int, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """sparse_topk over (query_id, text) and (doc_id, text), for a set of queries that the tasks can hold.

    The documents are read once for the frequencies of the queries' tokens and once for the scores: a task multiplies the counts of
    some documents with the weights of all queries and passes on its k best a query, so no pair of a query and a document is written and no
    token gathers its documents in one task. Queries whose weights outgrow small_bytes are taken in several passes.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text")).toArrow()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weight: dict[int | None, dict[bytes, int]] = {}
    for q, t in zip(asked["query_id"].to_pylist(), asked["text"].to_pylist(), strict=True):
        own = weight.setdefault(q, {})
        for x in parts.tokens(t or ""):
            own[x] = own.get(x, 0) + 1
    weight = {q: own for q, own in weight.items() if own}
    if not weight:
        return spark.createDataFrame([], HIT + ", rank long")
    n_docs = docs.count()
    docs = one_text_per_id(docs)
    every = {t: i for i, t in enumerate(sorted(set(chain(*weight.values()))))}
    df = np.zeros(len(every))
    found = docs.filter("doc_id is not null").mapInArrow(parts.tidy(_frequencies(every)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for term, n in found.collect():
        df[term] = n
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    out, ids = None, list(weight)
    while ids:
        terms: dict[bytes, int] = {}
        take = 0
        while take < len(ids) and (not take or 8 * (take + 1) * len(terms.keys() | weight[ids[take]].keys()) <= small_bytes):
            for t in weight[ids[take]]:
                terms.setdefault(t, len(terms))
            take += 1
        w = np.zeros((take, len(terms)))
        for i, q in enumerate(ids[:take]):
            for t, c in weight[q].items():
                w[i, terms[t]] = np.log1p(c) * idf[every[t]]
        own = np.array([_NO_ID if q is None else q for q in ids[:take]], np.int64)
        part = docs.mapInArrow(parts.tidy(_sparse_scores(own, w, terms, k)), HIT)
        out, ids = part if out is None else out.unionByName(part), ids[take:]
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return _top(out.select(real("query_id"), real("doc_id"), "score"), k)


def _term_counts(batches: Iterator[pa.RecordBatch], terms: dict[bytes, int]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, counts) of some (doc_id, text) at a time: how often each document has each term."""
    width, get = len(terms), terms.get
    for whole in batches:
        for b in parts.slices(whole, 1, rows=min(1024, max(1, (1 << 20) // width))):
            lists = [parts.tokens(t) if t else [] for t in b.column(1).to_pylist()]
            size = np.array([len(x) for x in lists], np.int64)
            term = np.fromiter(map(get, chain.from_iterable(lists), repeat(-1)), np.int64, int(size.sum()))
            at = np.repeat(np.arange(len(lists)) * width, size) + term
            yield b.column(0), np.bincount(at[term >= 0], minlength=len(lists) * width).reshape(len(lists), width)


def _frequencies(terms: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms), np.int64)
        for _, counts in _term_counts(batches, terms):
            df += (counts > 0).sum(0)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(df[term], pa.int64())], ["term", "n"])

    return run


def _sparse_scores(ids: np.ndarray, weights: np.ndarray, terms: dict[bytes, int], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(ids, np.zeros((len(ids), 1)), k, "dot", False)
        for own, counts in _term_counts(batches, terms):
            score = weights @ np.log1p(counts, dtype=float).T
            # all weights are positive: 0 is without a common token
            best.offer(own.fill_null(_NO_ID).to_numpy(), np.where(score > 0, np.round(score, 6), -np.inf))
        yield pa.RecordBatch.from_arrays(best.rows(), ["query_id", "doc_id", "score"])

    return run


def rrf(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """(query_id, doc_id, score, rank): reciprocal-rank fusion of ranked lists."""
    every = lists[0].select("query_id", "doc_id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "doc_id", "rank"))
    fused = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))), 6).alias("score"))
    return _top(fused, k)


def store(rows: DataFrame, table: str) -> None:
    """(vector, text, id) replaced as a whole."""
    rows.select("vector", "text", "id").write.mode("overwrite").saveAsTable(table)


def store_path(rows: DataFrame, path: str) -> DataFrame:
    """V12 by path: written to a new version beside the old one, which stays readable; gives what was written."""
    out = f"{path}/v-{uuid.uuid4().hex[:12]}"
    rows.select("vector", "text", "id").write.parquet(out)
    return rows.sparkSession.read.parquet(out)


class Retriever:
    """Search and batch_search over an indexed corpus (doc_id, vec, text) with an embedder for the queries."""

    def __init__(self, corpus: DataFrame, embedder, top_k: int = 10) -> None:
        self.corpus, self.embedder, self.top_k = corpus, embedder, top_k

    def batch_search(self, queries: list[str], k: int | None = None, with_scores: bool = True) -> DataFrame:
        spark = self.corpus.sparkSession
        asked = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_id long, query string")
        asked = self.embedder.embed(asked, "query", "vec")
        hits = knn(asked, self.corpus, k or self.top_k).join(self.corpus.select("doc_id", "text"), "doc_id")
        return hits if with_scores else hits.drop("score")

    def search(self, query: str, k: int | None = None, with_scores: bool = True) -> DataFrame:
        return self.batch_search([query], k, with_scores).drop("query_id")


def enrich(hits: DataFrame, corpus: DataFrame, on: str = "doc_id") -> DataFrame:
    """The hits with the corpus's further columns, null where it has no such row."""
    return hits.join(corpus, on, "left")


def logits(queries: DataFrame, corpus: DataFrame, logit_scale: float) -> Column:
    """V14 as a column over a frame that holds both vectors."""
    return vector.scaled_logits(queries, corpus, logit_scale)
