"""The SQL of the named queries for an independent engine over the same tables."""

from __future__ import annotations

_DIM = 64


def _dense(value: str) -> str:
    """The hashed vector of a text."""
    return f"""(select list_transform(c, lambda x: case when n > 0 then round(x / n, 6) else 0.0 end) from (select c, sqrt(list_dot_product(c, c)) as n from (
      select list_transform(range({_DIM}), lambda k: len(list_filter(b, lambda y: y = k))::double) as c from (
      select list_transform(regexp_extract_all({value}, '[A-Za-z0-9]+'), lambda t: ('0x' || substr(md5(lower(t)), 1, 8))::bigint % {_DIM}) as b))))"""


def _cosine(a: str, b: str) -> str:
    size = f"sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))"
    return f"case when {size} = 0 then 0.0 else round(list_dot_product({a}, {b}) / ({size}), 6) end"


def _top(scored: str, k: int, by: str = "query_id", order: str = "score desc, doc_id") -> str:
    return f"select * from (select *, row_number() over (partition by {by} order by {order})::bigint as rank from ({scored})) where rank <= {k}"


_VECTORS = "select vec_id as doc_id, list_transform(embedding, lambda x: x::double) as vec, label::bigint as label from embeddings"
_MET = f"({_VECTORS}) c join (select doc_id as query_id, vec as q from ({_VECTORS}) where doc_id % 100 = 0) q on c.doc_id <> q.query_id"
_TOKENS = f"select doc_id // 10 as doc, doc_id % 10 as pos, vec, (doc_id % 10 < 8)::int as mask from ({_VECTORS})"
_CENTROIDS = f"""select label, list(v order by k) as centroid from (
  select label, k, avg(vec[k]) as v from ({_VECTORS}), range(1, {_DIM + 1}) r(k) group by label, k) group by label"""


def _knn(score: str, k: int) -> str:
    return _top(f"select query_id, doc_id, {score} as score from {_MET}", k)


def _pool(value: str, inner: str) -> str:
    return f"select doc, list({value} order by k) as vec from (select doc, k, {inner} as v from ({_TOKENS}) t, range(1, {_DIM + 1}) r(k) where mask <> 0 group by doc, k) group by doc"


_CHUNKS = """select doc_id, i as chunk_idx, doc_id * 65536 + i as chunk_id, substr(text, i * 1000 + 1, 1000) as chunk
  from (select doc_id, text, unnest(range(greatest(ceil((length(text) - 1000) / 1000.0), 0)::bigint + 1)) as i from documents where length(text) > 0)"""
_SEMANTIC = f"""with c as (select doc_id, chunk_idx, chunk_id, {_dense("chunk")} as v from ({_CHUNKS})), b as (select item_id as query_id, {_dense("text")} as q from benchmark)
  select query_id, c.doc_id as d, chunk_idx, chunk_id as doc_id, {_cosine("q", "v")} as score from c, b"""
_DOC_TOKENS = "select doc_id, lower(t) as token from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) as t from documents)"
_QUERY_TOKENS = "select query_id, lower(t) as token from (select item_id as query_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) as t from benchmark)"
_IDF = f"select token, df, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf from (select token, count(distinct doc_id)::bigint as df from ({_DOC_TOKENS}) group by token), (select count(*) as n from documents)"
_SPARSE = _top(
    f"""select query_id, doc_id, round(sum(dw * qw * idf), 6) as score from (select doc_id, token, ln(1 + count(*)) as dw from ({_DOC_TOKENS}) group by all)
  join (select query_id, token, ln(1 + count(*)) as qw from ({_QUERY_TOKENS}) group by all) using (token) join ({_IDF}) using (token) group by query_id, doc_id""",
    10,
)
_DENSE_DOCS = _top(
    f"select query_id, doc_id, {_cosine('q', 'v')} as score from (select doc_id, {_dense('text')} as v from documents where text is not null), (select item_id as query_id, {_dense('text')} as q from benchmark)", 10
)
_WORDS = r"list_filter(string_split_regex({0}, '[ \t\n\f\r]+'), lambda w: w <> '')"
_TITLE = r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\n\f\r]+', ' ', 'g'), ' ')"


def _overlap(a: str, b: str) -> str:
    tokens = "list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda t: lower(t)))"
    return f"len(list_intersect({tokens.format(a)}, {tokens.format(b)}))::double"


_PAIRS = """select u.conv_id, u.turn as query_turn, a.turn as doc_turn, u.text as query, a.text as document
  from conversations u join conversations a on u.conv_id = a.conv_id and u.role = 'user' and a.role = 'assistant'"""
_SCORED = f"select conv_id, query_turn, doc_turn, round(1 / (1 + exp(-({_overlap('query', 'document')} - 3.0))), 6) as relevance_score from ({_PAIRS})"
_SEGMENTS = "select event_id, ts, value - floor(value) as no_speech_prob, -(event_id % 10) / 10.0::double as avg_logprob from events"
_SPOKEN = f"select * from ({_SEGMENTS}) where not coalesce(no_speech_prob > 0.6 and avg_logprob < -0.5, false)"
_STORED = f"""select doc_id, text, source || '/' || doc_id || '.txt' as file_name, '2024-01-01 00:00:00' as modified, '2024-01-01 00:00:00' as created,
  case when text is null then null else {_dense("text")} end as embedding from documents"""
_ID = "sha256(concat_ws('|', coalesce(file_name, ''), coalesce(text, '')))"

SQL = {
    "embed_hash_dense": f"select doc_id, case when text is null then null else {_dense('text')} end as embedding from documents",
    "embed_hash_sparse": f"""select item_id, list_transform(range({_DIM}), lambda k: round(ln(1 + len(list_filter(b, lambda y: y = k))::double), 6)) as embedding from (
      select item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda t: ('0x' || substr(md5(lower(t)), 1, 8))::bigint % {_DIM}) as b from benchmark)""",
    "l2_norm": f"select doc_id as vec_id, round(sqrt(list_dot_product(vec, vec)), 6) as norm from ({_VECTORS})",
    "l2_normalized": f"select doc_id as vec_id, list_transform(vec, lambda x: round(x / n, 6) + 0.0) as unit from (select doc_id, vec, sqrt(list_dot_product(vec, vec)) as n from ({_VECTORS}))",
    "centroid_mean": f"select label, list_transform(centroid, lambda x: round(x, 6) + 0.0) as centroid from ({_CENTROIDS})",
    "knn_cosine_topk": _knn(_cosine("q", "vec"), 10),
    "dot_topk": _knn("round(list_dot_product(q, vec), 6)", 10),
    "l2_topk": f"select query_id, doc_id, -score + 0.0 as distance, rank from ({_knn('-round(list_distance(q, vec), 6)', 10)})",
    "neg_distance_score": _knn("-round(list_distance(q, vec), 6) + 0.0", 5),
    "argmax_label": f"select h.query_id, h.doc_id, h.score, e.label from ({_knn(_cosine('q', 'vec'), 1)}) h left join ({_VECTORS}) e on h.doc_id = e.doc_id",
    "pairs_topk": f"select a.doc_id as a, b.doc_id as b, {_cosine('a.vec', 'b.vec')} as score from ({_VECTORS}) a join ({_VECTORS}) b on a.doc_id < b.doc_id order by score desc, a, b limit 10",
    "ivf_topk": f"""with cent as ({_CENTROIDS}), asked as (select doc_id as query_id, vec as q from ({_VECTORS}) where doc_id % 100 = 0),
      near as ({_top(f"select query_id, q, label as doc_id, {_cosine('q', 'centroid')} as score from asked, cent", 3)})
      {_top(f"select query_id, c.doc_id, {_cosine('q', 'vec')} as score from near n join ({_VECTORS}) c on c.label = n.doc_id and c.doc_id <> n.query_id", 10)}""",
    "clip_logits": f"""select query_id, doc_id as label, round(score * exp(1.5), 5) as logit, rank from ({_top(f"select query_id, label as doc_id, round(list_dot_product(q, centroid), 6) as score from (select doc_id as query_id, vec as q from ({_VECTORS}) where doc_id % 100 = 0), ({_CENTROIDS})", 10)})""",
    "maxsim_topk": _top(
        f"""select query_id, doc_id, round(sum(best), 6) as score from (select q.doc as query_id, q.pos, t.doc as doc_id, max(list_dot_product(q.vec, t.vec)) as best
      from ({_TOKENS}) q, ({_TOKENS}) t where q.doc % 10 = 0 group by all) group by query_id, doc_id""",
        10,
    ),
    "semantic_search_docs": f"select query_id, d as doc_id, chunk_idx, score, rank from (select * exclude (doc_id) from ({_top(_SEMANTIC, 10)}))",
    "search_rerank": f"""select query_id, chunk_id, relevance_score, rank from ({_top(
        f'''select query_id, h.doc_id as chunk_id, round(1 / (1 + exp(-({_overlap("b.text", "c.chunk")} - 10.0))), 6) as relevance_score
        from (select query_id, doc_id from ({_top(_SEMANTIC, 100)})) h join ({_CHUNKS}) c on c.chunk_id = h.doc_id join benchmark b on b.item_id = h.query_id''',
        10, order="relevance_score desc, chunk_id",
    )})""",
    "sparse_tf": f"select doc_id, token, round(ln(1 + count(*)), 6) as weight from ({_DOC_TOKENS}) group by all",
    "sparse_idf": f"select token, df, round(idf, 6) as idf from ({_IDF})",
    "sparse_topk": _SPARSE,
    "rrf_hybrid": _top(f"select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 6) as score from (select query_id, doc_id, rank from ({_DENSE_DOCS}) union all select query_id, doc_id, rank from ({_SPARSE})) group by query_id, doc_id", 10),
    "pool_mean": _pool("round(v, 6) + 0.0", "avg(vec[k])"),
    "pool_cls": _pool("round(v, 6) + 0.0", "arg_min(vec[k], pos)"),
    "pool_last": _pool("round(v, 6) + 0.0", "arg_max(vec[k], pos)"),
    "sparse_log1p_max": _pool("round(v, 6) + 0.0", "max(ln(1 + greatest(vec[k], 0)))"),
    "ctx_window_similarity": f"""select doc, pos, {_cosine("list(x order by k)", "list(m order by k)")} as similarity from (
      select doc, pos, k, vec[k] as x, avg(vec[k]) over (partition by doc, k order by pos rows between 5 preceding and 1 preceding) as m from ({_TOKENS}), range(1, {_DIM + 1}) r(k))
      where m is not null group by doc, pos""",
    "chunk_fixed_overlap": """select doc_id, i as chunk_idx, substr(text, i * 900 + 1, 1000) as chunk from (
      select doc_id, text, unnest(range(greatest(ceil((length(text) - 1000) / 900.0), 0)::bigint + 1)) as i from documents where length(text) > 0)""",
    "chunk_sentence_pack": f"""with s as (select doc_id, text, list_transform(string_split_regex(regexp_replace(text, '[.;]\\z', ''), '[.;]'),
        lambda x: {{'done': []::varchar[], 'open': {_WORDS.format("x || '.'")}}}) as s from documents where length(text) > 0),
      r as (select doc_id, text, list_reduce(list_prepend({{'done': []::varchar[], 'open': []::varchar[]}}, s), lambda a, x:
        case when len(a.open) + len(x.open) >= 50 then {{'done': list_append(a.done, array_to_string(a.open || x.open, ' ')), 'open': []::varchar[]}}
        else {{'done': a.done, 'open': a.open || x.open}} end) as r from s),
      c as (select doc_id, case when len({_WORDS.format("text")}) < 50 then [text] when len(r.open) > 0 then list_append(r.done, array_to_string(r.open, ' ')) else r.done end as c from r)
      select doc_id, (i - 1)::bigint as chunk_idx, c[i] as chunk from (select doc_id, c, unnest(range(1, len(c) + 1)) as i from c)""",
    "html_strip": r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\f\r]+', ' ', 'g'), ' ') as text from pages""",
    "html_title": f"select page_id, {_TITLE} as title from pages",
    "link_unwrap": rf"select page_id, regexp_replace('see [' || {_TITLE} || '](' || url || ') and ![' || {_TITLE} || '](' || url || ')', '\[([^\]]+)\]\([^\)]+\)', '\1', 'g') as text from pages",
    "blank_line_clean": r"select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\f\r]')), chr(10)) as text from documents",
    "usage_tokens": f"select role, sum(len({_WORDS.format('text')}))::bigint as tokens from conversations group by role",
    "basename_ext": r"select page_id, b as basename, lower(regexp_extract(b, '\.([A-Za-z0-9]+)$', 1)) as extension from (select page_id, string_split_regex(url, '[/\\]')[-1] as b from pages)",
    "prompt_templates": "select item_id, '<Instruct>: Find passages' || chr(10) || '<Query>: ' || text as query, '<Document>: ' || text as document from benchmark",
    "title_body": "select doc_id, case when instr(text, chr(10)) > 0 then substr(text, 1, instr(text, chr(10)) - 1) else text end as title, case when instr(text, chr(10)) > 0 then substr(text, instr(text, chr(10)) + 1) else left(text, 0) end as body from documents",
    "search_tag": "select conv_id, turn, case when role = 'system' then null when turn > 0 then text else 'a' end as found from conversations",
    "lossy_decode": "select item_id, text || chr(65533) as text from benchmark",
    "base64_images": "select doc_id, case when octet_length(encode(text)) >= 69 then 'png' end as image_kind, case when octet_length(encode(text)) >= 69 then octet_length(encode(text)) + 4 end::bigint as n_bytes from documents",
    "overlap_from_ratio": "select doc_id, floor(n_chars * 0.25)::bigint as overlap from documents",
    "median_stddev": "select source, round(median(n_chars::double), 6) as median, round(stddev_pop(n_chars), 4) as deviation from documents group by source",
    "cumulative_tokens": f"select conv_id, turn, sum(len({_WORDS.format('text')})) over (partition by conv_id order by turn rows unbounded preceding)::bigint as tokens from conversations",
    "rerank_scores": _SCORED,
    "rerank_rank": f"select *, row_number() over (partition by conv_id, query_turn order by relevance_score desc, doc_turn)::bigint as rank from ({_SCORED})",
    "rerank_softmax2": f"select conv_id, query_turn, doc_turn, round(exp(y) / (exp(3.0) + exp(y)), 6) as relevance_score from (select *, {_overlap('query', 'document')} as y from ({_PAIRS}))",
    "rerank_threshold": f"select * from ({_SCORED}) where relevance_score > 0.5",
    "files_to_index": "select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
    "enrich_left_join": "select d.doc_id, lang, source, quality::bigint as quality, toxic::bigint as toxic from documents d left join labels l on d.doc_id = l.doc_id",
    "count_files": "select count(*)::bigint as documents, count(distinct source)::bigint as files from documents",
    "distinct_files": "select distinct source from documents",
    "union_all": "select 'document' as kind, doc_id as id from documents union all select 'page', page_id from pages",
    "page_rows": "select doc_id, i as page_number, p[i] as page from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from (select doc_id, string_split(text, chr(10)) as p from documents))",
    "buffer_flush_counts": "select b as buffer, count(*)::bigint as chunks, min(doc_id) as first, max(doc_id) as last from (select doc_id, ((row_number() over (order by doc_id) - 1) // 100)::bigint as b from documents) group by b",
    "no_speech_filter": f"select event_id, round(no_speech_prob, 6) as no_speech_prob, avg_logprob from ({_SPOKEN})",
    "audio_windows": f"select (epoch_us(ts) // 30000000)::bigint as window, count(*)::bigint as segments, min(event_id) as first from ({_SPOKEN}) group by 1",
    "avg_logprob": f"select event_id // 10 as segment, round(sum(ln(no_speech_prob)) / count(*), 6) as avg_logprob from ({_SEGMENTS}) where no_speech_prob > 0 group by 1",
    "frame_sampling": """select video, source_frame, frame_index from (select user_id as video, event_id as source_frame,
      (row_number() over (partition by user_id order by event_id) - 1)::bigint as frame_index from events where event_id % 30 = 0) where frame_index < 300""",
    "mixed_input_validation": "select conv_id, case when bool_or(role = 'system') and not bool_and(role = 'system') then 400 else 200 end::bigint as status from conversations group by conv_id",
    "response_index": "select conv_id, turn, (row_number() over (partition by conv_id order by turn) - 1)::bigint as index from conversations",
    "adapter_flat5": f"select embedding as embeddings, text, file_name, modified, created from ({_STORED})",
    "adapter_payload": f"select {_ID} as id, embedding as vector, text, file_name, modified, created from ({_STORED})",
    "adapter_metadata": f"select {_ID} as id, embedding as values, text as metadata_text, string_split(file_name, '/')[-1] as metadata_file from ({_STORED})",
    "adapter_columnar": f"""select doc_id // 100 as buffer, list(id order by id) as ids, list(text order by id) as documents, list(file_name order by id) as file_names
      from (select *, {_ID} as id from ({_STORED})) group by 1""",
    "adapter_capped": f"select substr(text, 1, 4098) as text, substr(file_name, 1, 255) as file_name, modified, created from ({_STORED})",
}
