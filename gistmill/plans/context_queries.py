"""Queries of the context pipeline: tokens, chunks, clean-up, ranking, pruning, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..operators import chunking, cleanup, compression, packing, retrieval
from . import pipelines
from ._base import keywords, normalized, ntok, paragraphs, phrases, query, sentences, table, tok, words


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "text")


def _paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(_docs(spark, sf_dir), C.Chunking("paragraph", separator="\n"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a benchmark text as its query."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    n = items.agg((F.max("item_id") + 1).alias("n"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id")).join(F.broadcast(n)).withColumn("item_id", F.pmod("sample_id", "n"))  # one row
    return docs.join(items, "item_id").select("sample_id", "query")


ASKED = "asked AS (SELECT doc_id AS sample_id, b.text AS query FROM documents JOIN benchmark b ON b.item_id = doc_id % (SELECT max(item_id) + 1 FROM benchmark))"
CHUNKS = f"chunks AS (SELECT doc_id AS sample_id, generate_subscripts(p, 1) - 1 AS chunk_index, unnest(p) AS text FROM (SELECT doc_id, {paragraphs('text')} AS p FROM documents))"
BM25_CORE = """w AS (SELECT sample_id, chunk_index, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda t: t <> '') AS ts FROM chunks),
post AS (SELECT sample_id, chunk_index, term, count(*) AS tf FROM (SELECT sample_id, chunk_index, unnest(ts) AS term FROM w) GROUP BY ALL),
corpus AS (SELECT sample_id, count(*) AS n, avg(len(ts)) AS avgdl FROM w GROUP BY sample_id),
df AS (SELECT sample_id, term, count(*) AS df FROM post GROUP BY ALL),
idf0 AS (SELECT df.*, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN corpus USING (sample_id)),
idf AS (SELECT *, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY sample_id) ELSE raw END AS idf FROM idf0),
q AS (SELECT sample_id, term, count(*) AS qtf FROM (SELECT sample_id, unnest(list_filter(string_split_regex(lower(query), '[ \\t\\n\\r\\f]+'), lambda t: t <> '')) AS term FROM asked) GROUP BY ALL),
score AS (SELECT post.sample_id, post.chunk_index, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avgdl))) AS score
          FROM post JOIN idf USING (sample_id, term) JOIN q USING (sample_id, term) JOIN w USING (sample_id, chunk_index) GROUP BY ALL)"""
BM25 = f"""{ASKED}, {CHUNKS},
{BM25_CORE},
bm25 AS (SELECT chunks.*, {ntok('text')} AS token_count, round(coalesce(score, 0.0), 9) AS score FROM chunks LEFT JOIN score USING (sample_id, chunk_index)),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, chunk_index) - 1 AS rank FROM bm25) WHERE rank < 10)"""


def _ranked(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    return retrieval.bm25_top(_paragraph_chunks(spark, sf_dir), _asked(spark, sf_dir), C.Retrieval(top_n=n))


@query(f"SELECT doc_id, {ntok('text')} AS n_tokens FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.n_tokens(F.col("text")).alias("n_tokens"))


MERGE = f"""list_reduce(list_transform({sentences('text')}, lambda s: {{'out': []::STRUCT(t VARCHAR, n INT)[], 'cur': s, 'n': {ntok('s')}}}),
 lambda a, s: CASE WHEN a.n + s.n > 256 AND a.cur <> '' THEN {{'out': list_append(a.out, {{'t': a.cur, 'n': a.n}}), 'cur': s.cur, 'n': s.n}}
   ELSE {{'out': a.out, 'cur': CASE WHEN a.cur = '' THEN s.cur ELSE a.cur || ' ' || s.cur END, 'n': a.n + s.n}} END,
 {{'out': []::STRUCT(t VARCHAR, n INT)[], 'cur': '', 'n': 0}})"""


@query(f"""WITH m AS (SELECT doc_id, {MERGE} AS a FROM documents), l AS (SELECT doc_id, CASE WHEN a.cur <> '' THEN list_append(a.out, {{'t': a.cur, 'n': a.n}}) ELSE a.out END AS c FROM m)
SELECT doc_id AS sample_id, chunk_index, md5(x.t) AS text_md5, x.n AS token_count FROM (SELECT doc_id, (generate_subscripts(c, 1) - 1)::int AS chunk_index, unnest(c) AS x FROM l)""")
def chunk_sentence(spark, sf_dir):
    return chunking.chunk(_docs(spark, sf_dir)).select("sample_id", "chunk_index", F.md5("text").alias("text_md5"), "token_count")


@query(f"WITH {CHUNKS} SELECT sample_id, chunk_index::int AS chunk_index, md5(text) AS text_md5, {ntok('text')} AS token_count FROM chunks")
def chunk_paragraph(spark, sf_dir):
    return _paragraph_chunks(spark, sf_dir).select("sample_id", "chunk_index", F.md5("text").alias("text_md5"), "token_count")


def _windows_sql(size: int, step: int) -> str:
    return f"""WITH t AS (SELECT doc_id, {tok('text')} AS ts FROM documents),
s AS (SELECT doc_id, ts, unnest(list_filter(range(0, len(ts), {step}), lambda i: i = 0 OR i - {step} + {size} < len(ts))) AS i FROM t)
SELECT doc_id AS sample_id, (i // {step})::int AS chunk_index, md5(array_to_string(ts[i + 1:i + {size}], '')) AS text_md5, least({size}, len(ts) - i)::int AS token_count, i::int AS start FROM s"""


@query(_windows_sql(64, 64))
def chunk_fixed(spark, sf_dir):
    found = chunking.chunk(_docs(spark, sf_dir), C.Chunking("fixed_tokens", 64))
    return found.select("sample_id", "chunk_index", F.md5("text").alias("text_md5"), "token_count", "start")


@query(_windows_sql(64, 48))
def chunk_sliding(spark, sf_dir):
    found = chunking.chunk(_docs(spark, sf_dir), C.Chunking("sliding_window", 64, 16))
    return found.select("sample_id", "chunk_index", F.md5("text").alias("text_md5"), "token_count", "start")


@query(f"""SELECT doc_id, len({phrases('text')})::int AS n_phrases, len({sentences('text')})::int AS n_sentences,
len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::int AS n_words, md5(array_to_string({phrases('text')}, '|')) AS phrases_md5, md5(array_to_string({sentences('text')}, '|')) AS sentences_md5 FROM documents""")
def split_units(spark, sf_dir):
    own = {g: T.units(F.col("text"), g) for g in T.UNITS}
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(own["phrase"]).alias("n_phrases"), F.size(own["sentence"]).alias("n_sentences"), F.size(own["token"]).alias("n_words"),
        F.md5(F.array_join(own["phrase"], "|")).alias("phrases_md5"), F.md5(F.array_join(own["sentence"], "|")).alias("sentences_md5"),
    )


SYNCED = r"list_filter(string_split(regexp_replace(text, '([.!?][ \t\n\r\f]+)', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


@query(f"SELECT doc_id, len({SYNCED})::int AS n, md5(array_to_string({SYNCED}, chr(2))) AS said, true AS lossless FROM documents")
def sync_sentences(spark, sf_dir):
    own = T.synced_sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(own).alias("n"), F.md5(F.array_join(own, "\u0002")).alias("said"), (F.array_join(own, "") == F.col("text")).alias("lossless"))


CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace({0}, 'https?://[^\s<>"'']+|www\.[^\s<>"'']+', '', 'g'), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}', '', 'g'), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id, md5({CLEAN.format('html')}) AS clean_md5, length({CLEAN.format('html')})::int AS n FROM pages")
def clean_pages(spark, sf_dir):
    own = T.clean(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(own).alias("clean_md5"), F.length(own).alias("n"))


@query(f"""WITH {CHUNKS}, c AS (SELECT sample_id, chunk_index, substr({CLEAN.format('text')}, 1, 2048) AS text, length({CLEAN.format('text')}) AS n FROM chunks),
d AS (SELECT *, row_number() OVER (PARTITION BY sample_id, lower(trim(text)) ORDER BY chunk_index) AS k FROM c WHERE n >= 10)
SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY chunk_index) - 1)::int AS chunk_index, md5(text) AS text_md5, {ntok('text')} AS token_count FROM d WHERE k = 1""")
def clean_chunks(spark, sf_dir):
    return cleanup.clean_chunks(_paragraph_chunks(spark, sf_dir)).select("sample_id", "chunk_index", F.md5("text").alias("text_md5"), "token_count")


@query(f"""WITH {CHUNKS} SELECT sample_id, chunk_index::int AS chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, lower(trim(text)) ORDER BY chunk_index) AS k FROM chunks) WHERE k = 1""")
def dedup_chunks(spark, sf_dir):
    return cleanup.keep_first(_paragraph_chunks(spark, sf_dir), "sample_id", "text", "chunk_index").select("sample_id", "chunk_index")


CUT60 = f"array_to_string({tok('text')}[1:60], '')"


@query(f"""SELECT doc_id, len(a)::int AS n_keywords, CASE WHEN len(a) = 0 THEN 0.0 ELSE 100.0 * len(list_intersect(a, b)) / len(a) END AS retention,
CASE WHEN n = 0 THEN 0.0 ELSE 1 - least(n, 60) / n END AS ratio FROM (SELECT doc_id, {keywords('text')} AS a, {keywords(CUT60)} AS b, {ntok('text')} AS n FROM documents)""")
def keyword_retention(spark, sf_dir):
    text, short = F.col("text"), T.truncate_tokens(F.col("text"), F.lit(60))
    n = T.n_tokens(text)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.keywords(text)).alias("n_keywords"), T.keyword_retention(text, short).alias("retention"), T.compression_ratio(n, F.least(n, F.lit(60))).alias("ratio"))


@query(f"""WITH {ASKED}, a AS (SELECT sample_id, query, text, {normalized('query')} AS na, {normalized('text')} AS nt FROM asked JOIN documents ON doc_id = sample_id)
SELECT sample_id, contains(nt, na) AS retained, contains(nt, split_part(na, ' ', 1)) AS first_word, true AS yes_no, false AS empty FROM a""")
def answer_retained(spark, sf_dir):
    rows = _asked(spark, sf_dir).join(_docs(spark, sf_dir), "sample_id")
    first = F.split_part(T.normalize(F.col("query")), F.lit(" "), F.lit(1))
    return rows.select(
        "sample_id", T.answer_retained(F.col("query"), F.col("text")).alias("retained"), T.answer_retained(first, F.col("text")).alias("first_word"),
        T.answer_retained(F.lit("Yes."), F.col("text")).alias("yes_no"), T.answer_retained(F.lit(" ?"), F.col("text")).alias("empty"),
    )


ANSWER_WORDS = "list_filter(string_split({0}, ' '), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


@query(f"""WITH b AS (SELECT item_id, {ANSWER_WORDS.format(normalized('text'))} AS w FROM benchmark), p AS (SELECT x.item_id, x.w AS p, y.w AS g FROM b x JOIN b y ON y.item_id = x.item_id + 1 OR y.item_id = x.item_id),
c AS (SELECT item_id, p, g, list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda z: z = t)), len(list_filter(g, lambda z: z = t))))) AS common FROM p)
SELECT item_id, p = g AS exact, CASE WHEN len(p) + len(g) = 0 THEN 1.0 WHEN len(p) = 0 OR len(g) = 0 THEN 0.0 ELSE 2.0 * common / (len(p) + len(g)) END AS f1 FROM c""")
def answer_scores(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    a, b = items.select("item_id", F.col("text").alias("p")), items.select(F.col("item_id").alias("i"), F.col("text").alias("g"))
    pairs = b.select("g", F.explode(F.array(F.col("i"), F.col("i") - 1)).alias("item_id")).join(a, "item_id")
    return pairs.select("item_id", T.exact_match(F.col("p"), F.col("g")).alias("exact"), T.bag_f1(T.answer_words(F.col("p")), T.answer_words(F.col("g"))).alias("f1"))


@query(f"WITH {BM25} SELECT sample_id, chunk_index::int AS chunk_index, rank::int AS rank, score FROM ranked")
def bm25_topn(spark, sf_dir):
    return _ranked(spark, sf_dir).select("sample_id", "chunk_index", "rank", "score")


UNIT = "list_transform({0}::double[], lambda x: x / sqrt(list_inner_product({0}::double[], {0}::double[])))"


@query(f"""WITH q AS (SELECT label, embedding AS e FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k = 1)
SELECT sample_id, chunk_index, rank::int AS rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(score, 9) DESC, chunk_index) - 1 AS rank
FROM (SELECT v.label AS sample_id, vec_id AS chunk_index, list_inner_product({UNIT.format('embedding')}, {UNIT.format('e')}) AS score FROM embeddings v JOIN q ON q.label = v.label)) WHERE rank < 5""")
def dense_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("sample_id"), F.col("vec_id").alias("chunk_index"), F.col("embedding").alias("vector"))
    asked = rows.groupBy("sample_id").agg(F.min_by("vector", "chunk_index").alias("query_vector"))
    scored = retrieval.dense(rows, asked).withColumn("score", F.round("score", 9))
    return retrieval.top_n(scored, 5).select("sample_id", "chunk_index", "rank", "score")


@query(f"""WITH {BM25}, n AS (SELECT count(*) AS n FROM embeddings), d AS (SELECT sample_id, chunk_index, list_inner_product({UNIT.format('c.embedding')}, {UNIT.format('q.embedding')}) AS dense
  FROM bm25, n JOIN embeddings c ON c.vec_id = (sample_id * 7 + chunk_index) % n JOIN embeddings q ON q.vec_id = sample_id % n),
m AS (SELECT sample_id, chunk_index, dense, score, min(dense) OVER s AS dl, max(dense) OVER s AS dh, min(score) OVER s AS bl, max(score) OVER s AS bh FROM d JOIN bm25 USING (sample_id, chunk_index) WINDOW s AS (PARTITION BY sample_id)),
h AS (SELECT sample_id, chunk_index, round(0.5 * CASE WHEN dh - dl < 1e-9 THEN 0 ELSE (dense - dl) / (dh - dl) END + 0.5 * CASE WHEN bh - bl < 1e-9 THEN 0 ELSE (score - bl) / (bh - bl) END, 6) AS score FROM m)
SELECT sample_id, chunk_index::int AS chunk_index, rank::int AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, chunk_index) - 1 AS rank FROM h) WHERE rank < 3""")
def hybrid_topn(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.agg(F.count("*").alias("n"))
    sparse = retrieval.bm25_scores(_paragraph_chunks(spark, sf_dir), _asked(spark, sf_dir)).withColumn("score", F.round("score", 9))
    rows = sparse.join(F.broadcast(n)).withColumn("c", F.pmod(F.col("sample_id") * 7 + F.col("chunk_index"), "n"))  # one row
    rows = rows.join(vectors.toDF("c", "vector"), "c").select("sample_id", "chunk_index", "score", "vector")
    asked = _docs(spark, sf_dir).select("sample_id").join(F.broadcast(n)).withColumn("q", F.pmod("sample_id", "n"))
    asked = asked.join(vectors.toDF("q", "query_vector"), "q").select("sample_id", "query_vector")
    mixed = retrieval.mixed(rows, asked).withColumn("score", F.round("score", 6))
    return retrieval.top_n(mixed, 3).select("sample_id", "chunk_index", "rank", "score")


def _pruned_sql(split: str) -> str:
    return f"""u AS (SELECT sample_id, chunk_index, generate_subscripts(us, 1) - 1 AS unit_index, unnest(us) AS unit FROM (SELECT sample_id, chunk_index, {split} AS us FROM ranked)),
ut AS (SELECT *, unnest(CASE WHEN len(ts) = 0 THEN [NULL] ELSE ts END) AS t FROM (SELECT *, regexp_extract_all(lower(unit), '[a-z0-9'']+') AS ts FROM u)),
uw AS (SELECT *, CASE WHEN t IS NOT NULL THEN 1.0 / count(*) OVER (PARTITION BY sample_id, chunk_index, t) END AS w FROM ut),
us AS (SELECT sample_id, chunk_index, unit_index, any_value(unit) AS unit, round(coalesce(avg(w), 0), 12) AS s FROM uw GROUP BY ALL),
ur AS (SELECT *, row_number() OVER (PARTITION BY sample_id, chunk_index ORDER BY s DESC, unit_index) AS r, count(*) OVER (PARTITION BY sample_id, chunk_index) AS n FROM us),
pt AS (SELECT sample_id, chunk_index, string_agg(unit, ' ' ORDER BY unit_index) AS cut FROM ur WHERE r <= greatest(1, trunc(n * (1.0::double - 0.7::double))) GROUP BY ALL),
pruned AS (SELECT ranked.* EXCLUDE (text, token_count), coalesce(cut, text) AS text, {ntok('coalesce(cut, text)')} AS token_count FROM ranked LEFT JOIN pt USING (sample_id, chunk_index))"""


def _compress(spark, sf_dir, granularity):
    pruned = compression.prune_units(_ranked(spark, sf_dir), 0.7, granularity)
    return pruned.select("sample_id", "chunk_index", "rank", F.md5("text").alias("text_md5"), "token_count")


PRUNED = "SELECT sample_id, chunk_index::int AS chunk_index, rank::int AS rank, md5(text) AS text_md5, token_count FROM pruned"


@query(f"WITH {BM25}, {_pruned_sql(phrases('text'))} {PRUNED}")
def compress_phrase(spark, sf_dir):
    return _compress(spark, sf_dir, "phrase")


@query(f"WITH {BM25}, {_pruned_sql(sentences('text'))} {PRUNED}")
def compress_sentence(spark, sf_dir):
    return _compress(spark, sf_dir, "sentence")


@query(f"WITH {BM25}, {_pruned_sql('''list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')''')} {PRUNED}")
def compress_token(spark, sf_dir):
    return _compress(spark, sf_dir, "token")


def _budget_sql(budget: int) -> str:
    return f"""held AS (SELECT * EXCLUDE (text, token_count, before), least(token_count, {budget} - before)::int AS token_count, CASE WHEN before + token_count <= {budget} THEN text ELSE array_to_string({tok('text')}[1:{budget} - before], '') END AS text
FROM (SELECT *, sum(token_count) OVER (PARTITION BY sample_id ORDER BY rank ROWS UNBOUNDED PRECEDING)::bigint - token_count AS before FROM pruned) WHERE before < {budget})"""


@query(f"WITH {BM25}, {_pruned_sql(phrases('text'))}, {_budget_sql(150)} SELECT sample_id, chunk_index::int AS chunk_index, rank::int AS rank, md5(text) AS text_md5, token_count FROM held")
def compress_budget(spark, sf_dir):
    found = compression.compress(_ranked(spark, sf_dir), C.Compression(token_budget=150))
    return found.select("sample_id", "chunk_index", "rank", F.md5("text").alias("text_md5"), "token_count")


def _pack_sql(source: str, strategy: str, budget: int) -> str:
    place = {
        "decreasing": "r",
        "round_robin": "CASE WHEN r % 2 = 0 THEN r // 2 ELSE n - 1 - (r - 1) // 2 END",
        "edges_first": "CASE WHEN r < a THEN r WHEN r < a + b THEN n - b + r - a ELSE r - b END",
    }[strategy]
    return f"""pk AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n, row_number() OVER (PARTITION BY sample_id ORDER BY rank) - 1 AS r FROM {source}),
pe AS (SELECT *, greatest(1, trunc(n * 0.4::double))::bigint AS a0, greatest(1, trunc(n * 0.3::double))::bigint AS b0 FROM pk),
pa AS (SELECT *, CASE WHEN a0 + b0 > n THEN n // 2 ELSE a0 END AS a, CASE WHEN a0 + b0 > n THEN n - n // 2 ELSE b0 END AS b FROM pe),
pp AS (SELECT *, {place} AS position FROM pa),
pc AS (SELECT *, sum(token_count) OVER (PARTITION BY sample_id ORDER BY position ROWS UNBOUNDED PRECEDING)::bigint - token_count AS before FROM pp),
pu AS (SELECT * EXCLUDE (text), least(token_count, {budget} - before)::int AS tokens_used, token_count > {budget} - before AS truncated,
       CASE WHEN before + token_count <= {budget} THEN text ELSE array_to_string({tok('text')}[1:{budget} - before], '') END AS text FROM pc WHERE before < {budget} OR (token_count = 0 AND before <= {budget})),
packed AS (SELECT *, CASE WHEN i < m * 0.4::double THEN 'start' WHEN i >= m * (1.0::double - 0.3::double) THEN 'end' ELSE 'middle' END AS zone
  FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY position) - 1 AS i, count(*) OVER (PARTITION BY sample_id) AS m FROM pu))"""


POSITIONS = "SELECT sample_id, chunk_index::int AS chunk_index, position::int AS position, zone, truncated, tokens_used, score, md5(text) AS text_md5 FROM packed"


def _positions(spark, sf_dir, strategy):
    found = packing.position_map(_ranked(spark, sf_dir), C.Packing(strategy, 400))
    return found.select("sample_id", "chunk_index", "position", "zone", "truncated", "tokens_used", "score", F.md5("text").alias("text_md5"))


@query(f"WITH {BM25}, {_pack_sql('ranked', 'round_robin', 400)} {POSITIONS}")
def pack_round_robin(spark, sf_dir):
    return _positions(spark, sf_dir, "round_robin")


@query(f"WITH {BM25}, {_pack_sql('ranked', 'edges_first', 400)} {POSITIONS}")
def pack_edges_first(spark, sf_dir):
    return _positions(spark, sf_dir, "edges_first")


@query(f"WITH {BM25}, {_pack_sql('ranked', 'decreasing', 400)} {POSITIONS}")
def pack_decreasing(spark, sf_dir):
    return _positions(spark, sf_dir, "decreasing")


@query(f"""WITH {BM25}, {_pruned_sql(phrases('text'))}, {_budget_sql(2048)}, {_pack_sql('held', 'round_robin', 4096)},
ctx AS (SELECT sample_id, string_agg(text, chr(10) || chr(10) ORDER BY position) AS context, count(*) AS n_packed, sum(tokens_used)::bigint AS tokens_packed FROM packed GROUP BY sample_id)
SELECT sample_id, md5(context) AS context_md5, n_packed, tokens_packed, {ntok('text')} AS input_tokens, {ntok('context')} AS output_tokens FROM ctx JOIN documents ON doc_id = sample_id""")
def context_pipeline(spark, sf_dir):
    """Rank, prune, hold to the budget, pack; every document with its query in one plan."""
    held = compression.compress(_ranked(spark, sf_dir))
    packed = packing.pack(held).join(_docs(spark, sf_dir), "sample_id")
    return packed.select("sample_id", F.md5("context").alias("context_md5"), "n_packed", "tokens_packed", T.n_tokens(F.col("text")).alias("input_tokens"), T.n_tokens(F.col("context")).alias("output_tokens"))


@query()
def context_run(spark, sf_dir):
    """The whole context pipeline with its default settings: chunk, clean, rank, prune, pack; every document with its query."""
    run = pipelines.run_context(_docs(spark, sf_dir).join(_asked(spark, sf_dir), "sample_id"))
    return run.result.select("sample_id", F.md5("context").alias("context_md5"), "n_packed", "tokens_packed", "input_tokens", "output_tokens", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents) SELECT doc_id, CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_distinct(ws)) / len(ws) + 0.1 * len(list_filter(ws, lambda x: regexp_matches(x, '[0-9]'))) END AS density
FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM documents)""")
def info_density(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.info_density(F.col("text")).alias("density"))


@query(f"WITH {BM25} SELECT sample_id, chunk_index::int AS chunk_index, score FROM (SELECT *, rank() OVER (PARTITION BY sample_id ORDER BY score DESC) AS k FROM bm25) WHERE k <= 3")
def top_with_ties(spark, sf_dir):
    scored = retrieval.bm25_scores(_paragraph_chunks(spark, sf_dir), _asked(spark, sf_dir)).withColumn("score", F.round("score", 9))
    return retrieval.at_least_kth(scored, 3).select("sample_id", "chunk_index", "score")
