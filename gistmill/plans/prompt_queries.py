"""Queries of the prompt pipeline: budgets, context and sentence selection, token pruning, assembly, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..operators import metrics, prompt
from ..sources import adapters, cache
from . import pipelines
from ._base import keywords, normalized, ntok, query, table, tok
from .context_queries import ASKED, BM25_CORE, CHUNKS, _asked, _docs, _paragraph_chunks

#: Conversations as samples: the system turn instructs, the last user turn asks, all others are contexts.
ROLES = f"""turns AS (SELECT conv_id AS sample_id, turn, role, coalesce(text, '') AS text, {ntok('text')} AS n, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last FROM conversations),
part AS (SELECT *, CASE WHEN role = 'system' THEN 'i' WHEN turn = last THEN 'q' ELSE 'c' END AS kind FROM turns),
ctx AS (SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY turn) - 1)::int AS context_index, text, n AS token_count FROM part WHERE kind = 'c'),
sample AS (SELECT sample_id, coalesce(sum(n) FILTER (kind = 'i'), 0)::bigint AS n_instruction, coalesce(sum(n) FILTER (kind = 'q'), 0)::bigint AS n_question,
  coalesce(list(n ORDER BY turn) FILTER (kind = 'c'), []) AS context_tokens, coalesce(string_agg(text, '' ORDER BY turn) FILTER (kind = 'i'), '') AS instruction, coalesce(string_agg(text, '' ORDER BY turn) FILTER (kind = 'q'), '') AS question FROM part GROUP BY sample_id)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(W.partitionBy("sample_id"))
    kind = F.when(F.col("role") == "system", "i").when(F.col("turn") == last, "q").otherwise("c")
    return turns.withColumn("kind", kind).withColumn("token_count", T.n_tokens(F.col("text")))


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    own = W.partitionBy("sample_id").orderBy("turn")
    rows = _parts(spark, sf_dir).filter("kind = 'c'")
    return rows.select("sample_id", (F.row_number().over(own) - 1).alias("context_index"), "text", "token_count")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir)
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("token_count"))), F.lit(0)).cast("long")
    said = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("turn", "text")))), lambda x: x["text"]), "")
    counts = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "c", F.struct("turn", "token_count")))), lambda x: x["token_count"])
    return rows.groupBy("sample_id").agg(total("i").alias("n_instruction"), total("q").alias("n_question"), counts.alias("context_tokens"), said("i").alias("instruction"), said("q").alias("question"))


BUDGET = """budget AS (SELECT *, n_instruction + n_question + coalesce(list_sum(context_tokens), 0) AS total, coalesce(list_sum(context_tokens), 0) AS n_context FROM sample),
alloc AS (SELECT *, greatest(0, greatest(0, trunc(total * 0.5::double)::bigint - n_instruction - n_question) + 100)::bigint AS context_budget, trunc(total * 0.5::double)::bigint AS target FROM budget)"""


@query(f"""WITH {ROLES}, {BUDGET} SELECT sample_id, total::bigint AS total, target, context_budget,
array_to_string(list_transform(context_tokens, lambda x: CASE WHEN n_context = 0 THEN 0 ELSE trunc(context_budget * x / n_context)::bigint END), ',') AS per_context FROM alloc""")
def budget_alloc(spark, sf_dir):
    found = prompt.allocate(_samples(spark, sf_dir))
    return found.select("sample_id", "total", "target", "context_budget", F.array_join(F.transform("per_context", lambda x: x.cast("string")), ",").alias("per_context"))


WORD = "lower(trim(translate(x, chr(10) || chr(13) || chr(9) || chr(12), '    ')))"
LOSSES = f"""tk AS (SELECT sample_id, context_index, generate_subscripts(ts, 1) - 1 AS pos, unnest(ts) AS x FROM (SELECT *, {tok('text')} AS ts FROM ctx)),
tw AS (SELECT *, {WORD} AS word FROM tk),
wc AS (SELECT word, count(*) AS c FROM tw GROUP BY word),
wl AS (SELECT word, ln(((SELECT sum(c) FROM wc) + (SELECT count(*) FROM wc)) / (c + 1)) AS loss FROM wc),
losses AS (SELECT sample_id, context_index, pos, x AS tok, loss FROM tw JOIN wl USING (word)),
ppl AS (SELECT sample_id, context_index, exp(avg(loss)) AS ppl, count(*) AS n_scored FROM losses WHERE pos < 1024 GROUP BY ALL),
scored AS (SELECT ctx.*, round(coalesce(ppl, 0), 9) AS score FROM ctx LEFT JOIN ppl USING (sample_id, context_index))"""


def _losses(spark, sf_dir):
    return prompt.unigram_losses(_contexts(spark, sf_dir), ["sample_id", "context_index"])


def _scored(spark, sf_dir, method="llmlingua"):
    ppl = prompt.perplexity(_losses(spark, sf_dir), ["sample_id", "context_index"])
    rows = _contexts(spark, sf_dir).join(ppl, ["sample_id", "context_index"], "left")
    return rows.withColumn("score", F.round(prompt.context_scores(F.coalesce("ppl", F.lit(0.0)), F.col("token_count"), method), 9)).drop("ppl", "n_scored")


@query(f"WITH {ROLES}, {LOSSES} SELECT sample_id, context_index, round(ppl, 6) AS ppl, n_scored FROM ppl")
def context_perplexity(spark, sf_dir):
    return prompt.perplexity(_losses(spark, sf_dir), ["sample_id", "context_index"]).withColumn("ppl", F.round("ppl", 6))


@query(f"WITH {ROLES}, {LOSSES} SELECT sample_id, context_index, round(-score + 2 * token_count / 250, 6) AS score FROM scored")
def context_rank_question(spark, sf_dir):
    return _scored(spark, sf_dir, "longllmlingua").select("sample_id", "context_index", F.round("score", 6).alias("score"))


CONDITIONED = f"""{ROLES.replace('ctx AS (', 'ctx0 AS (')},
ctx AS (SELECT sample_id, context_index, text || ' ' || question || '{prompt.CONDITION}' AS text, token_count FROM ctx0 JOIN sample USING (sample_id)), {LOSSES}"""


@query(f"WITH {CONDITIONED} SELECT sample_id, context_index, round(-score + 2 * token_count / 250, 6) AS score FROM scored")
def context_rank_conditioned(spark, sf_dir):
    """Perplexity of each context with the question after it."""
    ranked = prompt.rank_contexts(_contexts(spark, sf_dir), _samples(spark, sf_dir), "longllmlingua", "after")
    return ranked.select("sample_id", "context_index", F.round("score", 6).alias("score"))


@query(f"""WITH {ROLES}, asked AS (SELECT sample_id, question AS query FROM sample), chunks AS (SELECT sample_id, context_index AS chunk_index, text FROM ctx), {BM25_CORE}
SELECT sample_id, context_index, round(coalesce(score, 0.0), 6) AS score FROM ctx LEFT JOIN (SELECT sample_id, chunk_index AS context_index, score FROM score) USING (sample_id, context_index)""")
def context_rank_bm25(spark, sf_dir):
    """Contexts of a conversation against its question."""
    ranked = prompt.rank_contexts(_contexts(spark, sf_dir), _samples(spark, sf_dir), "bm25")
    return ranked.select("sample_id", "context_index", F.round("score", 6).alias("score"))


SELECT = f"""{ROLES}, {BUDGET}, {LOSSES},
so AS (SELECT sample_id, list({{'i': context_index, 'n': token_count}} ORDER BY score DESC, context_index) AS items, any_value(context_budget) AS t FROM scored JOIN alloc USING (sample_id) GROUP BY sample_id),
sf AS (SELECT sample_id, t, list_reduce(list_transform(items, lambda x: {{'kept': [x.i], 'total': x.n::bigint, 'stop': false}}),
  lambda a, x: CASE WHEN a.stop OR (t > 0 AND a.total + x.total > t) THEN {{'kept': a.kept, 'total': a.total, 'stop': true}} ELSE {{'kept': list_concat(a.kept, x.kept), 'total': a.total + x.total, 'stop': false}} END,
  {{'kept': []::int[], 'total': 0::bigint, 'stop': false}}) AS f FROM so),
chosen AS (SELECT sample_id, (generate_subscripts(f.kept, 1) - 1)::int AS rank, unnest(f.kept) AS context_index FROM sf)"""


def _chosen(spark, sf_dir):
    budgets = prompt.allocate(_samples(spark, sf_dir)).select("sample_id", "context_budget")
    scored = _scored(spark, sf_dir).join(budgets, "sample_id")
    return prompt.select_contexts(scored, F.col("context_budget"), F.lit(1 << 30))


@query(f"WITH {SELECT} SELECT sample_id, rank, context_index FROM chosen")
def context_select(spark, sf_dir):
    return _chosen(spark, sf_dir)


@query(f"""WITH {SELECT}, c AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM chosen)
SELECT sample_id, context_index, (row_number() OVER (PARTITION BY sample_id ORDER BY context_index) - 1)::int AS original, CASE WHEN rank % 2 = 0 THEN rank // 2 ELSE n - 1 - (rank - 1) // 2 END::int AS two_stage FROM c""")
def context_reorder(spark, sf_dir):
    chosen = _chosen(spark, sf_dir)
    original = prompt.reorder(chosen, "original").withColumnRenamed("position", "original")
    return prompt.reorder(original, "two_stage").select("sample_id", "context_index", "original", F.col("position").alias("two_stage"))


SENTENCES = f"""sent AS (SELECT sample_id, context_index, (generate_subscripts(ss, 1) - 1)::int AS sentence_index, unnest(ss) AS text FROM (SELECT *, list_filter(string_split(regexp_replace(text, '([.!?][ \\t\\n\\r\\f]+)', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS ss FROM ctx)),
sc AS (SELECT *, {ntok('text')} AS token_count, round(length(text) / (1 + sentence_index)::double, 6) AS raw, count(*) OVER (PARTITION BY sample_id, context_index) AS m FROM sent),
sb AS (SELECT *, raw + CASE WHEN sentence_index < 1 THEN 100.0 ELSE 0 END + CASE WHEN sentence_index >= m - 1 THEN 100.0 ELSE 0 END AS score FROM sc),
si AS (SELECT sample_id, list({{'c': context_index, 'i': sentence_index, 'n': token_count}} ORDER BY score DESC, context_index, sentence_index) AS items, any_value(trunc(context_budget * 1.4::double)::bigint) AS b FROM sb JOIN alloc USING (sample_id) GROUP BY sample_id),
sr AS (SELECT sample_id, list_reduce(list_transform(items, lambda x: {{'kept': [{{'c': x.c, 'i': x.i}}], 'total': x.n::bigint}}),
  lambda a, x: CASE WHEN a.total + x.total <= b THEN {{'kept': list_concat(a.kept, x.kept), 'total': a.total + x.total}} ELSE a END, {{'kept': []::STRUCT(c INT, i INT)[], 'total': 0::bigint}}) AS f FROM si),
fit AS (SELECT sample_id, k.c AS context_index, k.i AS sentence_index FROM (SELECT sample_id, unnest(f.kept) AS k FROM sr)),
best AS (SELECT sample_id, context_index, sentence_index FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, context_index ORDER BY score DESC, sentence_index) AS r FROM sb) WHERE r <= 1)"""


def _sentences(spark, sf_dir):
    rows = _contexts(spark, sf_dir).select("sample_id", "context_index", F.posexplode(T.synced_sentences(F.col("text"))).alias("sentence_index", "text"))
    rows = rows.withColumn("token_count", T.n_tokens(F.col("text"))).withColumn("score", F.round(F.length("text") / (1 + F.col("sentence_index")).cast("double"), 6))
    return prompt.sentence_bonus(rows, 1, 1)


@query(f"WITH {ROLES}, {BUDGET}, {SENTENCES} SELECT * FROM fit UNION SELECT * FROM best")
def sentence_select(spark, sf_dir):
    budgets = prompt.allocate(_samples(spark, sf_dir)).select("sample_id", (F.col("context_budget") * F.lit(1.4)).cast("long").alias("b"))
    scored = _sentences(spark, sf_dir).join(budgets, "sample_id")
    return prompt.select_sentences(scored, F.col("b"), keep_number=1)


PRUNE = f"""{LOSSES},
tb AS (SELECT *, pos // 200 AS w, CASE WHEN pos % 1024 <> 0 THEN loss END AS l FROM losses),
cut AS (SELECT sample_id, context_index, w, quantile_cont(l, 0.5) AS cut FROM tb GROUP BY ALL),
kept AS (SELECT tb.*, l IS NULL OR cut IS NULL OR l >= cut OR pos = 0 OR regexp_matches(tok, '\\p{{Nd}}') AS keep FROM tb JOIN cut USING (sample_id, context_index, w))"""


@query(f"""WITH {ROLES}, {PRUNE} SELECT sample_id, context_index, md5(coalesce(string_agg(tok, '' ORDER BY pos) FILTER (keep), '')) AS text_md5, count(*) AS n_before, count(*) FILTER (keep) AS n_after FROM kept GROUP BY ALL""")
def token_prune(spark, sf_dir):
    kept = prompt.prune_tokens(_losses(spark, sf_dir), 0.5, keys=("sample_id", "context_index"), force_digits=True)
    return prompt.join_tokens(kept, ("sample_id", "context_index")).select("sample_id", "context_index", F.md5("text").alias("text_md5"), "n_before", "n_after")


@query(f"""WITH {ROLES}, {PRUNE}, j AS (SELECT sample_id, context_index, coalesce(string_agg(tok, '' ORDER BY pos) FILTER (keep), '') AS text FROM kept GROUP BY ALL),
c AS (SELECT sample_id, list(text ORDER BY context_index) FILTER (trim(text) <> '') AS cs FROM j GROUP BY sample_id),
p AS (SELECT sample_id, array_to_string(list_concat(list_concat(CASE WHEN instruction <> '' THEN [instruction] ELSE [] END, coalesce(cs, [])), CASE WHEN question <> '' THEN [question] ELSE [] END), chr(10) || chr(10)) AS prompt,
  n_instruction + n_question + coalesce(list_sum(context_tokens), 0) AS before FROM sample LEFT JOIN c USING (sample_id))
SELECT sample_id, md5(prompt) AS prompt_md5, before::bigint AS n_before, {ntok('prompt')} AS n_after, round(CASE WHEN before = 0 THEN 0 ELSE 1 - {ntok('prompt')} / before END, 6) AS ratio FROM p""")
def prompt_pipeline(spark, sf_dir):
    """Token pruning of every context, assembled with instruction and question."""
    keys = ("sample_id", "context_index")
    texts = prompt.join_tokens(prompt.prune_tokens(_losses(spark, sf_dir), 0.5, keys=keys, force_digits=True), keys)
    lists = texts.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("context_index", "text"))), lambda x: x["text"]).alias("cs"))
    rows = prompt.allocate(_samples(spark, sf_dir)).join(lists, "sample_id", "left").withColumn("cs", F.coalesce("cs", F.array().cast("array<string>")))
    rows = rows.withColumn("prompt", prompt.assemble(F.col("cs"), F.col("question"), F.col("instruction"))).withColumn("n_after", T.n_tokens(F.col("prompt")))
    ratio = F.round(T.compression_ratio(F.col("total"), F.col("n_after")), 6)
    return rows.select("sample_id", F.md5("prompt").alias("prompt_md5"), F.col("total").alias("n_before"), "n_after", ratio.alias("ratio"))


@query()
def prompt_run(spark, sf_dir):
    """The whole prompt pipeline over all conversations: budgets, context ranking and choice, order, sentence filter, token pruning, assembly."""
    config = C.PromptPipeline(reorder="two_stage", use_sentence_filter=True, force_digits=True, add_instruction=True)
    run = pipelines.run_prompt(_samples(spark, sf_dir).select("sample_id", "instruction", "question"), _contexts(spark, sf_dir).drop("token_count"), config)
    return run.result.select("sample_id", F.md5("prompt").alias("prompt_md5"), "input_tokens", "output_tokens")


SIMULATED = rf"""{ASKED}, {CHUNKS},
iw AS (SELECT sample_id, chunk_index, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM chunks)),
ik AS (SELECT *, regexp_replace(lower(w), '^[.,!?;:()]+|[.,!?;:()]+$', '', 'g') AS k FROM iw),
ic AS (SELECT *, count(*) OVER (PARTITION BY sample_id, chunk_index) AS n, count(*) OVER (PARTITION BY sample_id, chunk_index, k) AS f FROM ik),
ir AS (SELECT *, rank() OVER (PARTITION BY sample_id, chunk_index ORDER BY round(ln(n / f) + 0.5 + CASE WHEN regexp_matches(w, '[0-9]') THEN 50 ELSE 0 END, 9) DESC) AS r FROM ic),
ij AS (SELECT sample_id, chunk_index, string_agg(w, ' ' ORDER BY pos) AS short FROM ir WHERE r <= greatest(1, trunc(n * 0.4::double)) GROUP BY ALL),
dn AS (SELECT sample_id, chunk_index, text, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS ws FROM chunks),
dd AS (SELECT sample_id, chunk_index, text, round(CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_distinct(ws)) / len(ws) + 0.1 * len(list_filter(ws, lambda x: regexp_matches(x, '[0-9]'))) END, 9) AS density FROM dn),
cs AS (SELECT sample_id, string_agg(coalesce(short, text), chr(10) || chr(10) ORDER BY density DESC, chunk_index) AS cut, string_agg(text, chr(10) || chr(10) ORDER BY density DESC, chunk_index) AS whole FROM dd LEFT JOIN ij USING (sample_id, chunk_index) GROUP BY sample_id),
sm AS (SELECT sample_id, concat_ws(chr(10) || chr(10), 'Answer briefly.', cut, nullif(query, '')) AS prompt, concat_ws(chr(10) || chr(10), 'Answer briefly.', whole, nullif(query, '')) AS before FROM asked LEFT JOIN cs USING (sample_id))"""


@query(f"WITH {SIMULATED} SELECT sample_id, md5(prompt) AS prompt_md5, {ntok('before')} AS input_tokens, {ntok('prompt')} AS output_tokens FROM sm")
def simulated_run(spark, sf_dir):
    """The prompt pipeline without a model over all documents, each with its question."""
    samples = _asked(spark, sf_dir).select("sample_id", F.lit("Answer briefly.").alias("instruction"), F.col("query").alias("question"))
    contexts = _paragraph_chunks(spark, sf_dir).select("sample_id", F.col("chunk_index").alias("context_index"), "text")
    return pipelines.run_simulated(samples, contexts).withColumn("prompt_md5", F.md5("prompt")).drop("prompt")


EVAL = f"""s AS (SELECT doc_id, documents.text AS text, b.text AS answer, keep, array_to_string({tok('documents.text')}[1:trunc(len({tok('documents.text')}) * keep)::int], '') AS context, doc_id % 50 = 7 AS failed
  FROM documents JOIN benchmark b ON b.item_id = doc_id % (SELECT max(item_id) + 1 FROM benchmark), (VALUES (0.3::double), (0.5::double), (0.7::double)) k(keep)),
m AS (SELECT keep, failed, {ntok('text')} AS i, {ntok('context')} AS o, {keywords('text')} AS ka, {keywords('context')} AS kb, contains({normalized('context')}, {normalized('answer')}) AS hit, answer FROM s)"""


@query(f"""WITH {EVAL} SELECT keep AS keep_ratio, count(*) FILTER (NOT failed) AS num_samples, count(*) FILTER (failed) AS num_errors, round(avg(i) FILTER (NOT failed), 6) AS avg_input_tokens, round(avg(o) FILTER (NOT failed), 6) AS avg_output_tokens,
round(avg(CASE WHEN i = 0 THEN 0 ELSE 1 - o / i END) FILTER (NOT failed), 6) AS avg_compression_ratio, round(avg(CASE WHEN len(ka) = 0 THEN 0 ELSE 100.0 * len(list_intersect(ka, kb)) / len(ka) END) FILTER (NOT failed), 6) AS avg_keyword_retention,
round(100.0 * avg(hit::int) FILTER (NOT failed), 6) AS answer_recall_pct, count(*) FILTER (NOT failed AND answer <> '') AS answerable FROM m GROUP BY keep""")
def eval_rollup(spark, sf_dir):
    """All documents at three keep ratios in one job; each ratio is a prefix of that share of the tokens."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("document"))
    rows = docs.join(_asked(spark, sf_dir), "sample_id").withColumnRenamed("query", "answer").withColumns({"tokens": T.tokens(F.col("document")), "keywords": T.keywords(F.col("document"))})
    rows = rows.withColumn("input_tokens", F.coalesce(F.size("tokens"), F.lit(0))).withColumn("keep_ratio", F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7))))
    n = (F.col("input_tokens") * F.col("keep_ratio")).cast("int")
    rows = rows.withColumn("context", F.array_join(F.slice("tokens", F.lit(1), n), "")).drop("tokens").withColumn("error", F.when(F.col("sample_id") % 50 == 7, "planted"))
    found = metrics.roll_up(metrics.sample_metrics(rows), "keep_ratio")
    return found.select(*[F.round(c, 6).alias(c) if c.startswith("avg_") or c.endswith("_pct") else c for c in found.columns])


@query()
def compare_run(spark, sf_dir):
    """Both pipelines over all documents at three keep ratios, rolled up; samples without a text are errors."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    n = items.agg((F.max("item_id") + 1).alias("n"))  # one row
    samples = _docs(spark, sf_dir).join(F.broadcast(n)).withColumn("item_id", F.pmod("sample_id", "n")).join(items, "item_id")
    samples = samples.select("sample_id", "text", "query", F.col("query").alias("answer"))
    found = pipelines.compare(samples, [0.3, 0.5, 0.7])
    return found.select(*[F.round(c, 6).alias(c) if c.startswith("avg_") or c.endswith("_pct") else c for c in found.columns])


PRED = "pred AS (SELECT doc_id, toxic::varchar AS label, CASE WHEN regexp_matches(lower(text), 'idiot|stupid|trash|scum|moron|loser') THEN '1' ELSE '0' END AS predicted FROM labels JOIN documents USING (doc_id))"


def _predictions(spark, sf_dir, column="toxic"):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", F.col(column).cast("string").alias("label"), F.when(F.lower("text").rlike("idiot|stupid|trash|scum|moron|loser"), "1").otherwise("0").alias("predicted"))


@query(f"WITH {PRED} SELECT label, predicted, count(*) AS n FROM pred GROUP BY ALL")
def confusion(spark, sf_dir):
    return metrics.confusion(_predictions(spark, sf_dir))


COUNTS = "c AS (SELECT count(*) FILTER (label = '{0}' AND predicted = '{0}') AS tp, count(*) FILTER (label <> '{0}' AND predicted = '{0}') AS fp, count(*) FILTER (label = '{0}' AND predicted <> '{0}') AS fn, count(*) FILTER (label <> '{0}' AND predicted <> '{0}') AS tn FROM pred)"
RATES = "coalesce(tp / nullif(tp + fp, 0), 0)::double AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::double AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::double AS f1"


@query(f"WITH {PRED}, {COUNTS.format('1')} SELECT '1' AS positive, *, {RATES}, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c")
def prf_binary(spark, sf_dir):
    return metrics.binary(_predictions(spark, sf_dir), "1")


LANGS = "pred AS (SELECT doc_id, lang AS label, CASE WHEN contains(text, 'ß') OR contains(text, ' und ') THEN 'de' WHEN contains(text, 'ñ') THEN 'es' WHEN contains(text, 'è') THEN 'fr' ELSE 'en' END AS predicted FROM documents)"
CLASSES = f"""{LANGS}, k AS (SELECT DISTINCT unnest([label, predicted]) AS class FROM pred),
pc AS (SELECT class, count(*) FILTER (label = class AND predicted = class) AS tp, count(*) FILTER (label <> class AND predicted = class) AS fp, count(*) FILTER (label = class AND predicted <> class) AS fn FROM pred, k GROUP BY class),
pr AS (SELECT *, tp + fn AS support, {RATES} FROM pc)"""


def _language(spark, sf_dir):
    t = F.col("text")
    guess = F.when(F.contains(t, F.lit("ß")) | F.contains(t, F.lit(" und ")), "de").when(F.contains(t, F.lit("ñ")), "es").when(F.contains(t, F.lit("è")), "fr").otherwise("en")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"), guess.alias("predicted"))


@query(f"WITH {CLASSES} SELECT * FROM pr")
def prf_per_class(spark, sf_dir):
    return metrics.per_class(_language(spark, sf_dir))


@query(f"WITH {CLASSES} SELECT avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, count(*) AS classes, (SELECT avg((label = predicted)::int) FROM pred) AS accuracy FROM pr")
def prf_macro(spark, sf_dir):
    return metrics.macro(_language(spark, sf_dir))


@query(f"""WITH {CLASSES}, h AS (SELECT avg(precision) AS p, avg(recall) AS r, avg(f1) AS f, (SELECT avg((label = predicted)::int) FROM pred) AS a FROM pr)
SELECT printf('Accuracy:  %.4f', a) || chr(10) || printf('Precision: %.4f', p) || chr(10) || printf('Recall:    %.4f', r) || chr(10) || printf('F1 Score:  %.4f', f)
  || (SELECT string_agg(chr(10) || '  ' || class || printf(': P=%.3f R=%.3f F1=%.3f', precision, recall, f1), '' ORDER BY class) FROM pr) AS report FROM h""")
def metrics_report(spark, sf_dir):
    found = _language(spark, sf_dir)
    return metrics.report(metrics.macro(found), metrics.per_class(found))


@query("SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang")
def label_histogram(spark, sf_dir):
    return metrics.histogram(_language(spark, sf_dir))


@query("""SELECT role AS kind, count(*) AS n, count(*) FILTER (role = 'user' AND turn = 0) AS opening FROM conversations GROUP BY role""")
def turn_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("role", "kind")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if((F.col("kind") == "user") & (F.col("turn") == 0)).alias("opening"))


@query("""SELECT doc_id, 0.5::double AS ratio, sha256('s1|0.5|' || doc_id || '|' || md5(text)) AS key, doc_id % 3 = 0 AS hit FROM documents""")
def cache_split(spark, sf_dir):
    """Which samples a result cache already holds, by content keys."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0.5).alias("ratio"), cache.content_key("s1", F.lit(0.5), F.col("doc_id"), F.md5("text")).alias("key"))
    held = docs.filter("doc_id % 3 = 0").select("key")
    hit, miss = cache.split(docs, held)
    return hit.withColumn("hit", F.lit(True)).unionByName(miss.withColumn("hit", F.lit(False)))


@query("""SELECT method, keep_ratio, n, (row_number() OVER (ORDER BY keep_ratio, CASE method WHEN 'context' THEN 0 ELSE 1 END) - 1)::int AS place FROM (
SELECT 'context' AS method, 0.3::double AS keep_ratio, count(*) AS n FROM documents UNION ALL SELECT 'prompt', 0.3, count(*) FROM conversations UNION ALL SELECT 'prompt', 0.5, count(*) FROM benchmark UNION ALL SELECT 'context', 0.5, count(*) FROM pages)""")
def run_merge(spark, sf_dir):
    one = lambda t, m, k: table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(m).alias("method"), F.lit(k).alias("keep_ratio"), "n")
    return cache.merge_runs([one("documents", "context", 0.3), one("conversations", "prompt", 0.3), one("benchmark", "prompt", 0.5), one("pages", "context", 0.5)], ["context", "prompt"])


@query("SELECT doc_id, sample FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) <= 100 AS sample FROM documents) WHERE sample")
def sample_split(spark, sf_dir):
    return adapters.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, seed=7).withColumn("sample", F.lit(True))


@query("""SELECT doc_id, i::int AS segment_index, CASE i WHEN 0 THEN replace(coalesce(text, ''), '<', '') WHEN 1 THEN doc_id::varchar ELSE 'x' END AS segment,
CASE i WHEN 0 THEN 0.4 WHEN 1 THEN 1.0 ELSE (doc_id % 9 + 1) / 10 END::double AS rate, i <> 1 AS compress FROM documents, range(3) r(i)""")
def structured_parse(spark, sf_dir):
    """Each document's whole text in the first of three tagged segments."""
    said = F.replace(F.coalesce("text", F.lit("")), F.lit("<"), F.lit(""))
    tagged = F.concat(F.lit("<llmlingua, rate=0.4>"), said, F.lit("</llmlingua> outside <llmlingua, compress=False>"), F.col("doc_id"), F.lit("</llmlingua><llmlingua, compress=True, rate=0."), F.col("doc_id") % 9 + 1, F.lit(">x</llmlingua>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.structured_segments(tagged, 0.5)).alias("segment_index", "s")).select("doc_id", "segment_index", "s.*")


@query("""SELECT conv_id, turn, 'role ' || role || ' [T] [T] says [P] ' || turn || '.' AS filled, 2 AS slots, 'false,false,true,true,false,false,false' AS mask FROM conversations""")
def trigger_template(spark, sf_dir):
    template = "role {role} [T] [T] says [P] {turn}."
    filled = T.trigger_fill(template, ["role", "turn"])
    mask = T.slot_mask(filled)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", filled.alias("filled"), F.size(F.filter(mask, lambda x: x)).alias("slots"), F.array_join(F.transform(mask, lambda x: x.cast("string")), ",").alias("mask"))


@query(f"""WITH l AS (SELECT item_id, list_transform({tok('text')}, lambda x: length(x)) AS n FROM benchmark), m AS (SELECT max(len(n)) AS w FROM l)
SELECT item_id, array_to_string(list_concat(n, list_resize([]::bigint[], w - len(n), 0)), ',') AS padded FROM l, m""")
def padding(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.transform(T.tokens(F.col("text")), lambda x: F.length(x)).alias("n"))
    width = rows.agg(F.max(F.size("n")).alias("w"))
    return rows.join(F.broadcast(width)).select("item_id", F.array_join(F.transform(T.padded(F.col("n"), F.col("w")), lambda x: x.cast("string")), ",").alias("padded"))  # one row


@query("""SELECT conv_id, string_agg(role || '. ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS document FROM conversations GROUP BY conv_id""")
def adapt_titled(spark, sf_dir):
    """Titled paragraphs flattened to one document each."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    titled = F.struct(F.transform("t", lambda x: x["role"]).alias("title"), F.transform("t", lambda x: F.array(x["text"])).alias("sentences"))
    return rows.select("conv_id", adapters.flatten_titled(titled).alias("document"))
