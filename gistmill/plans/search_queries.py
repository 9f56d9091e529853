"""Queries of the search operators: trials, bandits, beams, Pareto fronts, token and label search, optimiser loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compression, recovery, search
from . import evolve
from ._base import ntok, query, table

#: Candidates are suppliers 1 to 24 by suppkey modulo, instances the line numbers, scores the mean discounts.
SCORES = "scores AS (SELECT (l_suppkey % 24)::bigint AS candidate, l_linenumber AS instance, round(avg(l_discount), 6) AS score FROM lineitem WHERE NOT (l_suppkey % 24 = 3 AND l_linenumber = 2) GROUP BY ALL)"


def _scores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 24).alias("candidate"), F.col("l_linenumber").alias("instance"), "l_discount")
    return rows.filter("NOT (candidate = 3 AND instance = 2)").groupBy("candidate", "instance").agg(F.round(F.avg("l_discount"), 6).alias("score"))


FRONT = f"""{SCORES}, full_ AS (SELECT candidate, instance, coalesce(score, 0) AS score FROM (SELECT DISTINCT candidate FROM scores) CROSS JOIN (SELECT DISTINCT instance FROM scores) LEFT JOIN scores USING (candidate, instance)),
beaten AS (SELECT b.candidate FROM full_ a JOIN full_ b ON a.instance = b.instance AND a.candidate <> b.candidate GROUP BY a.candidate, b.candidate HAVING bool_and(a.score >= b.score) AND bool_or(a.score > b.score)),
front AS (SELECT DISTINCT candidate FROM scores WHERE candidate NOT IN (SELECT candidate FROM beaten))"""


@query(f"WITH {FRONT} SELECT candidate FROM front")
def pareto_front(spark, sf_dir):
    return search.pareto_front(_scores(spark, sf_dir))


@query(f"WITH {SCORES} SELECT candidate, round(avg(score), 9) AS average FROM scores GROUP BY candidate ORDER BY avg(score) DESC, candidate LIMIT 5")
def linear_front(spark, sf_dir):
    return search.top_by_average(_scores(spark, sf_dir)).withColumn("average", F.round("average", 9))


@query(f"""WITH {SCORES}, p AS (SELECT a.candidate AS a, b.candidate AS b, count(*) FILTER (a.score > b.score + 0.001) AS a_wins, count(*) FILTER (b.score > a.score + 0.001) AS b_wins, count(*) AS common
FROM scores a JOIN scores b ON a.instance = b.instance AND a.candidate < b.candidate GROUP BY ALL)
SELECT *, round(CASE WHEN greatest(a_wins, b_wins) = 0 THEN 0 ELSE least(a_wins, b_wins) / greatest(a_wins, b_wins) * ((a_wins + b_wins) / common) END, 9) AS complementarity FROM p""")
def complementarity(spark, sf_dir):
    return search.complementarity(_scores(spark, sf_dir), 0.001).withColumn("complementarity", F.round("complementarity", 9))


@query(f"""WITH {FRONT}, kids AS (SELECT p AS candidate, count(*) AS children FROM (SELECT unnest([candidate % 5, candidate % 7]) AS p FROM (SELECT DISTINCT candidate FROM scores)) GROUP BY p),
w AS (SELECT candidate, coalesce(children, 0) AS children, 1.0 / (1 + coalesce(children, 0)) AS w FROM front LEFT JOIN kids USING (candidate)) SELECT candidate, children, round(w / sum(w) OVER (), 9) AS weight FROM w""")
def parent_weights(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    candidates = scores.select("candidate").distinct().select("candidate", F.array(F.col("candidate") % 5, F.col("candidate") % 7).alias("parent_ids"))
    return search.parent_weights(search.pareto_front(scores), candidates).withColumn("weight", F.round("weight", 9))


TRIALS = "stats AS (SELECT event_type AS prompt, count(value) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS stdev, max(value) AS best FROM events GROUP BY event_type)"


def _trials(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("prompt"), F.col("value").alias("score"))


@query(f"WITH {TRIALS} SELECT prompt, n, round(mean, 6) AS mean, round(stdev, 6) AS stdev, best FROM stats")
def trial_stats(spark, sf_dir):
    return search.trial_stats(_trials(spark, sf_dir)).withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


UCB = f"""{TRIALS}, arms AS (SELECT prompt, n, mean FROM stats UNION ALL VALUES ('untried', 0, NULL)),
u AS (SELECT *, CASE WHEN n = 0 THEN 'infinity'::double ELSE mean + 1.414 * sqrt(ln(greatest(1, sum(n) OVER ())) / n) END AS ucb, count(*) OVER () AS k FROM arms),
v AS (SELECT *, sum(ucb) FILTER (n > 0) OVER () AS s FROM u)"""


@query(f"WITH {UCB} SELECT prompt, CASE WHEN n = 0 THEN -1 ELSE round(ucb, 6) END AS ucb, (1 + floor((100 - k) * CASE WHEN n = 0 THEN 1 / k ELSE ucb / s END))::int AS allocation FROM v")
def ucb_alloc(spark, sf_dir):
    arms = search.trial_stats(_trials(spark, sf_dir)).select("prompt", "n", "mean")
    arms = arms.unionByName(spark.createDataFrame([("untried", 0, None)], "prompt string, n long, mean double"))
    found = search.ucb_allocation(arms, 100)
    return found.select("prompt", F.when(F.col("n") == 0, -1.0).otherwise(F.round("ucb", 6)).alias("ucb"), "allocation")


@query(f"WITH {TRIALS} SELECT prompt, n AS score, greatest(1, trunc(50 * n / sum(n) OVER ()))::int AS allocation FROM stats")
def proportional_alloc(spark, sf_dir):
    arms = search.trial_stats(_trials(spark, sf_dir)).select("prompt", F.col("n").alias("score"))
    return search.proportional_allocation(arms, 50)


@query(f"""WITH {SCORES}, m AS (SELECT candidate AS position, round(avg(score), 4) AS mean FROM scores GROUP BY candidate)
SELECT position, mean FROM (SELECT *, row_number() OVER (ORDER BY mean, position) AS r, count(*) OVER () AS n FROM m) WHERE r > n - 6""")
def beam_prune(spark, sf_dir):
    rows = _scores(spark, sf_dir).groupBy(F.col("candidate").alias("position")).agg(F.round(F.avg("score"), 4).alias("mean"))
    return search.prune_beam(rows, 6)


@query("""WITH g AS (SELECT list(m ORDER BY i) AS g FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label = 3) GROUP BY i))
SELECT vec_id AS token, round(-list_inner_product(embedding::double[], g), 6) AS gain FROM embeddings, g WHERE vec_id % 10 <> 0 ORDER BY -list_inner_product(embedding::double[], g) DESC, vec_id LIMIT 20""")
def hotflip_topk(spark, sf_dir):
    """The gradient is the mean vector of one label; every tenth token is excluded."""
    rows = table(spark, sf_dir, "embeddings")
    mean = rows.filter("label = 3").select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    gradient = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("gradient"))
    vocabulary = rows.select(F.col("vec_id").alias("token"), "embedding")
    return search.hotflip(vocabulary, gradient, vocabulary.filter("token % 10 = 0").select("token"), 20).withColumn("gain", F.round("gain", 6))


LOGP = "lp AS (SELECT vec_id, label, list_transform(embedding::double[], lambda x: x - ln(list_sum(list_transform(embedding::double[], lambda y: exp(y))))) AS lp FROM embeddings)"


@query(f"""WITH {LOGP}, m AS (SELECT label, token, avg(x) AS mean FROM (SELECT label, unnest(lp) AS x, generate_subscripts(lp, 1) - 1 AS token FROM lp) WHERE token NOT IN (0, 1, 2) GROUP BY ALL)
SELECT label, token::int AS token, round(mean, 6) AS mean, rank::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(mean, 9) DESC, token) AS rank FROM m) WHERE rank <= 5""")
def label_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("logits"))
    return search.label_tokens(rows, 5, [0, 1, 2]).withColumn("mean", F.round("mean", 6))


@query(f"WITH {LOGP} SELECT vec_id, round(-ln(exp(lp[label + 2]) + exp(lp[label + 12])), 6) AS loss FROM lp")
def label_loss(spark, sf_dir):
    ids = F.array(F.col("label") + 1, F.col("label") + 11, F.lit(0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(search.label_loss(F.col("embedding"), ids), 6).alias("loss"))


@query("""WITH l AS (SELECT vec_id, label, list_transform(embedding[1:10]::double[], lambda x: -x) AS losses FROM embeddings)
SELECT vec_id, len(list_filter(losses, lambda x: x <= losses[label + 1])) <= 1 AS correct, (list_position(losses, list_min(losses)) - 1)::int AS predicted FROM l""")
def rank_accuracy(spark, sf_dir):
    losses = F.transform(F.slice("embedding", 1, 10), lambda x: -x.cast("double"))
    named = F.transform(losses, lambda x, i: F.struct(i.alias("label"), x.alias("loss")))
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", search.correct_by_rank(losses, F.get(losses, F.col("label"))).alias("correct"), search.predicted_label(named).alias("predicted"))


@query("""WITH t AS (SELECT vec_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label < 4) SELECT (i - 1)::int AS i, round(sum(x) / 8, 6) AS g FROM t GROUP BY i""")
def gradient_sum(spark, sf_dir):
    """Gradients summed over a batch and divided by the accumulation steps."""
    rows = table(spark, sf_dir, "embeddings").filter("label < 4").select(F.posexplode("embedding").alias("i", "x"))
    return rows.groupBy("i").agg(F.round(F.sum(F.col("x").cast("double")) / 8, 6).alias("g"))


@query(f"""SELECT doc_id, round(sum((n - k) * 0.03 / 1000), 6) AS saved FROM (SELECT doc_id, {ntok('text')} AS n, ({ntok('text')} // 2) AS k FROM documents) GROUP BY doc_id""")
def projected_cost(spark, sf_dir):
    n = T.n_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round((n - F.floor(n / 2)) * 0.03 / 1000, 6).alias("saved"))


def _replies(spark, sf_dir):
    """Each document, its lines pruned to their best phrases, and a reply that quotes all of that in runs of 12 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("original"))
    lines = T.trimmed_non_empty(F.split(F.coalesce("original", F.lit("")), "\n"))
    rows = docs.withColumn("compressed", F.array_join(F.transform(lines, lambda x: compression.pruned(x)), " ")).withColumn("said", F.split("compressed", " "))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("said") - 1) / 12).cast("int")), lambda i: F.array_join(F.slice("said", i * 12 + 1, F.lit(12)), " "))
    return rows.withColumn("response", F.concat(F.lit("It says "), F.array_join(runs, " [and] "), F.lit(" twice"))).drop("said")


@query()
def response_recovery(spark, sf_dir):
    """Replies built from a document's short form, mapped back to its sentences."""
    return _replies(spark, sf_dir).select("doc_id", F.md5(recovery.recover("original", "compressed", "response")).alias("recovered_md5"))


@query()
def reflective_evolution(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.col("text").alias("input"), F.substring_index("text", " ", 3).alias("expected"))
    return evolve.reflective(spark, items, {"system_prompt": "Answer."}, iterations=4).history


@query()
def gradient_beam(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return evolve.beam(spark, rows.select(F.col("doc_id").alias("item_id"), "text", F.col("toxic").cast("string").alias("label")), "find idiot", iterations=2).history


@query()
def trigger_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return evolve.triggers(spark, rows, slots=2, k=5, iterations=3, target=None).history
