"""Search over prompt candidates: Pareto front, complementarity, parent weights, bandit budgets, beams, token search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let


def filled_scores(scores: DataFrame) -> DataFrame:
    """(candidate, instance, score) for every candidate and instance that occur, a missing score as 0.

    The candidates' scores travel as one map each, so nothing is crossed but candidates with the list of instances, which a
    front needs anyway.
    """
    instances = scores.groupBy().agg(F.sort_array(F.collect_set("instance")).alias("all"))
    maps = scores.groupBy("candidate").agg(F.map_from_entries(F.collect_list(F.struct("instance", "score"))).alias("m"))
    return maps.crossJoin(F.broadcast(instances)).select("candidate", F.explode(F.transform("all", lambda i: F.struct(i.alias("instance"), F.coalesce(F.try_element_at("m", i), F.lit(0.0)).alias("score")))).alias("x")).select("candidate", "x.*")  # one row of instances


def pareto_front(scores: DataFrame) -> DataFrame:
    """Candidates that no other one dominates (at least as good everywhere, better somewhere).

    A theta self-join on the instance with its aggregates pre-combined: candidates squared, which is what dominance compares.
    """
    full = filled_scores(scores)
    a, b = full.alias("a"), full.alias("b")
    pairs = a.join(b, (F.col("a.instance") == F.col("b.instance")) & (F.col("a.candidate") != F.col("b.candidate")))
    wins = pairs.groupBy(F.col("a.candidate").alias("winner"), F.col("b.candidate").alias("loser")).agg(
        F.bool_and(F.col("a.score") >= F.col("b.score")).alias("everywhere"), F.bool_or(F.col("a.score") > F.col("b.score")).alias("somewhere")
    )
    beaten = wins.filter("everywhere AND somewhere").select(F.col("loser").alias("candidate"))
    return full.select("candidate").distinct().join(beaten, "candidate", "left_anti")


def top_by_average(scores: DataFrame, k: int = 5) -> DataFrame:
    """The linear front: the best averages, ties to the smaller candidate."""
    return scores.groupBy("candidate").agg(F.avg("score").alias("average")).orderBy(F.col("average").desc(), "candidate").limit(k)


def complementarity(scores: DataFrame, margin: float = 0.1) -> DataFrame:
    """For pairs a < b that share instances: wins of each by more than the margin, and min/max times their share."""
    a, b = scores.alias("a"), scores.alias("b")
    pairs = a.join(b, (F.col("a.instance") == F.col("b.instance")) & (F.col("a.candidate") < F.col("b.candidate")))
    out = pairs.groupBy(F.col("a.candidate").alias("a"), F.col("b.candidate").alias("b")).agg(
        F.count_if(F.col("a.score") > F.col("b.score") + margin).alias("a_wins"), F.count_if(F.col("b.score") > F.col("a.score") + margin).alias("b_wins"), F.count("*").alias("common")
    )
    low, high = F.least("a_wins", "b_wins"), F.greatest("a_wins", "b_wins")
    return out.withColumn("complementarity", F.when(high == 0, F.lit(0.0)).otherwise((low / high) * ((F.col("a_wins") + F.col("b_wins")) / F.col("common"))))


def parent_weights(front: DataFrame, candidates: DataFrame) -> DataFrame:
    """1 / (1 + children) over the front, made to sum to 1; candidates have ``parent_ids``."""
    children = candidates.select(F.explode("parent_ids").alias("p")).groupBy("p").agg(F.count("*").alias("children"))
    out = front.join(children, F.col("candidate") == F.col("p"), "left").select("candidate", F.coalesce("children", F.lit(0)).alias("children"))
    weight = 1.0 / (1 + F.col("children"))
    return out.withColumn("weight", weight / F.sum(weight).over(W.partitionBy()))  # a front, a handful of rows


def draw(weights: DataFrame, seed: int) -> DataFrame:
    """One candidate by its weight, for a seed: the first whose running weight passes a hashed uniform."""
    u = F.pmod(F.xxhash64(F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    order = W.orderBy("candidate").rowsBetween(W.unboundedPreceding, 0)
    return weights.withColumn("_cum", F.sum("weight").over(order)).filter(F.col("_cum") > u).orderBy("candidate").limit(1).select("candidate")


# -- bandits -----------------------------------------------------------------------------------------------------------


def trial_stats(trials: DataFrame, key: str = "prompt") -> DataFrame:
    """n, mean, stdev (of a sample, 0 below two trials) and max for each prompt."""
    return trials.groupBy(key).agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("stdev"), F.max("score").alias("best"))


def ucb(mean: Column, n: Column, total: Column, c: float = 1.414) -> Column:
    """mean + c sqrt(ln total / n), infinite without trials."""
    return F.when(n == 0, F.lit(float("inf"))).otherwise(mean + F.lit(c) * F.sqrt(F.log(F.greatest(total, F.lit(1)).cast("double")) / n))


def ucb_allocation(stats: DataFrame, budget: int, minimum: int = 1, c: float = 1.414) -> DataFrame:
    """The minimum for each, then whole parts of the rest by share of the finite scores; an infinite score counts as one part in k."""
    every = W.partitionBy()  # a beam, a handful of rows
    k, total = F.count("*").over(every), F.greatest(F.sum("n").over(every), F.lit(1))
    scored = stats.withColumn("_k", k).withColumn("ucb", ucb(F.col("mean"), F.col("n"), total, c))
    finite = F.col("ucb") < float("inf")
    scored = scored.withColumn("_sum", F.coalesce(F.sum(F.when(finite, F.col("ucb"))).over(every), F.lit(0.0))).withColumn("_all_inf", ~F.bool_or(finite).over(every))
    rest = F.lit(budget) - minimum * F.col("_k")
    share = F.when(F.col("_all_inf"), F.floor(rest / F.col("_k"))).when(F.col("_sum") > 0, F.floor(rest * F.when(finite, F.col("ucb") / F.col("_sum")).otherwise(1.0 / F.col("_k")))).otherwise(0)
    return scored.withColumn("allocation", (minimum + F.when(rest > 0, share).otherwise(0)).cast("int")).drop("_k", "_sum", "_all_inf")


def proportional_allocation(rows: DataFrame, total: int) -> DataFrame:
    """max(1, int(total * score / sum)) for each row; scores count as 0.01 at least."""
    score = F.greatest(F.col("score"), F.lit(0.01))
    return rows.withColumn("allocation", F.greatest(F.lit(1), (F.lit(total) * score / F.sum(score).over(W.partitionBy())).cast("int")))


def select_next(stats: DataFrame, c: float = 1.414, order: str = "prompt") -> DataFrame:
    """The row to try next: the highest upper bound, of equal ones the first in order."""
    total = F.greatest(F.sum("n").over(W.partitionBy()), F.lit(1))  # a beam, a handful of rows
    return stats.withColumn("ucb", ucb(F.col("mean"), F.col("n"), total, c)).orderBy(F.col("ucb").desc(), order).limit(1)


def prune_beam(rows: DataFrame, width: int) -> DataFrame:
    """The ``width`` best means in their original order; of equal ones the earlier go first."""
    order = W.orderBy("mean", "position")
    n = F.count("*").over(W.partitionBy())
    return rows.withColumn("_r", F.row_number().over(order)).withColumn("_n", n).filter(F.col("_r") > F.col("_n") - width).drop("_r", "_n")


# -- tokens ------------------------------------------------------------------------------------------------------------


def hotflip(vocabulary: DataFrame, gradient: DataFrame, excluded: DataFrame, k: int) -> DataFrame:
    """The k tokens that lower the loss most to first order, -(embedding . gradient), without the excluded ones.  ``gradient`` is one row."""
    from .retrieval import dot

    allowed = vocabulary.join(excluded, "token", "left_anti")
    return allowed.crossJoin(F.broadcast(gradient)).select("token", (-dot(F.col("embedding"), F.col("gradient"))).alias("gain")).orderBy(F.col("gain").desc(), "token").limit(k)


def log_sum_exp(values: Column) -> Column:
    return let(F.array_max(values), lambda top: top + F.log(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))))


def log_softmax(logits: Column) -> Column:
    return let(log_sum_exp(logits), lambda norm: F.transform(logits, lambda x: x - norm))


def label_tokens(rows: DataFrame, k: int, special: list[int]) -> DataFrame:
    """For each label the k tokens with the largest mean log-probability: rows (label, rank, token, mean)."""
    logp = rows.select("label", F.posexplode(log_softmax(F.transform("logits", lambda x: x.cast("double")))).alias("token", "lp"))
    means = logp.filter(~F.col("token").isin(special)).groupBy("label", "token").agg(F.avg("lp").alias("mean"))
    order = W.partitionBy("label").orderBy(F.round("mean", 9).desc(), "token")
    return means.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def label_loss(logits: Column, ids: Column) -> Column:
    """Minus the log of the labels' summed probability; id 0 is padding."""
    own = lambda lp: F.transform(F.filter(ids, lambda i: i != 0), lambda i: F.get(lp, i))
    return let(log_softmax(F.transform(logits, lambda x: x.cast("double"))), lambda lp: let(own(lp), lambda v: -log_sum_exp(v)))


def predicted_label(losses: Column) -> Column:
    """The label of least loss in an array of (label, loss), ties to the first."""
    return F.array_min(F.transform(losses, lambda x: F.struct(x["loss"].alias("loss"), x["label"].alias("label"))))["label"]


def correct_by_rank(losses: Column, gold: Column) -> Column:
    """Whether at most one loss is as small as the gold one."""
    return F.size(F.filter(losses, lambda x: x <= gold)) <= 1
