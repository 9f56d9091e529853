"""Optimiser loops: the driver decides, each evaluation is one job over (candidate, item) rows.

Models are callables; the defaults are deterministic rules, so runs repeat.  State that grows only with the number of
iterations (candidates, beams, history) lives on the driver; items and scores are tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics, search
from ..operators.retrieval import dot


@dataclass
class Outcome:
    best: object
    score: float
    history: DataFrame


# -- reflective evolution ----------------------------------------------------------------------------------------------


def rule_execute(item: Column, prompt: Column) -> Column:
    """The offline model: as many words of the input as the prompt has lines."""
    return F.array_join(F.slice(F.split(item, " "), F.lit(1), F.size(F.split(prompt, "\n"))), " ")


def rule_reflect(prompt: str, failures: list[dict]) -> str:
    """The offline reflection: one more instruction, named by how many items failed."""
    return f"{prompt}\nBe exact ({len(failures)} items failed)."


def evaluate(spark: SparkSession, items: DataFrame, candidates: dict[int, str], execute: Callable = rule_execute) -> DataFrame:
    """(candidate, instance, output, score) of each candidate on each item: one job for all of them."""
    prompts = F.broadcast(spark.createDataFrame(sorted(candidates.items()), "candidate int, prompt string"))
    rows = items.crossJoin(prompts).withColumn("output", execute(F.col("input"), F.col("prompt")))  # a few candidates
    return rows.select("candidate", F.col("item_id").alias("instance"), "input", "output", T.answer_score(F.col("output"), F.col("expected")).alias("score"))


def reflective(spark: SparkSession, items: DataFrame, seed: dict[str, str], iterations: int = 15, max_calls: int = 10_000, minibatch: int = 5, perfect: float = 1.0, execute: Callable = rule_execute, reflect: Callable = rule_reflect, random_seed: int = 42, merge: Callable | None = None, max_merges: int = 5) -> Outcome:
    """Keep a pool of prompts; draw a parent from the Pareto front, reflect on its failures in a minibatch, accept a child that does better there, merge complementary parents.

    A candidate is a text for each component of the seed; reflection changes them in turn, and the model is given all of them.
    After a child is accepted, a merge is due: of the front's pairs the most complementary one is merged component by component
    and taken if its average reaches the better parent's, at most ``max_merges`` attempts in all.
    A run ends after its iterations or metric calls.  The best average must exceed 0 strictly, so ties keep the earlier one.
    """
    merge, names, due, tried = merge or merge_texts, list(seed), 0, 0
    said = lambda texts: "\n".join(texts.values())
    pool: dict[int, dict[str, str]] = {0: dict(seed)}
    parents: dict[int, list[int]] = {0: []}
    n_items = items.count()
    scores = evaluate(spark, items, {0: said(pool[0])}, execute).select("candidate", "instance", "score").cache()
    averages = {0: scores.agg(F.avg("score")).first()[0] or 0.0}
    calls, history = n_items, []
    for turn in range(iterations):
        if calls >= max_calls:
            break
        tree = spark.createDataFrame([(c, p) for c, p in parents.items()], "candidate int, parent_ids array<int>")
        front = search.pareto_front(scores).cache()
        if due and tried < max_merges and front.count() > 1:
            due, tried = due - 1, tried + 1
            among = search.complementarity(scores.join(front, "candidate", "left_semi"))
            pair = among.orderBy(F.col("complementarity").desc(), "a", "b").first()
            a, b = pair["a"], pair["b"]
            merged = {k: pool[a][k] if pool[a][k] == pool[b][k] else merge(pool[a][k], pool[b][k]) for k in names}
            new, better = max(pool) + 1, max(averages[a], averages[b])
            own = evaluate(spark, items, {new: said(merged)}, execute).select("candidate", "instance", "score").cache()
            average = own.agg(F.avg("score")).first()[0] or 0.0
            calls += n_items
            history.append((turn, int(a), float(better), float(average), average >= better, calls, True))
            if average >= better:
                pool[new], parents[new], averages[new] = merged, [a, b], average
                scores = scores.unionByName(own).cache()
                continue
        parent = search.draw(search.parent_weights(front, tree), random_seed + turn).first()["candidate"]
        batch = items.orderBy(F.md5(F.concat_ws("|", F.lit(random_seed + turn), F.col("item_id"))), "item_id").limit(minibatch)
        before = evaluate(spark, batch, {parent: said(pool[parent])}, execute).collect()  # a minibatch
        calls += len(before)
        mean = sum(r["score"] for r in before) / max(len(before), 1)
        if before and all(r["score"] >= perfect for r in before):
            continue
        component = names[turn % len(names)]
        child = pool[parent] | {component: reflect(pool[parent][component], [r.asDict() for r in before if r["score"] < perfect])}
        new = max(pool) + 1
        after = [r["score"] for r in evaluate(spark, batch, {new: said(child)}, execute).select("score").collect()]
        calls += len(after)
        gained = sum(after) / max(len(after), 1)
        accepted = gained > mean + 1e-6
        if accepted:
            pool[new], parents[new] = child, [parent]
            own = evaluate(spark, items, {new: said(child)}, execute).select("candidate", "instance", "score")
            scores = scores.unionByName(own).cache()
            averages[new] = own.agg(F.avg("score")).first()[0]
            calls += n_items
            due += tried < max_merges
        history.append((turn, int(parent), float(mean), float(gained), accepted, calls, False))
    best = max(averages, key=lambda c: (averages[c], -c))
    table = spark.createDataFrame(history, "iteration int, selected_idx int, subsample_score_before double, subsample_score_after double, accepted boolean, total_evals int, merged boolean")
    return Outcome(pool[best], averages[best], table)


def merge_texts(a: str, b: str, limit: int = 5) -> str:
    """The distinct lines of two prompts, at most ``limit``."""
    return "\n".join(list(dict.fromkeys([*a.split("\n"), *b.split("\n")]))[:limit])


# -- textual gradients and beams ---------------------------------------------------------------------------------------


def rule_classify(prompt: Column, text: Column) -> Column:
    """The offline classifier: 1 if the text holds a word that the prompt names."""
    return F.when(F.size(F.array_intersect(T.words(prompt), T.words(text))) > 0, "1").otherwise("0")


def rule_edit(prompt: str, errors: list[dict], variants: int) -> list[str]:
    """The offline edits: add the words that missed items have in common, most frequent first."""
    seen: dict[str, int] = {}
    for e in errors:
        if e["label"] == "1":
            for w in set(e["text"].lower().split()):
                seen[w] = seen.get(w, 0) + 1
    best = sorted(seen, key=lambda w: (-seen[w], w))[:variants]
    return [f"{prompt} {w}" for w in best]


def temperatures(base: float, spread: float, n: int) -> list[float]:
    """n temperatures around the base, held to 0..1.5."""
    return [max(0.0, min(1.5, base - spread + (2 * spread * i / (n - 1) if n > 1 else spread))) for i in range(n)]


def beam(spark: SparkSession, items: DataFrame, seed: str, width: int = 3, iterations: int = 5, variants: int = 3, patience: int = 2, threshold: float = 0.01, metric: str = "f1", classify: Callable = rule_classify, edit: Callable = rule_edit) -> Outcome:
    """Expand each prompt of the beam by edits that answer its errors, score all variants in one job, keep the best."""
    if metric not in ("f1", "accuracy", "precision", "recall"):
        metric = "f1"

    def score(prompts: list[str]) -> dict[str, float]:
        rows = F.broadcast(spark.createDataFrame([(p,) for p in prompts], "prompt string"))
        cells = items.crossJoin(rows).select("prompt", "label", classify(F.col("prompt"), F.col("text")).alias("predicted"))  # a beam of prompts
        found = metrics.confusion(cells, "prompt").collect()  # as many rows as prompts and pairs of labels
        out = {}
        for p in prompts:
            n = {(r["label"], r["predicted"]): r["n"] for r in found if r["prompt"] == p}
            tp, fp, fn = n.get(("1", "1"), 0), n.get(("0", "1"), 0), n.get(("1", "0"), 0)
            right = tp + n.get(("0", "0"), 0)
            precision, recall = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
            out[p] = {"precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0, "accuracy": right / sum(n.values()) if n else 0.0}[metric]
        return out

    kept, history, bests = score([seed]), [], []
    for turn in range(iterations):
        fresh: list[str] = []
        for p in kept:
            wrong = items.withColumn("predicted", classify(F.lit(p), F.col("text"))).filter("predicted <> label")
            errors = [r.asDict() for r in wrong.orderBy("item_id").limit(5).collect()]
            fresh += [v for v in edit(p, errors, variants) if v not in kept and v not in fresh]
        kept |= score(fresh) if fresh else {}
        order = list(kept)
        kept = {p: kept[p] for p in sorted(sorted(kept, key=lambda p: (-kept[p], order.index(p)))[:width], key=order.index)}
        bests.append(max(kept.values()))
        history.append((turn, len(kept), float(bests[-1])))
        if len(bests) >= patience and max(bests[-patience:]) - min(bests[-patience:]) < threshold:
            break
    best = max(kept, key=kept.get)
    return Outcome(best, kept[best], spark.createDataFrame(history, "iteration int, beam int, best double"))


# -- trigger tokens ----------------------------------------------------------------------------------------------------


def triggers(spark: SparkSession, vocabulary: DataFrame, slots: int = 3, k: int = 10, iterations: int = 50, patience: int = 5, target: int | None = 1) -> Outcome:
    """Trigger tokens for a linear scorer: the gradient picks k candidates for a slot, one job scores them, a better one is taken.

    The scorer is softmax over the labels' mean vectors of a context's vector plus those of the triggers; its gradient is closed
    form and taken anew each turn.  Contexts are all rows of the vocabulary, in one batch; the loss is minus the log probability
    of ``target``, or without one of each row's own label.  The metric is minus the mean loss.
    """
    rows = vocabulary.select(F.col("vec_id").alias("token"), "embedding", "label")
    means = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    centres = {r["label"]: r["v"] for r in means.collect()}  # a vector for each label
    labels = sorted(centres)
    width = len(centres[labels[0]])
    own = F.array_position(F.array(*map(F.lit, labels)), F.col("label") if target is None else F.lit(target).cast(rows.schema["label"].dataType)).cast("int") - 1
    contexts = rows.select(own.alias("own"), F.array(*[dot(F.col("embedding"), F.array(*map(F.lit, centres[c]))) for c in labels]).alias("logits")).filter("own >= 0")

    def shift(vectors: list[list[float]]) -> Column:
        """What triggers add to the logits of any context."""
        total = [sum(float(v[i]) for v in vectors) for i in range(width)]
        return F.array(*[F.lit(sum(x * y for x, y in zip(total, centres[c]))) for c in labels])

    def log_p(vectors: list[list[float]]) -> Column:
        return search.log_softmax(F.zip_with("logits", shift(vectors), lambda a, b: a + b))

    def vectors_of(tokens: list[int]) -> dict[int, list[float]]:
        return {r["token"]: r["embedding"] for r in rows.filter(F.col("token").isin(tokens)).select("token", "embedding").collect()}

    def losses(sets: list[list[list[float]]]) -> list[float]:
        """The mean loss of each set of triggers over the same contexts, in one job."""
        found = contexts.agg(*[F.avg(-F.get(log_p(s), F.col("own"))).alias(f"l{i}") for i, s in enumerate(sets)]).first()
        return [float(x or 0.0) for x in found]

    chosen: list[int] = [r["token"] for r in rows.orderBy("token").limit(slots).collect()]
    held = vectors_of(chosen)
    best, idle, history = -losses([[held[t] for t in chosen]])[0], 0, []
    for turn in range(iterations):
        slot = turn % slots
        now = log_p([held[t] for t in chosen])
        share = contexts.select("own", F.transform(now, lambda x: F.exp(x)).alias("p")).agg(*[F.avg(F.get("p", F.lit(c)) - F.when(F.col("own") == c, 1.0).otherwise(0.0)) for c in range(len(labels))]).first()
        slope = [sum(float(w or 0.0) * centres[c][i] for w, c in zip(share, labels)) for i in range(width)]
        gradient = spark.createDataFrame([(slope,)], "gradient array<double>")
        used = rows.filter(F.col("token").isin(chosen)).select("token")
        candidates = [r["token"] for r in search.hotflip(rows.select("token", "embedding"), gradient, used, k).collect()]
        held |= vectors_of(candidates)
        tried = [[*chosen[:slot], t, *chosen[slot + 1 :]] for t in [chosen[slot], *candidates]]
        scored = losses([[held[t] for t in tokens] for tokens in tried])
        least = min(range(len(tried)), key=lambda i: (scored[i], i))
        idle = 0 if scored[least] < scored[0] else idle + 1
        if scored[least] < scored[0]:
            chosen, best = tried[least], -scored[least]
        history.append((turn, slot, int(chosen[slot]), round(float(best), 9)))
        if idle >= patience:
            break
    return Outcome(chosen, best, spark.createDataFrame(history, "iteration int, slot int, token long, metric double"))
