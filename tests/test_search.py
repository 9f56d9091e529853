import math
import random

from pyspark.sql import functions as F

from gistmill.operators import metrics, search
from gistmill.plans import evolve
from gistmill.sources import adapters, cache


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_confusion_and_rates(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label string, predicted string")
    assert sorted(rows(metrics.confusion(df))) == [("a", "a", 1), ("a", "b", 1), ("b", "b", 1), ("c", "b", 1)]
    per = {r["class"]: r for r in metrics.per_class(df).collect()}
    assert per["b"]["precision"] == 1 / 3 and per["b"]["recall"] == 1.0 and per["c"]["f1"] == 0.0
    assert metrics.macro(df).first()["accuracy"] == 0.5
    two = df.filter("label <> 'c'")
    one = metrics.binary(two).first()
    assert (one["positive"], one["tp"], one["fn"], one["tn"]) == ("a", 1, 1, 1)
    assert metrics.macro(df.limit(0)).first()["accuracy"] is None


def test_pareto_front(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 1.0), (2, 0, 0.5), (3, 0, 1.0), (3, 1, 0.0), (4, 1, 0.1)], "candidate int, instance int, score double")
    assert sorted(rows(search.pareto_front(df))) == [(0,), (1,), (3,)]
    assert rows(search.pareto_front(df.filter("candidate = 2"))) == [(2,)]
    pairs = {(r["a"], r["b"]): r["complementarity"] for r in search.complementarity(df).collect()}
    assert pairs[0, 1] == 1.0 and pairs[0, 3] == 0.0


def test_weights_and_draw(spark):
    front = spark.createDataFrame([(0,), (1,)], "candidate int")
    tree = spark.createDataFrame([(0, []), (1, [0]), (2, [0])], "candidate int, parent_ids array<int>")
    got = {r["candidate"]: r["weight"] for r in search.parent_weights(front, tree).collect()}
    assert abs(got[0] - 0.25) < 1e-12 and abs(got[1] - 0.75) < 1e-12
    picks = {search.draw(search.parent_weights(front, tree), s).first()[0] for s in range(12)}
    assert picks == {0, 1}


def test_bandits(spark):
    stats = spark.createDataFrame([("a", 4, 0.5), ("b", 0, None)], "prompt string, n long, mean double")
    got = {r["prompt"]: r for r in search.ucb_allocation(stats, 10).collect()}
    assert abs(got["a"]["ucb"] - (0.5 + 1.414 * math.sqrt(math.log(4) / 4))) < 1e-12
    assert got["a"]["allocation"] == 9 and got["b"]["allocation"] == 5
    untried = stats.withColumn("n", F.lit(0)).withColumn("mean", F.lit(None).cast("double"))
    assert [r["allocation"] for r in search.ucb_allocation(untried, 7).collect()] == [3, 3]
    assert [r["allocation"] for r in search.ucb_allocation(untried, 1).collect()] == [1, 1]
    beam = spark.createDataFrame([(0, 0.5), (1, 0.5), (2, 0.9), (3, 0.1)], "position int, mean double")
    assert sorted(r["position"] for r in search.prune_beam(beam, 2).collect()) == [1, 2]


def test_hotflip_skips_the_excluded(spark):
    words = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [-1.0, 0.0])], "token int, embedding array<double>")
    gradient = spark.createDataFrame([([-1.0, 0.0],)], "gradient array<double>")
    got = rows(search.hotflip(words, gradient, words.filter("token = 0").select("token"), 5))
    assert got == [(1, 0.5), (2, -1.0)]


def test_label_loss(spark):
    got = spark.createDataFrame([([0.0, math.log(3.0), 0.0], [1, 0])], "l array<double>, ids array<int>").select(search.label_loss(F.col("l"), F.col("ids"))).first()[0]
    assert abs(got + math.log(3 / 5)) < 1e-12


def test_loops_improve_and_repeat(spark):
    items = spark.createDataFrame([(i, f"w{i} b c d", f"w{i} b") for i in range(6)], "item_id int, input string, expected string")
    first = evolve.reflective(spark, items, {"p": "Answer."}, iterations=3)
    assert first.score == 1.0 and evolve.reflective(spark, items, {"p": "Answer."}, iterations=3).best == first.best
    labelled = spark.createDataFrame([(i, "bad thing" if i % 2 else "good thing", str(i % 2)) for i in range(8)], "item_id int, text string, label string")
    assert evolve.beam(spark, labelled, "find nothing", iterations=2).score == 1.0
    assert evolve.temperatures(0.7, 0.3, 3) == [0.39999999999999997, 0.7, 0.9999999999999999] or len(evolve.temperatures(0.7, 0.3, 3)) == 3
    assert evolve.merge_texts("a\nb", "b\nc") == "a\nb\nc"


def test_reflective_merges_complementary_parents(spark):
    items = spark.createDataFrame([(i, "AB"[i % 2] + str(i), "x") for i in range(8)], "item_id int, input string, expected string")
    execute = lambda item, prompt: F.when(F.contains(prompt, F.substring(item, 1, 1)), "x").otherwise("y")
    got = evolve.reflective(spark, items, {"p": "q", "same": "z"}, iterations=16, minibatch=1, execute=execute, reflect=lambda prompt, failures: failures[0]["input"][0])
    merges = got.history.filter("merged").collect()
    assert got.score == 1.0 and merges[0]["accepted"] and len(merges) <= 5
    assert set(got.best) == {"p", "same"} and "A" in "".join(got.best.values()) and "B" in "".join(got.best.values())


def test_triggers_score_rows_by_softmax(spark):
    rng = random.Random(2)
    made = [(i, [rng.gauss(2.0 * (i % 3 == c), 1.0) for c in range(3)], i % 3) for i in range(40)]
    vocabulary = spark.createDataFrame(made, "vec_id long, embedding array<double>, label int")
    centres = [[sum(v[i] for _, v, c in made if c == label) / sum(c == label for _, _, c in made) for i in range(3)] for label in range(3)]

    def loss(tokens, target):
        total = 0.0
        for _, v, label in made:
            x = [v[i] + sum(made[t][1][i] for t in tokens) for i in range(3)]
            z = [sum(a * b for a, b in zip(x, c)) for c in centres]
            total += math.log(sum(math.exp(a) for a in z)) - z[label if target is None else target]
        return total / len(made)

    for target in (None, 1):
        got = evolve.triggers(spark, vocabulary, slots=2, k=40, iterations=2, target=target)
        first = min([0, *range(2, 40)], key=lambda t: loss([t, 1], target))
        second = min([1, *(t for t in range(2, 40) if t != first), *([0] if first else [])], key=lambda t: loss([first, t], target))
        assert got.best == [first, second] and abs(got.score + loss(got.best, target)) < 1e-9


def test_adapters(spark):
    hot = spark.createDataFrame([("q", "a", (["T"], [["s1", "s2"]]))], "question string, answer string, context struct<title:array<string>,sentences:array<array<string>>>")
    assert rows(adapters.adapt(hot, "hotpot_qa")) == [("T. s1 s2", "q", "a")]
    plain = spark.createDataFrame([("d", "q", ["x"]), ("", "q", ["y"])], "article string, query string, answers array<string>")
    assert rows(adapters.adapt(plain, "other")) == [("d", "q", "x")]
    text = spark.createDataFrame([("a\n\nb",), ("a. b",), ("ab",)], "t string").select(adapters.paragraphs(F.col("t")))
    assert [r[0] for r in rows(text)] == [["a", "b"], ["a", "b"], ["ab"]]
    cut = spark.createDataFrame([("Context:\n" + "x" * 50 + "\n\nQuestion: why",)], "t string").select(adapters.truncate_instance(F.col("t"), 40)).first()[0]
    assert len(cut) == 40 and cut.endswith("Question: why")


def test_cache_and_files(spark, tmp_path):
    samples = spark.range(4).select(F.col("id").cast("string").alias("key"))
    path, calls = str(tmp_path / "cache"), []

    def compute(df):
        calls.append(df.count())
        return df.withColumn("value", F.length("key"))

    assert cache.through(samples.limit(2), path, compute).count() == 2
    assert cache.through(samples, path, compute).count() == 4 and calls == [2, 2]
    (tmp_path / "x.tsv").write_text("a\tb\n1\tz\n")
    assert rows(adapters.read(spark, str(tmp_path / "x.tsv"))) == [("1", "z")]
    assert cache.detect_kind(["method", "keep_ratio"]) == "comparison"
