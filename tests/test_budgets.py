"""Budgets with forced contexts, floors of allocations and the next prompt to try."""

from pyspark.sql import functions as F

from gistmill.functions import text as T
from gistmill.operators import prompt, search


def test_forced_contexts_and_apart_questions(spark):
    rows = spark.createDataFrame([(10, 20, [30, 60, 10])], "n_instruction long, n_question long, context_tokens array<long>")
    got = prompt.allocate(rows, rate=0.5, context_budget="+0", forced=[2]).first()
    assert (got["target"], got["context_budget"], got["per_context"]) == (65, 35, [10, 21, 10])
    assert prompt.allocate(rows, rate=0.5, context_budget="+0", concatenated=False).first()["context_budget"] == 55


def test_floor_of_allocations(spark):
    rows = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "prompt string, score double")
    assert [r["allocation"] for r in search.proportional_allocation(rows, 10).collect()] == [5, 5]


def test_next_prompt(spark):
    stats = spark.createDataFrame([("a", 4, 0.5), ("b", 0, 0.0), ("c", 0, 0.0)], "prompt string, n long, mean double")
    assert search.select_next(stats).first()["prompt"] == "b"
    assert search.select_next(stats.filter("n > 0 OR prompt = 'z'")).first()["prompt"] == "a"


def test_special_characters_keep_brackets(spark):
    row = spark.range(1).select(F.regexp_replace(F.lit("a[1] {b} (c) #d %"), f"(?U){T.SPECIAL}", "").alias("x")).first()
    assert row["x"] == "a[1] {b} (c) d "
