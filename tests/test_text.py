import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gistmill.config import Chunking, ContextPipeline, Packing, overridden
from gistmill.functions import text as T
from gistmill.functions.unicode import nfkc
from gistmill.operators import chunking, cleanup, compression, packing, prompt, recovery, retrieval


def rows(df):
    return [tuple(r) for r in df.collect()]


TEXTS = ["", "   ", "One. Two words! Three?  Four\nfive", "a,b;c: d-e", "x" * 30 + " " + "y" * 5, "Straße 12 costs 3,50 €.\n\nNext para."]


def test_tokens_are_lossless(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    assert [r[0] for r in rows(df.select(F.array_join(T.tokens(F.col("text")), "")))] == TEXTS


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab .,\n!é1", max_size=40), min_size=1, max_size=20))
def test_sentence_sync_and_tokens_lossless(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = rows(df.select("text", F.array_join(T.tokens(F.col("text")), ""), F.array_join(T.synced_sentences(F.col("text")), "")))
    assert all(a == b == c for a, b, c in found)


def test_units_match_plain_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    split = {"token": r"\s+", "phrase": r"[,:;\-]+|\n+", "sentence": r"(?<=[.!?])\s+|\n+"}
    for name, pattern in split.items():
        got = [r[0] for r in rows(df.select(T.units(F.col("text"), name)))]
        assert got == [[u.strip() for u in re.split(pattern, t) if u.strip()] for t in TEXTS]
    with pytest.raises(ValueError):
        T.units(F.col("text"), "page")


def test_clean_rules(spark):
    df = spark.createDataFrame([("See https://a.b/c?d=1 or www.x.y  now",), ("mail me@x.org !",), ("ﬁne print",)], "text string")
    got = [r[0] for r in rows(df.select(T.clean(F.col("text"))))]
    assert got[0] == "See or now" and got[1] == "mail !"
    assert rows(df.select(T.clean(nfkc("text"))))[2][0] == "fine print"


def test_answers(spark):
    df = spark.createDataFrame([("The cat", "a cat", "the cat sat"), ("", "", "x"), ("yes", "no", "x"), ("dog", "cat", "a hotdog"), ("!?", "", "x")], "p string, g string, c string")
    got = rows(df.select(T.exact_match(F.col("p"), F.col("g")), T.bag_f1(T.answer_words(F.col("p")), T.answer_words(F.col("g"))), T.answer_retained(F.col("p"), F.col("c"))))
    assert got == [(True, 1.0, True), (True, 1.0, False), (False, 0.0, True), (False, 0.0, True), (True, 1.0, False)]


def test_structured_segments(spark):
    said = "<llmlingua, rate=0.4>a b</llmlingua> dropped <llmlingua, compress=False>c</llmlingua><llmlingua, compress=True, rate=0.7>d</llmlingua><llmlingua>e</llmlingua>"
    got = spark.createDataFrame([(said,)], "t string").select(F.explode(T.structured_segments(F.col("t"), 0.5)).alias("s")).select("s.*")
    assert rows(got) == [("a b", 0.4, True), ("c", 1.0, False), ("d", 0.7, True), ("e", 0.5, True)]


def test_chunkers(spark):
    df = spark.createDataFrame([(1, "a b c. d e. f"), (2, ""), (3, None), (4, "one two three four five six seven")], "sample_id int, text string")
    merged = rows(chunking.chunk(df, Chunking("sentence", 6)).orderBy("sample_id", "chunk_index"))
    assert [r[:4] for r in merged if r[0] == 1] == [(1, 0, "a b c.", 4), (1, 1, "d e. f", 4)]
    assert [r[2] for r in merged if r[0] == 4] == ["one two three four five six seven"]
    fixed = rows(chunking.chunk(df, Chunking("fixed_tokens", 3)).filter("sample_id = 4"))
    assert [r[2] for r in fixed] == ["one two three", " four five six", " seven"]
    sliding = rows(chunking.chunk(df, Chunking("sliding_window", 4, 2)).filter("sample_id = 4"))
    assert [(r[3], r[4]) for r in sliding] == [(4, 0), (4, 2), (3, 4)]
    with pytest.raises(ValueError):
        Chunking("sliding_window", 4, 4)
    with pytest.raises(ValueError):
        Chunking("page")


def test_cleanup_keeps_first_and_renumbers(spark):
    df = spark.createDataFrame([(1, 0, "Same text here", 3, 0), (1, 1, "same TEXT here ", 3, 0), (1, 2, "tiny", 1, 0), (1, 3, "Another one here", 3, 0), (2, 0, "Same text here", 3, 0)], "sample_id int, chunk_index int, text string, token_count int, start int")
    got = rows(cleanup.clean_chunks(df).select("sample_id", "chunk_index", "text").orderBy("sample_id", "chunk_index"))
    assert got == [(1, 0, "Same text here"), (1, 1, "Another one here"), (2, 0, "Same text here")]


def test_bm25_prefers_the_rare_term(spark):
    chunks = spark.createDataFrame([(1, 0, "common words only"), (1, 1, "common rare word"), (1, 2, "common filler"), (1, 3, "nothing")], "sample_id int, chunk_index int, text string")
    asked = spark.createDataFrame([(1, "rare common absent")], "sample_id int, query string")
    got = rows(retrieval.top_n(retrieval.bm25(chunks, asked), 2).select("chunk_index", "rank"))
    assert got[0] == (1, 0) and len(got) == 2


def test_prune_units_and_budget(spark):
    ranked = spark.createDataFrame([(1, 0, 0, "a a, b c, a a d", 7), (1, 1, 1, "...", 3), (1, 2, 2, "x, y", 3)], "sample_id int, chunk_index int, rank int, text string, token_count int")
    got = rows(compression.prune_units(ranked, 0.7).select("chunk_index", "text").orderBy("chunk_index"))
    assert got == [(0, "b c"), (1, "..."), (2, "x")]
    held = rows(compression.prefix_budget(ranked, 8, "rank").select("chunk_index", "used").orderBy("chunk_index"))
    assert held == [(0, 7), (1, 1)]
    assert rows(compression.prefix_budget(ranked, 0, "rank")) == []


@pytest.mark.parametrize("strategy", ["round_robin", "edges_first", "decreasing"])
def test_placement_is_a_permutation(spark, strategy):
    for n in (1, 2, 3, 10, 37):
        got = [r[0] for r in rows(spark.range(n).select(packing.place(F.col("id"), F.lit(n), Packing(strategy))))]
        assert sorted(got) == list(range(n)) and got[0] == 0
    with pytest.raises(ValueError):
        Packing("random")


def test_pack_truncates_the_last(spark):
    ranked = spark.createDataFrame([(1, i, i, f"w{i} x y z", 4, 1.0) for i in range(4)], "sample_id int, chunk_index int, rank int, text string, token_count int, score double")
    got = rows(packing.position_map(ranked, Packing("decreasing", 10)).select("position", "tokens_used", "truncated").orderBy("position"))
    assert got == [(0, 4, False), (1, 4, False), (2, 2, True)]
    assert rows(packing.pack(ranked, Packing("decreasing", 10)).select("tokens_packed")) == [(10,)]


def test_budgets(spark):
    df = spark.createDataFrame([(10, 5, [20, 30]), (0, 0, [])], "n_instruction int, n_question int, context_tokens array<int>")
    got = rows(prompt.allocate(df).select("total", "target", "context_budget", "per_context"))
    assert got == [(65, 32, 117, [46, 70]), (0, 0, 100, [])]
    assert rows(df.select(prompt.budget_expression(F.lit(10), "*1.5"), prompt.budget_expression(F.lit(10), "-20"), prompt.budget_expression(F.lit(10), "x"))) == [(15, 0, 10)] * 2


def test_context_selection_breaks_and_sentences_continue(spark):
    df = spark.createDataFrame([(1, 0, 3.0, 5), (1, 1, 9.0, 4), (1, 2, 1.0, 1)], "sample_id int, context_index int, score double, token_count int")
    got = rows(prompt.select_contexts(df, F.lit(8), F.lit(10)).select("context_index"))
    assert got == [(1,)]
    forced = rows(prompt.select_contexts(df, F.lit(8), F.lit(10), F.col("context_index") == 0).select("context_index"))
    assert forced == [(1,), (0,)]
    sents = df.withColumnRenamed("context_index", "sentence_index").withColumn("context_index", F.lit(0))
    assert sorted(rows(prompt.select_sentences(sents, F.lit(6)).select("sentence_index"))) == [(1,), (2,)]
    assert sorted(rows(prompt.select_sentences(sents, F.lit(0), keep_number=1).select("sentence_index"))) == [(1,)]


@pytest.mark.parametrize("rate,kept", [(1.0, 10), (0.5, 5), (0.1, 2)])
def test_token_pruning(spark, rate, kept):
    df = spark.createDataFrame([(1, i, f" t{i}", float(i)) for i in range(10)], "sample_id int, pos int, tok string, loss double")
    got = rows(prompt.join_tokens(prompt.prune_tokens(df, rate)).select("n_after", "text"))
    assert got[0][0] == kept + (0 if rate == 1.0 else rate == 0.5) and got[0][1].startswith(" t0")
    flat = df.withColumn("loss", F.lit(1.0))
    assert rows(prompt.join_tokens(prompt.prune_tokens(flat, rate)).select("n_after")) == [(10,)]


def test_reorder(spark):
    df = spark.createDataFrame([(1, r, c) for r, c in enumerate([4, 2, 3, 1])], "sample_id int, rank int, context_index int")
    assert [r[0] for r in rows(prompt.reorder(df, "original").orderBy("position").select("context_index"))] == [1, 2, 3, 4]
    assert [r[0] for r in rows(prompt.reorder(df, "two_stage").orderBy("position").select("context_index"))] == [4, 3, 1, 2]
    assert [r[0] for r in rows(prompt.reorder(df, "sort").orderBy("position").select("context_index"))] == [4, 2, 3, 1]


def test_recovery():
    original = "The profit was high. Sam earned 95 dollars in profit."
    assert recovery.recover_text(original, "Sam earned dollars profit", "He said Sam earned dollars") == "He said Sam earned 95 dollars in profit"
    assert recovery.recover_text(original, "", "nothing known") == "nothing known"


def test_overrides():
    assert overridden(ContextPipeline(), {"packing": {"max_tokens": 7}}).packing.max_tokens == 7
    with pytest.raises(ValueError):
        overridden(ContextPipeline(), {"packing": {"nope": 1}})
