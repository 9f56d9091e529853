import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gistmill import config as C
from gistmill.functions import text as T
from gistmill.operators import compression, metrics, prompt
from gistmill.plans import pipelines, providers, registry, search_queries
from gistmill.sources import cache
from gistmill.streaming.incremental import score_stream

TEXT = "\n\n".join(f"Paragraph {i} talks about topic{i} today, with some filler words, and a number {i * 7}." for i in range(8))


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(1, TEXT, "what about topic3 ?", "topic3"), (2, "One short paragraph only.", "short", "none"), (3, "", "x", "")], "sample_id int, text string, query string, answer string")


def test_context_run(spark, samples):
    run = pipelines.run_context(samples, C.overridden(C.ContextPipeline(), {"chunking": {"method": "paragraph"}, "retrieval": {"top_n": 3}, "compression": {"reduce_ratio": 0.5}}))
    got = {r["sample_id"]: r for r in run.result.collect()}
    assert 3 in [r["chunk_index"] for r in run.positions.filter("sample_id = 1").collect()] and 0 < got[1]["ratio"] < 1 and got[1]["n_packed"] == 3
    assert got[2]["n_packed"] == 1 and got[3]["context"] == "" and got[3]["ratio"] == 0
    assert run.positions.filter("sample_id = 1").count() == 3 and run.chunks.filter("sample_id = 1").count() == 8


def test_prompt_run(spark, samples):
    contexts = samples.select("sample_id", F.posexplode(F.split("text", "\n\n")).alias("context_index", "text"))
    asked = samples.select("sample_id", F.lit("Be brief.").alias("instruction"), F.col("query").alias("question"))
    for filtered in (False, True):
        got = {r["sample_id"]: r for r in pipelines.run_prompt(asked, contexts, C.PromptPipeline(rate=0.5, context_budget="+0", use_sentence_filter=filtered)).result.collect()}
        assert got[1]["output_tokens"] < got[1]["input_tokens"] and got[1]["prompt"].endswith("what about topic3 ?") and got[3]["prompt"] == "x"


def test_structured(spark):
    df = spark.createDataFrame([(1, "<llmlingua, compress=False>keep this all</llmlingua><llmlingua, rate=0.3> drop some of these some of these words here here here</llmlingua>")], "sample_id int, prompt string")
    got = pipelines.compress_structured(df).first()
    assert got["prompt"].startswith("keep this all") and got["n_after"] < got["n_before"]


def test_structured_parse_reads_whole_texts(spark, tmp_path):
    text = "a line of the text\nand < another one, beyond the first forty characters " * 200
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["segment_index"]): r["segment"] for r in registry.queries()["structured_parse"](spark, str(tmp_path)).collect()}
    assert len(got) == 6 and got[1, 0] == text.replace("<", "") and got[2, 0] == "" and got[1, 1] == "1" and got[1, 2] == "x"


def plain_recovery(original, compressed, response):
    """recovery.recover_text the plain way: every run of words, longest first, every sentence."""
    said, out = response.split(" "), []
    while said:
        size = next((n for n in range(len(said), 0, -1) if all(" ".join(said[:k]) in compressed for k in range(1, n + 1))), 0)
        span, said = " ".join(said[: max(size, 1)]), said[max(size, 1) :]
        words = set(span.lower().split())
        if size and span not in original and words:
            ranked = sorted(((-len(words & set(x.lower().split())), i, x.strip()) for i, x in enumerate(re.split(r"[.!?\n]+", original)) if x.strip()))
            span = ranked[0][2] if ranked and -2 * ranked[0][0] >= len(words) else span
        out.append(span)
    return " ".join(out)


def test_recovery_meets_the_whole_original(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: "\n".join(", ".join(" ".join(f"w{rng.randint(0, 90)}" for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 8))) + ". And more." for _ in range(n))
    rows = [(i, text(rng.randint(1, 20))) for i in range(30)] + [(30, None), (31, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    replies = search_queries._replies(spark, str(tmp_path)).collect()
    got = {r["doc_id"]: r["recovered_md5"] for r in search_queries.response_recovery(spark, str(tmp_path)).collect()}
    plain = {r["doc_id"]: plain_recovery(r["original"] or "", r["compressed"], r["response"]) for r in replies}
    assert got == {k: hashlib.md5(v.encode()).hexdigest() for k, v in plain.items()} and len(got) == 32
    assert sum(plain[r["doc_id"]] != r["response"] for r in replies) > 20


def test_runs_over_the_tables(spark, tmp_path):
    kept = "Of the first paragraph this sentence stays"
    docs = [(0, f"{kept} me@x.org"), (1, "Visit https://a.b/c today for all of it"), (2, "short"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "first paragraph"), (1, "today")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    turns = [(1, 0, "system", "Be brief."), (1, 1, "user", "One fact. Another fact 77 of it."), (1, 2, "assistant", "A reply with some words. And more words."), (1, 3, "user", "why ?"), (2, 0, "user", "alone")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {q: registry.queries()[q](spark, str(tmp_path)).collect() for q in ("context_run", "prompt_run", "compare_run")}
    said = {r["sample_id"]: r["context_md5"] for r in found["context_run"]}
    assert said[0] == hashlib.md5(kept.encode()).hexdigest() and said[1] == hashlib.md5(b"Visit today for all of it").hexdigest()
    assert said[2] == said[3] == hashlib.md5(b"").hexdigest() and len(said) == 4
    prompts = {r["sample_id"]: r for r in found["prompt_run"]}
    assert len(prompts) == 2 and prompts[2]["prompt_md5"] == hashlib.md5(b"alone").hexdigest() and 0 < prompts[1]["output_tokens"] <= prompts[1]["input_tokens"]
    rolled = {(r["method"], r["keep_ratio"]): (r["num_samples"], r["num_errors"]) for r in found["compare_run"]}
    assert rolled == {(m, k): (3, 1) for m in ("context", "prompt") for k in (0.3, 0.5, 0.7)}


def test_compare(spark, samples):
    got = pipelines.compare(samples.filter("sample_id < 3"), [0.3, 0.7], C.overridden(C.ContextPipeline(), {"chunking": {"method": "paragraph"}}), C.PromptPipeline(context_budget="+0"))
    by = {(r["method"], r["keep_ratio"]): r for r in got.collect()}
    assert len(by) == 4 and by["context", 0.3]["avg_compression_ratio"] > by["context", 0.7]["avg_compression_ratio"] and by["context", 0.7]["num_samples"] == 2


def test_compare_shares_its_work(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["river", "stone", "the", "a", "Mill", "grain", "42", "of", "harvest", "co-op"]) for _ in range(n))
    text = lambda: "\n\n".join(", ".join(words(rng.randint(1, 9)) for _ in range(rng.randint(1, 9))) + "." for _ in range(rng.randint(1, 9)))
    rows = [(i, text(), words(2), words(1)) for i in range(25)] + [(25, "one part, alone and short", "part", "alone"), (26, None, "x", "x"), (27, "", "x", "x"), (28, " \n\n\u3000", "x", "")]
    samples = spark.createDataFrame(rows, "sample_id long, text string, query string, answer string")
    ratios = [0.3, 0.5, 0.7]
    found = pipelines.compare(samples, ratios, prompt_config=C.PromptPipeline(context_budget="+9"))
    parts = samples.select("sample_id", F.posexplode(T.trimmed_non_empty(F.split("text", "\n\n"))).alias("context_index", "text"))
    asked = samples.select("sample_id", F.lit("").alias("instruction"), F.col("query").alias("question"))
    for k in ratios:
        one = pipelines.run_context(samples, C.overridden(C.ContextPipeline(), {"compression": {"reduce_ratio": 1.0 - k}})).result.select("sample_id", "context")
        two = pipelines.run_prompt(asked, parts, C.PromptPipeline(context_budget="+9", rate=k)).result.select("sample_id", F.col("prompt").alias("context"))
        for method, own in (("context", one), ("prompt", two)):
            each = samples.withColumnRenamed("text", "document").join(own, "sample_id").withColumn("error", F.when(F.col("document").isNull(), "no text"))
            want = metrics.roll_up(metrics.sample_metrics(each)).first()
            got = found.filter((F.col("method") == method) & (F.col("keep_ratio") == k)).first()
            assert [got[c] for c in want.asDict()] == pytest.approx(list(want)), (method, k)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # of the clean-up: once, not for each ratio, nor again for its filter


def test_white_space_is_trimmed_as_the_pattern_does(spark):
    rows = spark.range(1, 0xD800).select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    text = F.concat("c", F.lit("x"), "c", F.lit("y"), "c")
    odd = rows.filter(T.trimmed_non_empty(F.array(text))[0] != F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    assert odd.count() == 0


def test_providers(spark, tmp_path):
    calls = []

    def complete(messages, **_):
        calls.append(messages)
        if len(calls) == 1:
            raise OSError("once")
        return "said"

    ask = providers.cached_completion(complete, str(tmp_path), wait=0)
    assert ask([{"role": "user", "content": "x"}]) == "said" and ask([{"role": "user", "content": "x"}]) == "said" and len(calls) == 2
    assert providers.cached_completion(lambda **_: 1 / 0, str(tmp_path / "b"), wait=0)([]) == ""
    rows = providers.with_errors(spark.createDataFrame([("1",), ("x",)], "v string"), "v", lambda v: str(int(v) + 1)).collect()
    assert rows[0]["output"] == "2" and rows[1]["output"] is None and rows[1]["error"].startswith("ValueError")
    df = spark.createDataFrame([('```\nImproved prompt: "Do it"\n```', "It is Spam, I think", "a\n\nb\n\nc")], "r string, l string, d string")
    got = df.select(providers.clean_reply(F.col("r")), providers.label_in_reply(F.col("l"), ["ham", "spam"]), providers.diagnosis(F.col("d"))).first()
    assert got[1] == "spam" and got[2] == "a\n\nb" and "Do it" in got[0]
    with pytest.raises(ValueError):
        providers.provider("none")
    assert providers.provider("rule").complete("Rewrite this") == providers.provider("rule").complete("Rewrite this")


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda ids: spark.createDataFrame([(str(i), f"text {i}") for i in ids], "key string, text string")
    make(range(3)).write.parquet(source)
    for more in (None, [2, 3]):
        if more:
            make(more).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, text string").parquet(source)
        score_stream(stream, lambda df: df.withColumn("n", T.n_tokens(F.col("text"))), out, str(tmp_path / "check")).awaitTermination()
    assert sorted(r["key"] for r in spark.read.parquet(out).collect()) == ["0", "1", "2", "3"]


def test_runs(spark, tmp_path):
    one = spark.createDataFrame([("prompt", 0.5, 1)], "method string, keep_ratio double, n int")
    two = spark.createDataFrame([("context", 0.5, 2), ("prompt", 0.3, 3)], "method string, keep_ratio double, n int")
    got = sorted((r["place"], r["n"]) for r in cache.merge_runs([one, two], ["context", "prompt"]).collect())
    assert got == [(0, 3), (1, 2), (2, 1)]
    base = cache.write_run(one, two, str(tmp_path), "r1")
    assert spark.read.json(f"{base}/per_sample").count() == 2


def test_context_ranking_meets_the_question(spark):
    contexts = spark.createDataFrame([(1, 0, "red apples", 2), (1, 1, "green pears", 2), (1, 2, "", 0), (2, 0, "alone here", 2)], "sample_id int, context_index int, text string, token_count int")
    questions = spark.createDataFrame([(1, "which pears"), (2, None)], "sample_id int, question string")
    scores = lambda *how, of=contexts: {(r["sample_id"], r["context_index"]): r["score"] for r in prompt.rank_contexts(of, questions, *how).collect()}
    by_terms = scores("bm25")
    assert len(by_terms) == 4 and by_terms[1, 1] > by_terms[1, 0] == by_terms[1, 2] == by_terms[2, 0] == 0.0
    alone, after = scores("longllmlingua"), scores("longllmlingua", "after")
    assert set(alone) == set(after) and alone[1, 0] != after[1, 0]
    # A unigram model doesn't see the order; an empty text would leave a space at one end.
    said = contexts.filter("text <> ''")
    assert scores("longllmlingua", "before", of=said) == pytest.approx(scores("longllmlingua", "after", of=said))
    assert scores("embedding") == scores("llmlingua")


def test_context_run_by_vectors(spark):
    samples = spark.createDataFrame([(1, "First about rivers.\n\nThen about stones here.", "stones", [0.0, 1.0])], "sample_id int, text string, query string, query_vector array<double>")
    embed = lambda chunks: chunks.withColumn("vector", F.when(F.contains("text", F.lit("rivers")), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    for method in ("embedding", "hybrid"):
        config = C.ContextPipeline(chunking=C.Chunking("paragraph"), retrieval=C.Retrieval(method, top_n=1))
        assert "stones" in pipelines.run_context(samples, config, embed).result.first()["context"]


def test_informative_words(spark):
    rows = spark.createDataFrame([(1, 0, "the cat, the dog the 7"), (1, 1, " "), (2, 0, "one")], "sample_id int, context_index int, text string")
    got = {(r["sample_id"], r["context_index"]): r["text"] for r in compression.informative_words(rows, 0.4).collect()}
    # Two of six words: the number first, then the rare ones, which tie.
    assert got == {(1, 0): "cat, dog 7", (1, 1): " ", (2, 0): "one"}
