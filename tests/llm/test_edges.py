"""Repeated and null ids, long texts, hot values and bounds of the training-data operators."""

from __future__ import annotations

import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gistmill.llm import bpe, chat, decontaminate, ngram_join, pii, toxicity, urls, vptree, warc


def test_decontamination_of_rows_without_own_ids(spark):
    words = [f"w{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(words[:15])), (1, " ".join(words[:15])), (2, " ".join(words[10:30]))], "item_id long, text string")
    texts = [(None, "a clean row"), (None, " ".join(words[:12])), (7, " ".join(words)), (7, "clean as well"), (8, "x " * 200_000 + " ".join(words))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    results = []
    for limit in (1, 7, 10**6):
        report = sorted(((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.report(docs, bench, max_windows=limit).collect()))
        kept = [sorted((r["doc_id"] or 0, " ".join(r["text"].split())) for r in decontaminate.clean(docs, bench, mode, max_windows=limit).collect()) for mode in ("documents", "spans")]
        results.append((report, kept))
    assert results[0] == results[1] == results[2]
    assert results[0][0] == [(0, 3, 0, 0, False), (0, 12, 12, 1, True), (7, 3, 0, 0, False), (7, 30, 30, 2, True), (8, 200_030, 30, 2, True)]
    assert results[0][1][0] == [(0, "a clean row"), (7, "clean as well")] and results[0][1][1][3] == (7, "clean as well")


def _cards(text: str) -> set[str]:
    """Every stretch of whole groups with 13 to 19 digits that passes Luhn, by trying all."""
    import re

    found = set()
    for run in re.finditer(r"(?<![0-9A-Za-z])[0-9]+(?:[ -][0-9]+)*(?![0-9A-Za-z])", text):
        groups = list(re.finditer("[0-9]+", run[0]))
        for i in range(len(groups)):
            for j in range(i, len(groups)):
                said = run[0][groups[i].start() : groups[j].end()]
                digits = [int(c) for c in said if c.isdigit()]
                doubled = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
                if 13 <= len(digits) <= 19 and doubled % 10 == 0 and len(set(digits)) > 1:
                    found.add(said)
    return found


def test_cards_behind_digits():
    for text in ("order 12 4539 1488 0343 6467", "id 7 4539148803436467", "born 2024-01-01 4539 1488 0343 6467", "4539-1488-0343-6467 9 1"):
        found = {text[a:b] for a, b, kind, _ in pii.find(text, b"k") if kind == "card"}
        assert found and found <= _cards(text)
        changed = pii.replace(text, pii.find(text, b"k"))
        assert "4539" not in changed and pii.replace(changed, pii.find(changed, b"k", back=True)) == text
    rng = np.random.default_rng(1)
    for _ in range(300):
        text = "".join(rng.choice(list("0123456789 -"), size=40))
        found, every = [text[a:b] for a, b in pii.spans(text, "card")], _cards(text)
        assert set(found) <= every and bool(found) == bool(every)


def test_emails_in_long_runs():
    assert [x[2] for x in pii.find("._ab.c@host.example, a@b, a@b@c.de d@e.fg@h.ij", b"k")] == ["email"] * 3
    began = time.time()
    run = "Ab9+" * 250_000
    assert not pii.find(f"{run}@x {run}.{run}@host.example", b"k") and len(pii.find(f"{run}@x {run} {'a' * 64}@host.example", b"k")) == 1
    assert time.time() - began < 60


def test_union_of_repeated_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(8)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, f"{a} {b}"), (4, a), (5, "x"), (5, "x")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.cluster(docs).collect()}
    assert got == {1: (8, 1), 2: (4, 2), 3: (12, 3), 4: (4, 2), 5: (1, 5)}
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(docs).collect()) == [1, 1, 2, 3, 5, 5]


def test_a_hot_shingle_and_a_long_text(spark):
    hot = "all rights reserved by us"
    docs = [(i, f"{hot} own{i} words{i} of{i} text{i} here{i}") for i in range(1500)] + [(5000, f"{hot} " * 60_000), (5001, f"{hot} " * 60_001)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.cluster(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert len(got) == 1502 and got[5001] == got[5000] == 5000 and all(got[i] == i for i in range(1500))


def test_wide_buckets():
    values = np.array([0, 1 << 40, (1 << 64) - 1, 12345 << 48], dtype=np.uint64)
    for buckets in (32, 65_536, 12_500_000):
        found = ngram_join._bucket(values, buckets)
        assert found[0] == 0 and found[2] == buckets - 1 and (found.astype(np.int64) < buckets).all()


def test_packages_of_revisits_are_bounded(spark):
    page = "<html>" + "same " * 100 + "</html>"
    pages = spark.createDataFrame([(i, "http://a.example/", page if i % 2 else None) for i in range(3000)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_packages(pages, package_bytes=100_000)
    assert manifest.count() > 3
    got = warc.read_packages(manifest).collect()
    assert len(got) == 3000 and sum(r["record_type"] == "revisit" for r in got) == 1499


def test_factor_one_is_exact_at_large_norms(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 16)) * 2500
    vectors = np.concatenate([base, base[:300], base[:50] * (1 + 1e-13)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in vptree.search(rows, rows.filter("vec_id % 20 = 0"), k=20, factor=1.0, shard_rows=200).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert len(got) == 48
    for q, found in got.items():
        exact = sorted((-float(np.einsum("i,i->", vectors[q], v)), i) for i, v in enumerate(vectors) if i != q)[:20]
        assert [found[k + 1][1] for k in range(20)] == pytest.approx([-s for s, _ in exact], rel=1e-12)
        assert {found[k + 1][0] for k in range(15)} <= {i for s, i in exact} | {i for i, v in enumerate(vectors) if -exact[-1][0] <= float(vectors[q] @ v) * (1 + 1e-12)}


def test_recall_of_the_query_factor():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(16_384, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    tree = vptree.Tree(np.arange(len(vectors)), vectors)
    queries = np.arange(0, len(vectors), 160)
    q, found, _, _ = tree.search(queries, vectors[queries], 20, 4.0)
    scores = vectors[queries] @ vectors.T
    scores[np.arange(len(queries)), queries] = -2
    best = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(set(best[i]) & set(found[q == i])) / 20 for i in range(len(queries))]) >= 0.9


def test_a_text_of_many_tokens_decodes_in_pieces():
    coder = bpe.Coder(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    texts = ["", "ein zwei, " * 2_000_000, "kurz", "é" * 1000]
    encoded = coder.encode(texts)
    assert len(encoded[1]) // 4 > 4 * bpe.DECODE_TOKENS
    assert coder.decode(encoded) == [t.encode() for t in texts] and coder.decode([]) == [] and coder.decode([b""]) == [b""]


@pytest.mark.parametrize("kind", ["long", "short", "string", "date"])
def test_chats_in_any_order_and_of_any_id(spark, kind):
    turns = [(c, t, ("user", "assistant")[t % 2], f"said {c} {t}") for c in range(40) for t in range(7)] + [(None, 0, "assistant", "x")]
    own = F.date_add(F.lit("2024-01-01").cast("date"), F.col("conv_id").cast("int")) if kind == "date" else F.col("conv_id").cast(kind)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("conv_id", own)
    made = chat.expand(df)
    fresh = {tuple(r) for r in chat.read_back(made, ordered=True).collect()}
    mixed = {tuple(r) for r in chat.read_back(made.repartition(5).orderBy(F.rand(1))).collect()}
    assert fresh == mixed and len(fresh) == 41 and {r[1] for r in fresh} == {1, 7} and {r[6] for r in fresh} == {1, 3}


def test_urls_of_many_segments(spark):
    captures = spark.createDataFrame([(1, "http://a.b.c.example/" + "s/" * 200_000), (2, "http://" + "x." * 20_000 + "c.example/s/t/u")], "page_id long, url string").withColumn("day", F.lit("2024-02-01").cast("date"))
    entries = spark.createDataFrame([("l", "block", p, "add") for p in ("prefix:a.b.c.example/s/s", "domain:c.example", "domain:example")], "list string, verdict string, pattern string, action string").withColumn("day", F.lit("2024-01-01").cast("date"))
    got = {r["page_id"]: (r["n_active"], r["verdict"]) for r in urls.judge(captures, entries).collect()}
    assert got == {1: (3, "block"), 2: (2, "block")}


def test_toxicity_beside_columns_of_its_names(spark):
    docs = spark.createDataFrame([(i, "vile words" if i % 4 == 0 else "kind words") for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    clashing = docs.select("*", F.lit(1).alias("_text"), F.lit(2).alias("_Lowered"), F.lit("s").alias("score"))
    model = toxicity.fit(clashing, labels)
    kept = toxicity.keep_clean(clashing, model)
    assert kept.columns == clashing.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(200) if i % 4}
    assert {tuple(r) for r in kept.select("_text", "_Lowered", "score").collect()} == {(1, 2, "s")}
    assert {(r["doc_id"] % 4 == 0, r["predicted"], r["_text"]) for r in toxicity.score(clashing, model).collect()} == {(True, 1, 1), (False, 0, 1)}
