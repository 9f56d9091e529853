"""The corpus pipeline on a small folder, beside its stages done the plain way."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from gistmill.llm import bpe, toxicity
from gistmill.llm._text import ALNUM, Words
from gistmill.llm.queries import RANKS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    base = tmp_path_factory.mktemp("corpus")
    leak = " ".join(f"leak{i}" for i in range(15))
    line = "this very long line repeats in several of the documents"
    docs, labels = [], []
    for i in range(120):
        w = [f"v{rng.randint(0, 3000)}" for _ in range(rng.randint(12, 50))]
        if i % 6 == 1:
            w[3] = w[7] = "vilescum"
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 6 == 1)))
    docs += [(200, docs[0][1] + " tail"), (201, f"{leak} begins here and goes on with more words of its own 77"), (202, f"{line}\nonly one of mine, with words nobody else has written"), (203, f"some other text of considerable length, alone\n{line}"), (204, None), (205, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_pipeline(spark, folder):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    assert len(toxic & {i for i in range(120) if i % 6 == 1}) >= 18
    everything = {*range(120), *range(200, 206)}
    assert set(got) == everything - toxic - {200, 201}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()} | {203: "some other text of considerable length, alone"}
    coder = bpe.Coder(bpe.read_ranks(RANKS))
    for i, encoded in zip(sorted(got), coder.encode([texts[i] for i in sorted(got)])):
        assert got[i]["n_tokens"] == len(encoded) // 4


def plain_toxic(model: toxicity.Model, text: str) -> bool:
    """The score by the definition of maximal segments: the best stretch, then those left and right of it."""
    raw = text.lower().encode()
    scores = [float(x) for x in model.token_scores(Words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), ALNUM))]

    def best(low: int, high: int) -> list[float]:
        every = [(-sum(scores[a:b]), b - a, a, b) for a in range(low, high) for b in range(a + 1, high + 1)]
        if not every or min(every)[0] >= 0:
            return []
        least, _, a, b = min(every)
        return [*best(low, a), -least, *best(b, high)]

    excess = [model.lam * x - model.log_k - math.log(max(len(scores), 1)) for x in best(0, len(scores))]
    a, b, c = model.beta
    odds = a + b * max(-10, min(40, max(excess, default=-10))) + c * math.log1p(sum(x for x in excess if x > 0))
    return 1 / (1 + math.exp(-max(-30, min(30, odds)))) >= 0.5


def plain_groups(names: list, links) -> dict:
    up = {n: n for n in names}
    for a, b in links:
        low, high = min(up[a], up[b]), max(up[a], up[b])
        up = {n: low if r == high else r for n, r in up.items()}
    return up


def near(a: str, b: str) -> bool:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1] <= 2


def plain_lines(texts: dict) -> dict:
    places = [(i, k, line.strip(" \t\r")) for i in sorted(texts) for k, line in enumerate((texts[i] or "").split("\n"))]
    long = sorted({x for _, _, x in places if len(x) >= 20})
    same = plain_groups(long, ((a, b) for a in long for b in long if a < b and abs(len(a) - len(b)) <= 2 and near(a, b)))
    seen, gone = set(), set()
    for i, k, line in places:
        name = same.get(line, line)
        if line and name in seen:
            gone.add((i, k))
        seen.add(name)
    out = {}
    for i, text in texts.items():
        kept = text if text is None or not any(g[0] == i for g in gone) else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone)
        if kept == text or kept.strip():
            out[i] = kept
    return out


def plain_near(texts: dict) -> dict:
    sets = {}
    for i, text in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    linked = ((a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    first = plain_groups(list(sets), linked)
    return {i: t for i, t in texts.items() if first[i] == i}


def plain_clean(texts: dict, items: list[str]) -> dict:
    def words(text):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = {tuple(w[k : k + 10]) for w in map(words, items) if w for k in range(max(1, len(w) - 9))}
    return {i: t for i, t in texts.items() if not any(tuple(words(t)[k : k + len(x)]) == x for x in windows for k in range(len(words(t))))}


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage done plainly on a corpus where each has work; of the model only the fitted figures are taken."""
    rng = random.Random(21)
    vocabulary = [f"wort{i}é" if i % 9 == 0 else f"v{i}" for i in range(400)]
    lines = [" ".join(rng.choices(vocabulary, k=6)) for _ in range(12)]
    leaks = [" ".join(f"leak{j}x{i}" for i in range(14)) for j in range(3)] + ["Short Leak, three"]
    texts = {}
    for i in range(130):
        w = rng.choices(vocabulary, k=rng.randint(8, 30))
        if i % 7 == 1:
            w[2:2] = ["vilescum", "scumvile"]
        text = " ".join(w)
        if i % 5 == 2:
            line = rng.choice(lines)
            at = rng.randrange(len(line))
            text += "\n" + rng.choice([line, line[:at] + "#" + line[at + 1 :], f"  {line}\r", "Read more"])
        if i % 11 == 3:
            text += f"\nand {rng.choice(leaks).upper()} again {i}"
        if i % 8 == 5 and i > 8:
            text = (texts[i - 7] or "empty") + f" tail of a near copy {i}" * (i % 3 == 0)
        texts[i] = text
    texts |= {130: None, 131: "", 132: " \n ", 133: "z" * 3000, 134: "it's 're 'll'd  \t x\x85🙂"}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 1)) for i in range(130)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(leaks)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    steps = [texts, {i: t for i, t in texts.items() if not plain_toxic(model, t or "")}]
    steps += [plain_lines(steps[-1])]
    steps += [plain_near(steps[-1])]
    steps += [plain_clean(steps[-1], leaks)]
    assert all(a != b for a, b in zip(steps, steps[1:]))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = {}
    for i, text in steps[-1].items():
        ids = library.encode_ordinary(text or "")
        want[i] = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    empty = docs.filter(F.lit(False))
    assert corpus_pipeline.stage_ngram_join(spark, empty, folder).count() == 0
