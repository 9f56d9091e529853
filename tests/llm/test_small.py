"""Operators on small tables, beside brute force, with nulls, empty and repeated rows."""

import hashlib
import io
import random
import struct
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistmill.llm import chat, decontaminate, line_dedup, ngram_join, pii, toxicity, urls, vptree, warc
from gistmill.llm._graph import components
from gistmill.llm._text import ALNUM, SPACED, Words


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_words_match_regular_expressions():
    import re

    texts = ["Ab c\tÉa  x", "", "  ", "one", "a-b_c é1", "x" * 50]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for kind, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Words(data, offsets, kind)
        lower = [t.translate({c: c + 32 for c in range(65, 91)}) for t in texts]
        assert w.count.tolist() == [len(re.findall(pattern, t)) for t in lower]
        said = [bytes(data[a:b]).decode() for a, b in zip(w.start, w.end)]
        assert [s.translate({c: c + 32 for c in range(65, 91)}) for s in said] == [x for t in lower for x in re.findall(pattern, t)]
        by = {}
        for s, v in zip(said, w.value.tolist()):
            assert by.setdefault(s.translate({c: c + 32 for c in range(65, 91)}), v) == v
        assert len(set(by.values())) == len(by)


# -- vantage-point trees -----------------------------------------------------------------------------------------------


def test_tree_is_exact_at_factor_one():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(400, 3)), np.repeat(rng.normal(size=(1, 3)), 150, axis=0)])
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids = np.arange(len(v))
    q, found, score, taken = vptree.Tree(ids, v, 16).search(ids[:40], v[:40], 10, 1.0)
    full = v[:40] @ v.T
    full[np.arange(40), np.arange(40)] = -np.inf
    for i in range(40):
        want = sorted(range(len(v)), key=lambda j: (-round(full[i, j], 9), j))[:10]
        assert found[q == i].tolist() == want
    assert taken < 40 * len(v)
    _, few, _, fewer = vptree.Tree(ids, v, 16).search(ids[:40], v[:40], 10, 3.0)
    assert fewer < taken


def test_search_edge_cases(spark):
    data = [(i, [float(i % 7), 1.0, 0.5 * (i % 3)]) for i in range(60)] + [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [float("nan"), 1.0, 1.0]), (104, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (105, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = rows(vptree.search(df, df.filter("vec_id % 20 = 0 OR vec_id = 105"), k=5, shard_rows=16, leaf=4).orderBy("query_id", "rank"))
    v = {i: np.array(e) for i, e in data[:60]}
    want = []
    for q in (0, 20, 40):
        best = sorted((j for j in v if j != q), key=lambda j: (-float(v[q] @ v[j]), j))[:5]
        want += [(q, r + 1, j, float(v[q] @ v[j])) for r, j in enumerate(best)]
    assert got == want
    assert vptree.search(df.limit(0), df.limit(0)).count() == 0


# -- near duplicates ---------------------------------------------------------------------------------------------------


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {(i, len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("block", [4, 512])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(3)
    bases = [[f"w{rng.randint(0, 400)}" for _ in range(n)] for n in (60, 60, 25, 200)]
    texts = [(0, None), (1, ""), (2, " \t"), (3, "one two"), (4, "ONE  two"), (5, "a b c d e"), (6, "a b c d e f")]
    for i in range(7, 60):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
        texts.append((i, " ".join(w)))
    docs = spark.createDataFrame([*texts, (7, texts[7][1]), (None, "a b c d e")], "doc_id long, text string").withColumn("n", F.lit(1))
    assert set(rows(ngram_join.cluster(docs))) == brute_components(texts)
    assert ngram_join.cluster(docs.limit(0)).count() == 0
    kept = ngram_join.keep_one(docs.filter("doc_id IS NOT NULL"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for _, _, c in brute_components(texts)}


def test_packed_arrays_round_trip():
    rng = np.random.default_rng(2)
    for top in (3, 300, 70_000, 1 << 40):
        docs = np.sort(rng.choice(top, size=min(top, 50), replace=False)).astype(np.int64) - 5
        assert (ngram_join._unpack_docs(ngram_join._pack_docs(docs)) == docs).all()
    values = rng.integers(0, 1 << 48, 20).astype(np.uint64)
    assert (ngram_join._from_six(ngram_join._six(values).tobytes()) == values).all()


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), (None, 3), (1, 5)] + [(100 + i, 101 + i) for i in range(20)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 1 for i in range(1, 6)}, 8: 8, 9: 8, **{100 + i: 100 for i in range(21)}}


# -- decontamination ---------------------------------------------------------------------------------------------------


def test_decontamination(spark):
    item = "The quick brown fox, jumps over 13 lazy dogs while é sleeping"
    bench = spark.createDataFrame([(1, item), (10, "Short item"), (2, None), (3, "?!")], "item_id long, text string")
    texts = [(1, "clean text"), (2, "x THE quick-brown fox jumps over 13 lazy dogs while é sleeping y"), (3, "a short ITEM, here"), (4, None), (5, ""), (6, "the quick brown fox jumps over 13 lazy dogs")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in texts], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in decontaminate.report(docs, bench).collect()}
    assert [got[i]["n_hit"] for i in range(1, 7)] == [0, 12, 2, 0, 0, 0]
    assert got[3]["items_sha256"] == hashlib.sha256(b"10").hexdigest() and got[1]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    sliced = rows(decontaminate.report(docs, bench, max_windows=1).orderBy("doc_id"))
    assert sliced == rows(decontaminate.report(docs, bench).orderBy("doc_id"))
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {1, 4, 5, 6}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.clean(docs, bench, mode="spans").collect()}
    assert cut[2] == "x  y" and cut[3] == "a , here" and cut[1] == "clean text"
    assert decontaminate.report(docs, bench.limit(0)).filter("contaminated").count() == 0


# -- line dedup --------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("t", [1, 2, 3])
def test_banded_distance(spark, t):
    rng = random.Random(t)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 25)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "é", "bc"])
        if abs(len(a) - len(b)) <= t and abs(len(a) - len("".join(b))) <= t:
            pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", line_dedup.distance(F.col("a"), F.col("b"), t), line_dedup.near(F.col("a"), F.col("b"), t)).collect():
        true = edits(r[0], r[1])
        assert (r[2] == true and r[3]) if true <= t else r[2] > t


def test_line_dedup(spark):
    long = "The same sentence stands in many documents of the crawl"
    texts = [(1, f"{long}\nshort\nshort"), (2, f"own line of the second one, long enough\n {long}. "), (3, long.replace("same", "sane")), (4, None), (5, ""), (6, f"{long}\n{long}\nand something else of its own here"), (None, long)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("dropped", F.lit("x"))
    got = {r["doc_id"]: (r["n_lines"], r["n_kept"], list(r["dropped"])) for r in line_dedup.report(docs).collect()}
    assert got[1] == (3, 3, []) and got[2] == (2, 1, [1]) and got[3] == (1, 0, [0]) and got[4] == (1, 1, []) and got[6] == (3, 1, [0, 1]) and got[None] == (1, 1, [])
    kept = {r["doc_id"]: r["text"] for r in line_dedup.apply(docs).collect()}
    assert kept[2] == "own line of the second one, long enough" and 3 not in kept and kept[4] is None and kept[6] == "and something else of its own here"
    assert line_dedup.report(docs.limit(0)).count() == 0


def test_line_dedup_of_short_lines(spark):
    docs = spark.createDataFrame([(1, "Read more\n\nRead more\nshort"), (2, " Read more\nRead mare\n"), (3, "Read more")], "doc_id long, text string")
    got = {r["doc_id"]: list(r["dropped"]) for r in line_dedup.report(docs, short=True).collect()}
    assert got == {1: [2], 2: [0], 3: [0]} and {r["doc_id"] for r in line_dedup.apply(docs, short=True).collect()} == {1, 2}
    assert sum(len(r["dropped"]) for r in line_dedup.report(docs).collect()) == 0


def test_decontaminate_whatever_the_slices(spark):
    words = [f"word{i}" for i in range(40)]
    items = spark.createDataFrame([(5, " ".join(words[0:14])), (6, " ".join(words[8:24])), (5, " ".join(words[0:12]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + " ".join(words) + " after"), (2, "nothing of it"), (3, None)], "doc_id long, text string").withColumn("more", F.lit("x"))
    whole, sliced = ({r["doc_id"]: r for r in decontaminate.report(docs, items, max_windows=m).collect()} for m in (10**6, 1))
    assert whole == sliced and whole[1]["n_items"] == 2
    whole, sliced = ({r["doc_id"]: r for r in decontaminate.clean(docs, items, "spans", max_windows=m).collect()} for m in (10**6, 1))
    assert whole == sliced and not set(words[:24]) & set(whole[1]["text"].split()) and whole[3]["text"] is None


# -- toxicity ----------------------------------------------------------------------------------------------------------


def test_maximal_segments():
    scores = np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5], dtype=float)
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], scores > 0, [False])).astype(np.int8)))
    found = toxicity.maximal_segments(sums, edge[::2], edge[1::2])
    assert [(s, a, b) for s, a, b in found] == [(4.0, 0, 1), (3.0, 2, 3), (7.0, 4, 11)]


def best_segments(scores: list[float], low: int, high: int) -> list[tuple[float, int, int]]:
    """By the definition: the best stretch (the shortest of equals, then the first), then those left and right of it."""
    every = [(-sum(scores[a:b]), b - a, a, b) for a in range(low, high) for b in range(a + 1, high + 1)]
    if not every or min(every)[0] >= 0:
        return []
    best, _, a, b = min(every)
    return [*best_segments(scores, low, a), (-best, a, b), *best_segments(scores, b, high)]


def positive_segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], scores > 0, [False])).astype(np.int8)))
    return toxicity.maximal_segments(np.concatenate(([0.0], np.cumsum(scores))), edge[::2], edge[1::2])


def test_maximal_segments_by_definition():
    rng = random.Random(7)
    for _ in range(300):
        scores = [rng.choice([-4, -3, -1.03125, 1, 2.0625, 3.001953125, 5]) + rng.randrange(1024) / 2**20 for _ in range(rng.randrange(18))]
        assert positive_segments(np.array(scores, dtype=float)) == best_segments(scores, 0, len(scores))


def test_maximal_segments_in_linear_time():
    began = time.time()
    assert len(positive_segments(np.tile([1.0, -2.0], 400_000))) == 400_000
    assert positive_segments(np.tile([2.0, -1.0], 400_000)) == [(400_001.0, 0, 799_999)]
    assert time.time() - began < 30


def test_toxicity_learns(spark):
    rng = random.Random(4)
    made = []
    for i in range(600):
        w = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(["vile", "scum", "stupidly"])
        made.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in made] + [(1000, None), (1001, "")], "doc_id long, text string").withColumn("score", F.lit(7))
    labels = spark.createDataFrame([(i, x) for i, _, x in made] + [(1000, None), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    right = sum(got[i]["predicted"] == x for i, _, x in made)
    assert right >= 590 and got[1000]["predicted"] == 0 and 0 <= got[1001]["score"] <= 1 and len(got) == 602
    assert any(p["words"] >= 1 for p in got[0]["passages"])
    assert toxicity.keep_clean(docs, model).count() == sum(r["predicted"] == 0 for r in got.values())
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).filter("predicted = 1").count() == 0


def test_toxicity_is_fitted_to_what_it_scores(spark, monkeypatch):
    plain = " ".join(f"w{i}" for i in range(60))
    made = [(i, f"{plain} vile " * 250 if i % 4 == 0 else plain, int(i % 4 == 0)) for i in range(120)]
    docs, labels = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string"), spark.createDataFrame([(m[0], m[2]) for m in made], "doc_id long, toxic int")
    seen, real = [], toxicity._logistic
    monkeypatch.setattr(toxicity, "_logistic", lambda x, y: seen.append(x) or real(x, y))
    model = toxicity.fit(docs, labels)
    train = [r["doc_id"] for r in toxicity.training_rows(labels).collect()]
    texts = [m[1].lower().encode() for m in made if m[0] in train]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    found = list(model.documents(toxicity.Words(data, offsets, toxicity.ALNUM)))
    assert max(len(f) for _, f in found) > 200
    assert np.allclose(sorted(map(tuple, seen[0])), sorted(model.features(n, f) for n, f in found))


# -- URL filters -------------------------------------------------------------------------------------------------------


def test_url_filters(spark):
    entries = spark.sql("""SELECT * FROM VALUES ('ads','block','host:a.example.com','add',DATE'2024-01-10'), ('ads','block','host:a.example.com','remove',DATE'2024-02-01'), ('ads','block','host:a.example.com','add',DATE'2024-03-01'),
        ('mal','block','domain:example.com','add',DATE'2024-01-20'), ('ok','allow','prefix:a.example.com/en','add',DATE'2024-01-25'), ('mal','block','domain:example.com','add',DATE'2024-01-20') AS t(list, verdict, pattern, action, day)""")
    captures = spark.sql("""SELECT * FROM VALUES (1,'http://u@A.example.com:80/x?q#f',DATE'2024-01-09'), (1,'http://a.example.com/x',DATE'2024-01-10'), (2,'http://a.example.com/x',DATE'2024-02-01'), (3,'http://a.example.com/en/1',DATE'2024-01-26'),
        (3,'http://a.example.com/english',DATE'2024-01-26'), (4,CAST(NULL AS string),DATE'2024-01-26'), (5,'no url',DATE'2024-01-26'), (6,'http://a.example.com/x',CAST(NULL AS date)), (7,'http://example.com',DATE'2025-01-01'), (7,'http://example.com',DATE'2025-01-01') AS t(page_id, url, day)""")
    got = {(r["page_id"], r["url"]): (r["n_captures"], r["lists"], r["verdict"]) for r in urls.judge(captures, entries).collect()}
    assert got[1, "http://u@A.example.com:80/x?q#f"] == (1, "", "none") and got[1, "http://a.example.com/x"] == (1, "ads", "block") and got[2, "http://a.example.com/x"] == (1, "mal", "block")
    assert got[3, "http://a.example.com/en/1"] == (1, "ads,mal,ok", "allow") and got[3, "http://a.example.com/english"] == (1, "ads,mal", "block")
    assert got[4, None] == (1, "", "none") and got[5, "no url"] == (1, "", "none") and got[6, "http://a.example.com/x"] == (1, "", "none") and got[7, "http://example.com"] == (2, "mal", "block")
    assert urls.judge(captures, entries.limit(0)).filter("verdict <> 'none'").count() == 0


# -- archives ----------------------------------------------------------------------------------------------------------


def test_archives(spark):
    page = "<p>" + "x" * 200 + "é</p>"
    data = [(3, "http://a/ b\n", page), (1, None, page), (2, "http://c", "tiny"), (4, "http://d", "tiny"), (5, "http://e", None), (None, "http://f", page), (6, "http://g", "é" * 60)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    found = warc.read_packages(warc.write_packages(pages, package_bytes=100), payloads=True).collect()
    by = {r["page_id"]: r for r in found}
    assert len(found) == 7 and by[1]["record_type"] == "response" and (by[3]["record_type"], by[3]["refers_to"]) == ("revisit", 1) and by[None]["refers_to"] == 1
    assert {by[2]["record_type"], by[4]["record_type"]} == {"response"} and by[5]["payload_bytes"] == 0
    assert bytes(by[1]["payload"]).decode() == page and by[3]["payload_bytes"] == len(page.encode()) and by[3]["payload_digest"] == hashlib.sha256(page.encode()).hexdigest()
    assert warc.read_packages(warc.write_packages(pages.limit(0))).count() == 0


def test_zip64_directory():
    package = warc.Package()
    package.add(1, warc.build_record(1, "http://a", b"hello", hashlib.sha256(b"hello").hexdigest(), None, "2024-01-01T00:00:00Z"))
    raw = package.to_bytes()
    end = raw.rfind(b"PK\x05\x06")
    count, size, offset = struct.unpack("<HII", raw[end + 10 : end + 20])
    wide = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, offset) + b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1)
    tail = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    for body in (raw, raw[:end] + wide + tail):
        (fields, payload), = warc.read_package(io.BytesIO(body))
        assert payload == b"hello" and fields["warc-type"] == "response"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.DATA, "x" * 100)
    with pytest.raises(ValueError):
        warc.ZipDirectory(packed).locate(warc.DATA)
    with pytest.raises(ValueError):
        warc.ZipDirectory(io.BytesIO(b"no archive"))


# -- chat --------------------------------------------------------------------------------------------------------------


def test_escapes_are_reversible():
    for said in ["", "\\", "\\\\<s>", "<|turn|>a<|text|>", "</s>[INST] ok [/INST]", "<\\s>", "a\\<|end|>\\", "<|e<|end|>nd|>"]:
        formatted = chat.format_turn(said, said)
        assert chat.parse_turns(formatted * 2) == [(said, said)] * 2
        assert not any(mark in chat.escape(said) for mark in chat.CONTROL)


def test_prefix_targets(spark):
    turns = [(1, 0, "system", "be nice"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "yo \\"), (1, 3, "user", None), (1, 4, "assistant", "[INST]"), (1, 5, "user", "bye"), (2, 0, "user", "alone"), (2, 0, "user", "alone"), (3, None, None, "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1))
    examples = chat.full_text(chat.expand(df)).orderBy("conv_id", "example").collect()
    assert [(r["conv_id"], chat.unescape(r["text"][r["loss_start"] : r["loss_end"]])) for r in examples] == [(1, "yo \\"), (1, "[INST]")]
    assert chat.parse_turns(examples[1]["text"]) == [(r or "", t or "") for c, _, r, t in turns[:5]]
    back = {r["conv_id"]: r for r in chat.read_back(chat.expand(df)).collect()}
    assert back[1]["n_turns"] == 6 and back[1]["loss_chars"] == 10 and back[2]["n_turns"] == 2 and back[3]["n_examples"] == 0
    said = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in turns if c == 1)
    assert back[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0


# -- PII ---------------------------------------------------------------------------------------------------------------


def test_permutations():
    for size in (1, 2, 3, 10, 97, 1000):
        made = [pii.permute(i, size, b"k", "t") for i in range(size)]
        assert sorted(made) == list(range(size)) and [pii.permute(m, size, b"k", "t", back=True) for m in made] == list(range(size))
    assert [pii.permute(i, 1000, b"k", "t") for i in range(50)] != [pii.permute(i, 1000, b"other", "t") for i in range(50)]


def test_pseudonyms(spark):
    card = "4539 1488 0343 6467"
    text = f"Card {card}, again 4539-1488-0343-6467; born 1980-02-29 or 29.02.1980, not 2021-02-30. SSN 123-45-6789, ip 10.0.0.255, not 300.1.1.1, call +1 (212) 555-0199, mail Ab.9@x.org, IBAN DE89 3704 0044 0532 0130 00, number 4539148803436468."
    df = spark.createDataFrame([(1, text), (2, f"x {card} y"), (3, None), (4, "")], "doc_id long, text string").withColumn("pii", F.lit(0))
    changed = {r["doc_id"]: r for r in pii.pseudonymise(df, b"key").collect()}
    kinds = [x["kind"] for x in changed[1]["pii"]]
    assert kinds == ["card", "card", "date", "date", "ssn", "ip", "phone", "email", "iban"]
    made = [x["pseudonym"] for x in changed[1]["pii"]]
    assert made[0].replace(" ", "") == made[1].replace("-", "") and changed[2]["pii"][0]["pseudonym"] == made[0]
    assert "4539148803436468" in changed[1]["text"] and "2021-02-30" in changed[1]["text"] and card not in changed[1]["text"]
    assert changed[3]["text"] is None and changed[4]["text"] == "" and len(changed[1]["text"]) >= len(text) - 12
    assert made[2][:4] == made[3][-4:]
    back = pii.pseudonymise(spark.createDataFrame([(1, changed[1]["text"])], "doc_id long, text string"), b"key", back=True).first()["text"]
    assert back == text
