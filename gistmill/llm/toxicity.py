"""Toxicity by maximum-scoring segments: token log-odds with Dirichlet priors, a linear scan for every maximal toxic passage, extreme-value calibration.

*Tokens.*  Lower-cased words; each word is looked up whole and by its first 5, 6, 7, 8 and 10 bytes, so that inflected or
unseen forms of a known stem count.  Features live in 2**22 hashed slots, so the model has a fixed size (32 MB), whatever
the corpus; that bound is what is broadcast.

*Log-odds.*  From labelled rows only: for a slot seen in y1 toxic and y0 clean documents, the log-odds ratio under the
Dirichlet prior ``0.5 + prior_weight * share of the slot`` and its z-score.  A word takes the log-odds of its slot with the
largest absolute z, if that reaches ``min_z``, else minus ``drift``, which makes the expected score negative.

*Passages.*  Ruzzo and Tompa's linear scan gives every maximal-scoring segment.  Scores of segments in clean text follow an
extreme-value law with parameters lambda (the positive root of E[exp(lambda s)] = 1) and K (from the mean of clean
maxima).  A segment of score S in n words has the excess ``lambda S - ln(K n)``; it is significant if that is positive.  The
document's score is a logistic fit on the largest excess and on the sum of the significant ones.

Labels come from a bounded sample: at most ``MAX_TRAIN`` rows, those with the smallest hash of doc_id; everything is scored.

Defined cases: a null or empty text has no words, no passages and the score of a document with nothing found; rows whose
label is null or not 0 or 1 aren't used; a document labelled twice counts once, toxic if any row says so; without labels
of both kinds every score is 0.  Repeated rows are scored alike.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import spare
from ._text import ALNUM, U, Words, mix, passes, tidy

SLOTS = 1 << 22
PREFIXES = (5, 6, 7, 8, 10)
MAX_TRAIN = 12_000
SCORES = "score double, predicted int, n_words long, n_passages int, top_excess double, passages array<struct<first:int,words:int,excess:double>>"


def slots(words: Words) -> np.ndarray:
    """For each word the slots of the whole word and its prefixes; a word no longer than a prefix repeats its own slot."""
    from ._text import BYTE_VALUE, powers

    up, down = powers(len(words.data))
    out = np.empty((len(PREFIXES) + 1, len(words.start)), dtype=np.int32)
    out[0] = (words.value >> U(42)).astype(np.int32)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words.data) + 1, dtype=U)
        np.cumsum(BYTE_VALUE[words.data] * up[: len(words.data)], out=sums[1:])
        for row, k in enumerate(PREFIXES, 1):
            longer = words.end - words.start > k
            at = words.start[longer]
            out[row] = out[0]
            out[row, longer] = (mix((sums[at + k] - sums[at]) * down[at] + U(1000 + k)) >> U(42)).astype(np.int32)
    return out


def maximal_segments(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments, given the running sums and the runs of positive scores: (score, first, after last)."""
    # Sum before, sum after, first, after last, and the last earlier entry with a smaller sum before: following these keeps the scan linear.
    stack: list[tuple[float, float, int, int, int]] = []
    for first, last in zip(starts.tolist(), ends.tolist()):
        before, after = float(sums[first]), float(sums[last])
        j = len(stack) - 1
        while j >= 0 and stack[j][0] >= before:
            j = stack[j][4]
        while j >= 0 and stack[j][1] < after:
            before, first, lower = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = lower
        stack.append((before, after, first, last, j))
    return [(after - before, first, last) for before, after, first, last, _ in stack]


@dataclass
class Model:
    """Everything that scoring needs; of fixed size."""

    odds: np.ndarray
    weight: np.ndarray
    drift: float
    min_z: float
    lam: float = 1.0
    log_k: float = 0.0
    beta: tuple[float, float, float] = (-50.0, 0.0, 0.0)
    _strong: np.ndarray | None = None

    def token_scores(self, words: Words) -> np.ndarray:
        found = slots(words)
        strong = self.weight >= self.min_z if self._strong is None else self._strong
        self._strong = strong
        known = strong[found[0]]
        for row in found[1:]:
            known |= strong[row]
        at = np.flatnonzero(known)
        out = np.full(len(words.start), -self.drift)
        some = found[:, at]
        best = self.weight[some]
        out[at] = self.odds[some[best.argmax(axis=0), np.arange(len(at))]]
        return out

    def documents(self, words: Words) -> Iterator[tuple[int, list[tuple[float, int, int]]]]:
        """For each text its number of words and its maximal segments."""
        scores = self.token_scores(words)
        for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            own = scores[low:high]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], own > 0, [False])).astype(np.int8)))
            if not len(edge):
                yield high - low, []
                continue
            sums = np.concatenate(([0.0], np.cumsum(own)))
            yield high - low, maximal_segments(sums, edge[::2], edge[1::2])

    def excess(self, score: float, n: int) -> float:
        return self.lam * score - self.log_k - math.log(max(n, 1))

    def features(self, n: int, found: list[tuple[float, int, int]]) -> tuple[float, float]:
        """The largest excess (bounded) and the logarithm of the summed significant ones."""
        each = [self.excess(s, n) for s, _, _ in found]
        return max(-10.0, min(40.0, max(each, default=-10.0))), math.log1p(sum(x for x in each if x > 0))

    def probability(self, top: float, total: float) -> float:
        a, b, c = self.beta
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * top + c * total))))


def _lowered(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    return docs.select(*columns, F.lower(F.col(text)).alias(spare(docs, "_text")))


def training_rows(labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The labelled ids to learn from: doc_id, toxic.  Rows whose crc32(doc_id) mod 5 is 0 are held out."""
    kept = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    once = kept.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, prior_weight: float = 500.0, min_z: float = 3.0, drift: float = 0.3, text: str = "text") -> Model:
    """Learn a :class:`Model` from at most ``max_train`` labelled documents.  The driver gets counts of slots (bounded by their number) and two figures a training document."""
    rows = F.broadcast(training_rows(labels, max_train))
    train = docs.select("doc_id", text).join(rows, "doc_id").select("toxic", F.lower(F.col(text)).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = None
        total = np.zeros(2, dtype=np.int64)
        for batch in batches:
            kinds = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            tally = np.zeros((2, SLOTS), dtype=np.int32) if tally is None else tally
            for low, high, data, offsets in passes(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                found = slots(words)
                owner = words.owner()
                total += np.bincount(kinds[low:high], minlength=2)[:2]
                seen = np.unique((owner[None, :].astype(np.int64) << 22 | found).ravel())
                kind = kinds[low:high][seen >> 22]
                for k in (0, 1):
                    at, times = np.unique(seen[kind == k] & (SLOTS - 1), return_counts=True)
                    tally[k][at] += times.astype(np.int32)
        if tally is not None:
            at = np.flatnonzero(tally.sum(axis=0))
            for low in range(0, len(at), 100_000):
                part = at[low : low + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(tally[0][part].astype(np.int64)), pa.array(tally[1][part].astype(np.int64))], ["slot", "clean", "toxic"])
            tally = None
            tidy()
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([int(total[0])]), pa.array([int(total[1])])], ["slot", "clean", "toxic"])

    sums = train.mapInArrow(count, "slot int, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    everything = F.sum(F.when(F.col("slot") >= 0, F.col("clean"))).alias("n0"), F.sum(F.when(F.col("slot") >= 0, F.col("toxic"))).alias("n1")
    kept = sums.filter((F.col("slot") < 0) | (F.col("clean") + F.col("toxic") >= 3)).toArrow()
    slot, y0, y1 = (np.asarray(kept.column(c).to_numpy()) for c in ("slot", "clean", "toxic"))
    weight, odds = np.zeros(SLOTS, dtype=np.float32), np.zeros(SLOTS, dtype=np.float32)
    model = Model(odds, weight, drift, min_z)
    head = slot < 0
    if not head.any() or not y0[head].sum() or not y1[head].sum():
        return model
    slot, y0, y1 = slot[~head], y0[~head].astype(float), y1[~head].astype(float)
    n0, n1 = max(y0.sum(), 1.0), max(y1.sum(), 1.0)
    prior = 0.5 + prior_weight * (y0 + y1) / (n0 + n1)
    full = prior.sum()
    log_odds = np.log((y1 + prior) / (n1 + full - y1 - prior)) - np.log((y0 + prior) / (n0 + full - y0 - prior))
    odds[slot] = log_odds
    weight[slot] = np.abs(log_odds) / np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
    return _calibrate(model, train)


def _calibrate(model: Model, train: DataFrame) -> Model:
    """Set lambda and K from the training documents' segments, then the logistic fit from both features of all of them, in a second pass."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for low, _, data, offsets in passes(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                scores = own.token_scores(words)
                for i, (n, found) in enumerate(own.documents(words)):
                    part = scores[words.first[i] : words.first[i + 1]]
                    hist = np.bincount(np.clip(np.round(part * 4) + 60, 0, 120).astype(np.int64), minlength=121)
                    rows.append((n, max((s for s, _, _ in found), default=0.0), hist.tolist()))
            kinds = batch.column(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([kinds, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["toxic", "n", "best", "hist"])
        tidy()

    rows = train.mapInArrow(measure, "toxic long, n long, best double, hist array<long>").toArrow()
    toxic = np.asarray(rows.column("toxic").to_numpy())
    n = np.asarray(rows.column("n").to_numpy())
    best = rows.column("best").to_pylist()
    hist = np.asarray(rows.column("hist").to_pylist(), dtype=float)[toxic == 0].sum(axis=0)
    share, values = hist / max(hist.sum(), 1), (np.arange(121) - 60) / 4
    model.lam = _root(share, values)
    gaps = [model.lam * s - math.log(max(k, 1)) for s, k, t in zip(best, n, toxic) if t == 0]
    model.log_k = float(np.mean(gaps)) - 0.5772156649 if gaps else 0.0
    lam, log_k = model.lam, model.log_k

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own.lam, own.log_k = lam, log_k
        for batch in batches:
            found = [own.features(n, x) for _, _, data, offsets in passes(batch.column(1)) for n, x in own.documents(Words(data, offsets, ALNUM))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], ["toxic", "top", "total"])
            del found
        tidy()

    fitted = train.mapInArrow(features, "toxic long, top double, total double").toArrow()
    x = np.column_stack([fitted.column(c).to_numpy() for c in ("top", "total")])
    model.beta = _logistic(x, fitted.column("toxic").to_numpy().astype(float))
    return model


def _root(share: np.ndarray, values: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1, or 1 where there is none."""
    at = lambda lam: float((share * np.exp(lam * values)).sum()) - 1
    if (share * values).sum() >= 0 or not share[values > 0].any():
        return 1.0
    low, high = 1e-6, 1e-3
    while at(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton's method on the log-likelihood with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (y - p) - ridge * beta
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(3)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in beta)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with score, predicted (1 from 0.5 on), n_words, n_passages, top_excess and the significant passages (first word, words, excess); columns of these names in ``docs`` give way to them.  Narrow: nothing is shuffled."""
    names = [c for c in docs.columns if c != text]
    taken = [c for c in names if c in ("score", "predicted", "n_words", "n_passages", "top_excess", "passages")]
    names = [c for c in names if c not in taken]
    rows = _lowered(docs, *names, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    item = pa.struct([("first", pa.int32()), ("words", pa.int32()), ("excess", pa.float64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out: list[tuple] = []
            for _, _, data, offsets in passes(batch.column(len(names))):
                for n, found in own.documents(Words(data, offsets, ALNUM)):
                    top, total = own.features(n, found)
                    p = own.probability(top, total)
                    clear = [{"first": a, "words": b - a, "excess": e} for s, a, b in found if (e := own.excess(s, n)) > 0]
                    out.append((p, int(p >= 0.5), n, len(clear), top, clear))
            types = (pa.float64(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.list_(item))
            made = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*names, "score", "predicted", "n_words", "n_passages", "top_excess", "passages"])

    return rows.mapInArrow(each, f"{fields}, {SCORES}" if fields else SCORES)


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("*", F.lower(F.col(text)).alias(spare(docs, "_lowered")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            keep: list[bool] = []
            for _, _, data, offsets in passes(batch.column(batch.num_columns - 1)):
                keep += [own.probability(*own.features(n, found)) < 0.5 for n, found in own.documents(Words(data, offsets, ALNUM))]
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep, pa.bool_()))
        tidy()

    return rows.mapInArrow(each, docs.schema)
