"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, a scan of every training window, exact verification of hits.

Texts are lower-cased (A-Z only); words are runs of digits, ASCII letters and characters beyond ASCII.  A benchmark item
of ``n`` words or more gives each window of n consecutive words, a shorter one its whole word sequence; an item without
words gives nothing.  A training word inside any occurrence of a window is *hit*.

Defined cases: a null or empty text has no words and is clean; a null item text gives no window; rows of one item_id count
once; an empty benchmark leaves every document clean; extra columns are ignored or, in :func:`clean`, kept.

The set is broadcast in slices of about ``max_windows`` windows (an item of more is cut at words, so a slice has a bound
whatever the benchmark's size).  The driver and a worker hold one slice at a time; a batch of documents is scanned with each
slice in turn, and the hits are united by row before anything is counted, dropped or cut.  So the result is the same however
many slices there are, rows that repeat a doc_id (or have none) stay apart, and no document is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import ALNUM, Words, words_of

MAX_WINDOWS = 1_000_000
REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class WindowSet:
    """Windows of items: for each length the sorted window values, the items that hold each, and the normalised words for verification."""

    def __init__(self, items: list[tuple[object, str]], n: int):
        self.lengths: dict[int, tuple[np.ndarray, list[list[int]], list[bytes]]] = {}
        self.names = [str(i) for i, _ in items]
        found: dict[int, dict[int, tuple[set[int], bytes]]] = {}
        for at, (_, text) in enumerate(items):
            data = np.frombuffer((text or "").encode(), dtype=np.uint8)
            words = Words(data, np.array([0, len(data)]), ALNUM)
            total = len(words.start)
            if not total:
                continue
            k = min(n, total)
            values = words.windows(k)
            raw = bytes(data).lower()
            for i in range(total - k + 1):
                said = b" ".join(raw[words.start[j] : words.end[j]] for j in range(i, i + k))
                found.setdefault(k, {}).setdefault(int(values[i]), (set(), said))[0].add(at)
        for k, by in found.items():
            keys = np.array(sorted(by), dtype=np.uint64)
            self.lengths[k] = (keys, [sorted(by[int(v)][0]) for v in keys], [by[int(v)][1] for v in keys])

    def __len__(self) -> int:
        return sum(len(x[0]) for x in self.lengths.values())

    def bitmap(self, k: int) -> np.ndarray:
        """A first filter on 20 bits of the value."""
        out = np.zeros(1 << 20, dtype=bool)
        out[(self.lengths[k][0] >> np.uint64(44)).astype(np.int64)] = True
        return out


def scan(words: Words, windows: WindowSet, bitmaps: dict[int, np.ndarray]) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Which words of the texts are hit, and the items found in each text."""
    delta = np.zeros(len(words.start) + 1, dtype=np.int32)
    items: dict[int, set[int]] = {}
    for k, (keys, owners, said) in windows.lengths.items():
        values = words.windows(k)
        near = np.flatnonzero(bitmaps[k][(values >> np.uint64(44)).astype(np.int64)])
        if not len(near):
            continue
        place = np.searchsorted(keys, values[near])
        place[place == len(keys)] = 0
        same = keys[place] == values[near]
        near, place = near[same], place[same]
        text_of = np.searchsorted(words.first, near, side="right") - 1
        inside = near + k <= words.first[text_of + 1]
        for at, which, text in zip(near[inside].tolist(), place[inside].tolist(), text_of[inside].tolist()):
            spans = (words.data[words.start[j] : words.end[j]].tobytes() for j in range(at, at + k))
            if b" ".join(spans).lower() == said[which]:
                delta[at] += 1
                delta[at + k] -= 1
                items.setdefault(text, set()).update(owners[which])
    return np.cumsum(delta[:-1]) > 0, items


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _pieces(text: str, n: int, limit: int) -> Iterator[str]:
    """The text in stretches of at most ``limit`` windows of n words; together they have all its windows."""
    if len(text) // 2 <= limit:
        yield text
        return
    spans = [m.span() for m in _WORD.finditer(text)]
    for low in range(0, max(1, len(spans) - n + 1), limit):
        part = spans[low : low + limit + n - 1]
        if part:
            yield text[part[0][0] : part[-1][1]]


def _slices(benchmark: DataFrame, n: int, max_windows: int, item_id: str, text: str) -> Iterator[WindowSet]:
    """Window sets of at most about ``max_windows`` windows; the items stream through the driver, one slice at a time."""
    held: list[tuple[object, str]] = []
    size = 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        for piece in _pieces(row["t"] or "", n, max_windows):
            here = 1 + len(piece) // 2
            if held and size + here > max_windows:
                yield WindowSet(held, n)
                held, size = [], 0
            held.append((row["i"], piece))
            size += here
    yield WindowSet(held, n)


def _shared(docs: DataFrame, benchmark: DataFrame, n: int, max_windows: int, item_id: str, text: str) -> list[Broadcast]:
    return [docs.sparkSession.sparkContext.broadcast(w) for w in _slices(benchmark, n, max_windows, item_id, text)]


def _opened(shared: list[Broadcast], kept: list) -> Iterator[tuple[WindowSet, dict[int, np.ndarray]]]:
    """The slices with their bitmaps, one at a time; a lone one is kept for the next batch."""
    for held in shared:
        if kept:
            yield kept[0]
            continue
        own = held.value
        opened = own, {k: own.bitmap(k) for k in own.lengths}
        if len(shared) == 1:
            kept.append(opened)
        yield opened
        if len(shared) > 1:
            held.__dict__.pop("_value", None)


def _found(column: pa.Array, shared: list[Broadcast], kept: list) -> tuple[list[int], dict[int, np.ndarray], dict[int, set[str]]]:
    """For the texts of a batch: how many words each has, and by row, where there are any, which words are hit and the names of the items."""
    counts: list[int] = []
    hits: dict[int, np.ndarray] = {}
    names: dict[int, set[str]] = {}
    for turn, (own, bitmaps) in enumerate(_opened(shared, kept)):
        for low, _, words in words_of(column, ALNUM):
            if not turn:
                counts += words.count.tolist()
            hit, items = scan(words, own, bitmaps)
            for i, which in items.items():
                mask = hit[words.first[i] : words.first[i + 1]]
                hits[low + i] = hits[low + i] | mask if low + i in hits else mask.copy()
                names.setdefault(low + i, set()).update(own.names[j] for j in which)
    return counts, hits, names


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = MAX_WINDOWS, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row: ``n_words``, ``runs`` (hit words as first, after-last, first, ...) and ``items`` (sorted names of the items that occur)."""
    shared = _shared(docs, benchmark, n, max_windows, item_id, item_text)
    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_words long, runs array<long>, items array<string>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        for batch in batches:
            counts, found, names = _found(batch.column(1), shared, kept)
            runs = [_edges(found[i]).tolist() if i in found else [] for i in range(batch.num_rows)]
            said = [sorted(names.get(i, ())) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(said, pa.list_(pa.string()))], [key, "n_words", "runs", "items"])

    return docs.select(key, text).mapInArrow(each, schema)


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 (of the sorted, comma-joined item names) and contaminated."""
    key = options.get("key", "doc_id")
    n_hit = F.expr("aggregate(sequence(0, size(runs) div 2 - 1), CAST(0 AS bigint), (acc, i) -> acc + runs[2 * i + 1] - runs[2 * i])")
    found = hits(docs, benchmark, n, **options)
    n_hit = F.when(F.size("runs") > 0, n_hit).otherwise(F.lit(0).cast("long"))
    return found.select(
        key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = 10, max_windows: int = MAX_WINDOWS, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The training table without the benchmark: ``documents`` drops every contaminated document, ``spans`` cuts the hit words (with what separates them) out of its text.

    All columns stay.  One pass over the documents; spans are cut when all slices are read.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode: {mode}")
    shared, at = _shared(docs, benchmark, n, max_windows, item_id, item_text), docs.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        for batch in batches:
            _, found, _ = _found(batch.column(at), shared, kept)
            if not found:
                yield batch
            elif mode == "documents":
                yield batch.filter(pa.array([i not in found for i in range(batch.num_rows)], pa.bool_()))
            else:
                column = batch.column(at).to_pylist()
                for row, hit in found.items():
                    column[row] = _cut(column[row], hit)
                arrays = batch.columns
                arrays[at] = pa.array(column, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(each, docs.schema)


def _edges(hit: np.ndarray) -> np.ndarray:
    """The runs of hit words as first, after-last, first, ..."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), axis=1).ravel()


def _cut(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and what separates them."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    words = Words(data, np.array([0, len(data)]), ALNUM, hashed=False)
    runs = _edges(hit).tolist()
    out, at = [], 0
    for a, b in zip(runs[::2], runs[1::2]):
        out.append(data[at : words.start[a]].tobytes())
        at = words.end[b - 1]
    out.append(data[at:].tobytes())
    return b"".join(out).decode()
