"""N-gram Jaccard join by T-occurrence search: documents whose sets of 5-word shingles overlap enough are linked.

Two documents link when ``100 * |A and B| >= 75 * |A or B|``, that is when they share at least
``T = ceil(75 (|A| + |B|) / 175)`` shingles.

1. Exact copies (by digest of the text) collapse to the one with the smallest doc_id.
2. Every shingle of every document goes, packed by buckets of its hash, to a task that counts in how many documents it
   occurs; shingles found in one document only can link nothing, so a document with fewer than 75 % of the others is done.
3. Shingles are ranked by (document count, hash).  Linked documents share one of their first ``n - ceil(0.75 n) + 1``
   shingles; documents that share one of those fall into one *neighbourhood* (components of that weak relation).
4. A neighbourhood is searched: documents are probes against inverted lists.  DivideSkip sets the longest lists apart, merges the
   short ones (a stable sort, which merges the sorted runs) and keeps the documents met at least ``T - L`` times, then looks those up in the
   long lists by binary search and retains documents that reach T.  Pairs already connected are skipped, so a group of
   copies costs one link a copy, and only links that connect are handed on.  Neighbourhoods of more than ``BLOCK`` documents
   are dealt over pairs of blocks, so no task holds more than two blocks.
5. Links become components.

No step samples, caps or drops candidates; shuffles carry packed arrays, not a row per shingle.

Defined cases: a text of fewer than 5 words is one shingle of all of them; without words (null, empty, white space) the set is
empty and links with nothing; rows with a null doc_id take no part; rows that repeat a doc_id are one document (the union of
their shingles); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._shared import cut, spare, text_bytes
from ._text import SPACED, U, Words, mix, tidy, words_of

SHINGLE = 5
PERCENT = 75
#: Shingles that a task packs at once, and bytes of text for each bucket of hashes.
FLUSH = 1_000_000
BUCKET_BYTES = 8 << 20
#: Documents in a block of a large neighbourhood.
BLOCK = 512
#: DivideSkip's weight of a binary search against a step of the merge.
MU = 0.02
LOW48 = U((1 << 48) - 1)


def needed(n, m, percent: int = PERCENT):
    """The overlap that sets of n and m elements need."""
    return -((-percent * (n + m)) // (100 + percent))


def shingle_sets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle values of each text, sorted within each, and the number for each text."""
    values, whole = words.windows(k), words.whole(k)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    for size in np.unique(words.count[short]).tolist():
        at = words.first[:-1][short[words.count[short] == size]]
        values[at] = words.windows(size)[at]
        whole[at] = True
    values = values[whole]
    per = np.add.reduceat(np.append(whole, False).astype(np.int64), np.minimum(words.first[:-1], len(whole))) if len(words.count) else np.zeros(0, np.int64)
    per[words.count == 0] = 0
    ends = np.cumsum(per)
    for low, high in zip((ends - per).tolist(), ends.tolist()):
        if high - low > 1:
            values[low:high].sort()
    owner = np.repeat(np.arange(len(per)), per)
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], np.bincount(owner[fresh], minlength=len(per))


def _runs(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a run of equal (key, doc) begins, and how long it is."""
    edge = np.ones(len(keys), dtype=bool)
    edge[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    first = np.flatnonzero(edge)
    return first, np.diff(np.append(first, len(keys)))


def _six(values: np.ndarray) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(U)


def _planes(values: np.ndarray, kinds: tuple[str, ...]) -> bytes:
    """Non-negative integers at the least width that holds them, byte plane after byte plane, so that empty planes compress away."""
    top = int(values.max(initial=0))
    kind = next(k for k in kinds if top < 1 << 8 * int(k[-1]))
    width = int(kind[-1])
    return bytes([width]) + values.astype(kind).view(np.uint8).reshape(-1, width).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    width = raw[0]
    return np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(width, -1).T.copy().view(f"<u{width}").ravel()


def _pack_docs(docs: np.ndarray) -> bytes:
    """Ascending ids: the first, then the steps."""
    return docs[:1].astype("<i8").tobytes() + _planes(np.diff(docs).view(U), ("<u1", "<u2", "<u4", "<u8"))


def _unpack_docs(raw: bytes) -> np.ndarray:
    first = np.frombuffer(raw, dtype="<i8", count=1)
    steps = _from_planes(raw[8:]).astype(U).view(np.int64)
    return np.concatenate([first, first + np.cumsum(steps)])


def _pack_counts(counts: np.ndarray) -> bytes:
    return _planes(counts, ("<u1", "<u4"))


def _owners(docs: list[bytes], counts: list[bytes]) -> np.ndarray:
    """The document of every value of some packed rows."""
    return np.concatenate([np.repeat(_unpack_docs(d), _from_planes(c)) for d, c in zip(docs, counts)])


def _width(buckets: int) -> type:
    """The least type of a bucket's number; 16 bits sort by radix."""
    return np.uint16 if buckets <= 65_536 else np.int32


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each value, by its upper bits."""
    return ((values >> U(32)) * U(buckets) >> U(32)).astype(_width(buckets))


def _group(docs: np.ndarray, n: int) -> np.ndarray:
    return (mix(docs.astype(np.int64).view(U)) % U(n)).astype(np.int64)


NAMES = ["key", "bucket", "docs", "counts", "hashes", "codes"]
PACKED = "key int, bucket int, docs binary, counts binary, hashes binary, codes binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], NAMES)


def _packed(keys: np.ndarray, bucket, docs: np.ndarray, values: np.ndarray, codes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows that hold, for each key, its documents, how many values each has, the low 48 bits of the values, and their codes."""
    order = np.argsort(keys, kind="stable") if (docs[1:] >= docs[:-1]).all() else np.lexsort((docs, keys))
    keys, docs, six = keys[order], docs[order], _six(values[order])
    codes = codes[order] if codes is not None else None
    first, length = _runs(keys, docs)
    rows, size = [], 0
    cut_at = np.flatnonzero(np.append(True, keys[first][1:] != keys[first][:-1])) if len(first) else np.zeros(0, np.int64)
    for low, high in zip(cut_at.tolist(), np.append(cut_at[1:], len(first)).tolist()):
        a, b = int(first[low]), int(first[high - 1] + length[high - 1])
        key = int(keys[a])
        rows.append((key, key if bucket is None else bucket, _pack_docs(docs[first[low:high]]), _pack_counts(length[low:high]), six[a:b].tobytes(), codes[a:b].tobytes() if codes is not None else b""))
        size += (b - a) * 6
        if size > 8 << 20:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _shingles(docs: DataFrame, buckets: int, k: int, key: str, text: str) -> DataFrame:
    """Packed shingles by bucket of the hash; rows whose key is -1 - g carry the set sizes of the documents of group g."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            values, owners = np.concatenate([v for v, _ in held]), np.concatenate([o for _, o in held])
            yield from _packed(_bucket(values, buckets), None, owners, values)

        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            for low, high, words in words_of(batch.column(1), SPACED):
                values, per = shingle_sets(words, k)
                own = ids[low:high]
                groups = _group(own, buckets)
                rows = []
                for g in np.unique(groups).tolist():
                    at = groups == g
                    rows.append((-1 - g, -1, own[at].astype("<i8").tobytes(), per[at].astype("<u4").tobytes(), b"", b""))
                yield _batch(rows)
                held.append((values, np.repeat(own, per)))
                size += len(values)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
        tidy()

    return docs.filter(F.col(key).isNotNull()).select(key, text).mapInArrow(each, PACKED)


def _shared_only(buckets: int):
    """For a bucket: keep shingles of several documents, with a code of how many, and send them to their documents' groups."""

    def each(key, group):
        group = group.combine_chunks()
        bucket = key[0].as_py()
        columns = {c: group.column(c).to_pylist() for c in NAMES}
        if bucket < 0:
            return pa.Table.from_batches([_batch([(-1 - bucket, -1, d, c, b"", b"") for d, c in zip(columns["docs"], columns["counts"])])])
        docs = _owners(columns["docs"], columns["counts"])
        values = _from_six(b"".join(columns.pop("hashes")))
        order = np.argsort(values)
        values, docs = values[order], docs[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        counts = np.diff(np.append(first, len(values)))
        times = np.repeat(counts, counts)
        some = times > 1
        values, docs, times = values[some], docs[some], times[some]
        codes = np.minimum(np.floor(8 * np.log2(np.maximum(times, 1))), 255).astype(np.uint8)
        order = np.argsort(docs, kind="stable")
        values, docs, codes = values[order], docs[order], codes[order]
        tidy()
        return pa.Table.from_batches(list(_packed(_group(docs, buckets).astype(_width(buckets)), bucket, docs, values, codes)), schema=_batch([]).schema)

    return each


def _assemble(percent: int):
    """For a group of documents: size, representative and, where the document can have a partner, its shared shingles in rank order."""
    names = ["doc_id", "n", "rep", "prefix", "shared"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def each(key, group):
        group = group.combine_chunks()
        columns = {c: group.column(c).to_pylist() for c in NAMES}
        sizes, reps, united, parts = {}, {}, {}, []
        for bucket, docs, counts, hashes, codes in zip(columns["bucket"], columns["docs"], columns["counts"], columns["hashes"], columns["codes"]):
            if bucket < 0:
                ids = np.frombuffer(docs, dtype="<i8")
            if bucket == -1:
                for i, n in zip(ids.tolist(), np.frombuffer(counts, dtype="<u4").tolist()):
                    sizes[i] = max(n, sizes.get(i, 0))
            elif bucket == -2:
                reps.update(zip(ids.tolist(), np.frombuffer(hashes, dtype="<i8").tolist()))
            elif bucket == -3:
                united.update(zip(ids.tolist(), np.frombuffer(hashes, dtype="<i8").tolist()))
            else:
                parts.append((_owners([docs], [counts]), _from_six(hashes) | U((bucket & 0xFFFF) << 48), np.frombuffer(codes, dtype=np.uint8)))
        sizes.update(united)
        found = {}
        if parts:
            docs, values, codes = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.lexsort((values, codes, docs))
            docs, values, codes = docs[order], values[order], codes[order]
            fresh = np.ones(len(docs), dtype=bool)
            fresh[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
            docs, values = docs[fresh], values[fresh]
            first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
            for low, high in zip(first.tolist(), np.append(first[1:], len(docs)).tolist()):
                i, n, c = int(docs[low]), sizes[int(docs[low])], high - low
                least = -(-percent * n // 100)
                if c >= least and reps.get(i, i) == i:
                    found[i] = (n - least + 1 - (n - c), values[low:high].astype("<u8").tobytes())
        rows = [(i, n, reps.get(i, i), *found.get(i, (None, None))) for i, n in sizes.items()]
        del parts, columns, found
        tidy()
        return pa.table({name: pa.array([r[j] for r in rows], t) for j, (name, t) in enumerate(zip(names, types))})

    return each


def repeats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc): the ids that several rows have."""
    ids = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"))
    return ids.groupBy("doc").agg(F.count("*").alias("c")).filter("c > 1").select("doc")


def union_sizes(docs: DataFrame, ids: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(doc, n): how many shingles the rows of each of these ids have together; a row a shingle, but of these documents only."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for low, high, words in words_of(batch.column(1), SPACED):
                values, per = shingle_sets(words, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[low:high], per)), pa.array(values.view(np.int64))], ["doc", "v"])

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("said")).join(ids, "doc", "left_semi")
    return rows.mapInArrow(each, "doc long, v long").distinct().groupBy("doc").agg(F.count("*").alias("n"))


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, rep): documents whose text equals another's, with the smallest id that has it."""
    rows = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.sha2(F.col(text).cast("binary"), 256).alias("digest"))
    firsts = rows.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("c")).filter("c > 1").select(F.col("digest").alias("d"), "rep")
    return rows.join(firsts, F.col("digest") == F.col("d")).select("doc", "rep")


def _marked_rows(found: DataFrame, buckets: int, mark: int) -> DataFrame:
    """Pairs (document, number) packed for the documents' groups, under a mark in the place of the bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, reps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            groups = _group(docs, buckets)
            yield _batch([(g, mark, docs[groups == g].astype("<i8").tobytes(), b"", reps[groups == g].astype("<i8").tobytes(), b"") for g in np.unique(groups).tolist()])

    return found.mapInArrow(each, PACKED)


# -- neighbourhoods ----------------------------------------------------------------------------------------------------


def _prefix_rows(sets: DataFrame, buckets: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prefixes, raws = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2)
            held, owners, size = [], [], 0
            for i, prefix in enumerate(prefixes):
                values = np.frombuffer(raws[i].as_buffer(), dtype="<u8")[:prefix]
                held.append(values)
                owners.append(np.full(len(values), ids[i]))
                size += len(values)
                if size >= FLUSH or i == len(prefixes) - 1:
                    values = np.concatenate(held)
                    yield from _packed(_bucket(values, buckets), None, np.concatenate(owners), values)
                    held, owners, size = [], [], 0

    return sets.filter("shared IS NOT NULL").select("doc_id", "prefix", "shared").mapInArrow(each, PACKED)


class Forest:
    """Union-find over small integers, the smaller root wins."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _neighbours(key, group):
    """For a bucket: documents that share a prefix shingle, as edges to the smallest document reached within the bucket."""
    group = group.combine_chunks()
    docs = _owners(group.column("docs").to_pylist(), group.column("counts").to_pylist())
    values = _from_six(b"".join(group.column("hashes").to_pylist()))
    names, local = np.unique(docs, return_inverse=True)
    order = np.lexsort((local, values))
    values, local = values[order], local[order]
    same = np.flatnonzero(values[1:] == values[:-1]) + 1
    edge = np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, dtype=bool)
    head = local[np.maximum.accumulate(np.where(edge, np.arange(len(values)), 0))] if len(values) else local
    pairs = np.unique(head[same].astype(np.int64) * len(names) + local[same]) if len(same) else np.zeros(0, np.int64)
    forest = Forest(len(names))
    for a, b in zip((pairs // max(len(names), 1)).tolist(), (pairs % max(len(names), 1)).tolist()):
        forest.join(a, b)
    roots = np.array([forest.find(i) for i in range(len(names))], dtype=np.int64)
    out = np.flatnonzero(roots != np.arange(len(names)))
    del values, local, docs
    tidy()
    return pa.table({"a": pa.array(names[roots[out]].astype(np.int64)), "b": pa.array(names[out].astype(np.int64))})


# -- T-occurrence search -----------------------------------------------------------------------------------------------


class Lists:
    """Inverted lists of some sets: for each element the sorted places of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        elements = np.concatenate(sets) if sets else np.zeros(0, dtype=U)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(elements, kind="stable")
        self.owner = owner[order]
        self.elements, self.first = np.unique(elements[order], return_index=True)
        self.last = np.append(self.first[1:], len(elements))

    def of(self, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bounds of the lists of the probe's elements."""
        at = np.searchsorted(self.elements, probe)
        at[at == len(self.elements)] = 0
        at = at[self.elements[at] == probe] if len(self.elements) else at[:0]
        return self.first[at], self.last[at]


def divide_skip(lists: Lists, probe: np.ndarray, least: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of allowed sets that share at least ``least`` elements with the probe, and how many each shares."""
    first, last = lists.of(probe)
    none = np.zeros(0, dtype=np.int64)
    if least < 1 or len(first) < least:
        return none, none
    order = np.argsort(first - last, kind="stable")
    first, last = first[order], last[order]
    longest = int(last[0] - first[0])
    apart = min(least - 1, int(least / (MU * math.log2(longest + 1) + 1)))
    # Merge the short lists: their runs are sorted, and the stable sort merges runs.
    short_first, short_last = first[apart:], last[apart:]
    merged = np.sort(np.concatenate([lists.owner[a:b] for a, b in zip(short_first.tolist(), short_last.tolist())]), kind="stable")
    edge = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
    found, counts = merged[edge], np.diff(np.append(edge, len(merged)))
    keep = (counts >= least - apart) & allowed[found]
    found, counts = found[keep], counts[keep]
    # Look the candidates up in the long lists, shortest first, and let go of those that can't reach the threshold any more.
    for i in range(apart - 1, -1, -1):
        if not len(found):
            break
        run = lists.owner[first[i] : last[i]]
        at = np.searchsorted(run, found)
        at[at == len(run)] = 0
        counts = counts + (run[at] == found)
        if i % 8 == 0:
            keep = counts + i >= least
            found, counts = found[keep], counts[keep]
    keep = counts >= least
    return found[keep], counts[keep]


def connect(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what is linked, among documents of one block (side all equal) or between the sides 0 and 1."""
    order = np.lexsort((ids, sizes))
    ids, sizes, side, sets = ids[order], sizes[order], side[order], [sets[i] for i in order.tolist()]
    lists, label = Lists(sets), np.arange(len(ids))
    two = len(np.unique(side)) > 1
    out = []
    for i in range(1, len(ids)):
        n = int(sizes[i])
        low = int(np.searchsorted(sizes, -(-percent * n // 100)))
        if low >= i:
            continue
        allowed = label != label[i]
        allowed[:low] = allowed[i:] = False
        if two:
            allowed &= side != side[i]
        if not allowed.any():
            continue
        found, counts = divide_skip(lists, sets[i], int(needed(n, int(sizes[low]), percent)), allowed)
        for j in found[counts >= needed(n, sizes[found], percent)].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((int(ids[j]), int(ids[i])))
    return out


def _search(percent: int):
    def each(key, group):
        group = group.combine_chunks()
        docs, sizes, raws = group.column("doc_id").to_numpy(), group.column("n").to_numpy(), group.column("shared").to_pylist()
        hoods, blocks = group.column("hood").to_numpy(), group.column("block").to_numpy()
        low, high = key[1].as_py(), key[2].as_py()
        out = []
        order = np.argsort(hoods, kind="stable")
        edges = np.flatnonzero(np.append(True, hoods[order][1:] != hoods[order][:-1]))
        for a, b in zip(edges.tolist(), np.append(edges[1:], len(order)).tolist()):
            own = order[a:b]
            side = (blocks[own] == high).astype(np.int8) if low != high else np.zeros(len(own), np.int8)
            out += connect(docs[own], sizes[own], [np.frombuffer(raws[i], dtype="<u8") for i in own.tolist()], side, percent)
        del raws, group
        tidy()
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return each


def cluster(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document."""
    buckets = max(32, -(-text_bytes(docs, text) // BUCKET_BYTES))
    several = cut(repeats(docs, key), "repeats")
    same, more = copies(docs, key, text), None
    if not several.isEmpty():
        same = same.join(several, "doc", "left_anti").join(several.select(F.col("doc").alias("rep")), "rep", "left_anti").select("doc", "rep")
        more = cut(union_sizes(docs, several, k, key, text), "repeats")
    same = cut(same, "copies")
    shared = _shingles(docs, buckets, k, key, text).groupBy("key").applyInArrow(_shared_only(buckets), PACKED)
    marked = _marked_rows(same, buckets, -2)
    if more is not None:
        marked = marked.unionByName(_marked_rows(more, buckets, -3))
    grouped = shared.unionByName(marked).groupBy("key")
    sets = cut(grouped.applyInArrow(_assemble(percent), "doc_id long, n long, rep long, prefix int, shared binary"), "sets")
    edges = _prefix_rows(sets, buckets).groupBy("key").applyInArrow(_neighbours, "a long, b long")
    hoods = components(edges)
    sized = hoods.groupBy("component").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    members = hoods.join(sized, "component").select(F.col("node"), F.col("component").alias("hood"), "blocks", F.expr("CAST(pmod(xxhash64(node), blocks) AS int)").alias("block"))
    packed = members.join(sets.filter("shared IS NOT NULL").select("doc_id", "n", "shared"), F.col("node") == F.col("doc_id"))
    # Small neighbourhoods share a task by hash; a large one has a task for each pair of blocks.
    task = F.when(F.col("blocks") == 1, F.array(F.struct(F.pmod(F.xxhash64("hood"), F.lit(4 * buckets)).alias("t"), F.lit(0).alias("i"), F.lit(0).alias("j"))))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct((F.col("hood") + 4 * buckets).alias("t"), F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    dealt = packed.withColumn("task", F.explode(task.otherwise(pairs))).select("task.t", "task.i", "task.j", "hood", "block", "doc_id", "n", "shared")
    links = dealt.groupBy("t", "i", "j").applyInArrow(_search(percent), "a long, b long")
    found = components(links).select(F.col("node"), "component")
    out = sets.select("doc_id", "n", "rep").join(found, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Of each group of linked documents the one with the smallest id, with all its columns."""
    other = spare(docs, "gone")
    gone = cluster(docs, key=key, text=text, **options).filter("component_id <> doc_id").select(F.col("doc_id").alias(other))
    return docs.join(gone, F.col(key) == F.col(other), "left_anti")
