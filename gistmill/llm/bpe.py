"""Byte-level BPE by DuckDB recursive queries: encoding contracts each word's leftmost pair of least rank until none is left; ordered aggregation decodes.

Each Arrow batch is one relation.  Its texts are split by the tokenizer's pattern; the distinct words become rows
(word, position, token) of single bytes.  A recursive query joins neighbouring tokens with the merge table and contracts, in
every word at once, the leftmost pair of the least rank, until no pair of the word is in the table.  A word that is itself in
the vocabulary is its own token.  Decoding joins (document, position, token) rows with the vocabulary and aggregates the
bytes in the order of position.

The vocabulary is a rank file whose place is a parameter; the driver reads it and broadcasts it, at most ``MAX_VOCABULARY``
entries.  Nothing is shuffled and a task's memory is bounded by its batches; each worker keeps the tokens of the words it met
last, in two generations of about ``CACHE_WORDS`` and the words of one group.

Defined cases: a null or empty text gives no ids and decodes to the empty text; repeated rows are encoded alike; special
tokens don't exist, their strings are ordinary text; an id without an entry raises ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import tidy

MAX_VOCABULARY = 1_000_000
CACHE_WORDS = 125_000
#: Texts are encoded in groups of about so many characters.
GROUP_CHARS = 1 << 20
#: A query keeps every turn's rows, at most the sum of the squared lengths of its words; that sum is bounded.
MAX_ROWS = 5_000_000
#: A longer word contracts on a heap instead: its turns would number in the thousands.
LONG_WORD = 1024

#: The pattern that the array splitter implements; others go through the regex library.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: ``place`` is word * 2048 + position; positions stay consecutive, so a pair's right half lies at place + 1.
ENCODE = """
WITH RECURSIVE step(turn, place, tok, nxt) AS (
  SELECT 0, place, tok, nxt FROM initial
  UNION ALL
  (WITH best AS (
     SELECT place >> 11 AS word, min((merged::bigint << 32) + place) AS least
     FROM step JOIN merges ON merges.pair = (tok::bigint << 31) + nxt GROUP BY 1),
   chosen AS (
     SELECT word, least & 4294967295 AS spot, (least >> 32)::int AS merged, step.nxt AS beyond
     FROM best JOIN step ON step.place = (least & 4294967295) + 1)
   SELECT turn + 1, place - (place > spot)::int, CASE WHEN place = spot THEN merged ELSE tok END,
          CASE WHEN place = spot THEN beyond WHEN place + 1 = spot THEN merged ELSE nxt END
   FROM step JOIN chosen ON word = place >> 11 WHERE place <> spot + 1)
)
SELECT place >> 11 AS word, tok
FROM step ANTI JOIN (SELECT turn - 1 AS turn, place >> 11 AS word FROM step WHERE place & 2047 = 0) later
  ON later.word = place >> 11 AND later.turn = step.turn
ORDER BY place
"""
DECODE = "SELECT doc, array_to_string(list(said ORDER BY pos), '') AS said FROM tokens JOIN vocabulary USING (tok) GROUP BY doc"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line is a token in base64 and its rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} entries; at most {MAX_VOCABULARY} are broadcast")
    return ranks


class Classes:
    """For each code point: 0 letter, 1 number, 2 other, 3 white space."""

    found: np.ndarray | None = None
    #: The code points of Unicode's White_Space property.
    SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]

    @classmethod
    def table(cls) -> np.ndarray:
        if cls.found is None:
            kinds = np.full(0x110000, 2, dtype=np.uint8)
            firsts = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], dtype=np.uint8)
            kinds[firsts == ord("L")] = 0
            kinds[firsts == ord("N")] = 1
            kinds[cls.SPACE] = 3
            cls.found = kinds
        return cls.found


def split_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of the joined texts, where each token of PATTERN begins (and the end), and where each text begins (and the end)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    text_at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    n = len(points)
    if not n:
        return points, np.zeros(1, dtype=np.int64), text_at
    kind = Classes.table()[points]
    edge = np.zeros(n + 1, dtype=bool)
    edge[text_at] = True
    runs = np.ones(n + 1, dtype=bool)
    runs[1:n] = (kind[1:] != kind[:-1]) | edge[1:n]
    at = np.flatnonzero(runs)
    first, last, what = at[:-1], at[1:], kind[at[:-1]]
    start = np.zeros(n + 1, dtype=bool)
    start[text_at] = True
    start[first] = True
    # A white-space run before something else in its text gives up its last character, which the next token takes if it is a space.
    gives = (what == 3) & ~edge[last]
    tail = last[gives] - 1
    start[tail] = True
    joined = points[tail] == 32
    start[tail[joined] + 1] = False
    # A lone apostrophe that begins a token takes the letters of a contraction with it.
    lone = first[(what == 2) & (last - first == 1) & (points[first] == 39)]
    lone = lone[start[lone] & ~edge[lone + 1]]
    if len(lone):
        wide = np.concatenate((points, np.zeros(2, dtype=np.uint32)))
        a, b = wide[lone + 1], np.where(edge[np.minimum(lone + 2, n)], 0, wide[lone + 2])
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for take, size in ((one, 1), (two & ~one, 2)):
            for j in range(size):
                start[lone[take] + 1 + j] = False
            start[lone[take] + 1 + size] = True
    return points, np.flatnonzero(start), text_at


#: Tokens that one ordered aggregation decodes.
DECODE_TOKENS = 200_000


class Coder:
    """Encodes and decodes with one vocabulary; lives as long as the Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import duckdb

        self.ranks, self.pattern, self.cache, self.older = ranks, pattern, {}, {}
        pairs, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append((a << 31) + b)
                    merged.append(rank)
        self.byte_id = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int32)
        self.known = set(ranks.values())
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        self.load("merges", pa.table({"pair": pa.array(pairs, pa.int64()), "merged": pa.array(merged, pa.int32())}))
        self.load("vocabulary", pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "said": pa.array([t.decode("latin-1") for t in ranks], pa.string())}))

    def load(self, name: str, rows: pa.Table) -> None:
        self.db.register("_rows", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM _rows")
        self.db.unregister("_rows")

    def query(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.db.register(name, rows)
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return out

    def words(self, texts: list[str]) -> list[list[str]]:
        if self.pattern != PATTERN:
            import regex

            return [regex.findall(self.pattern, t) for t in texts]
        out: list[list[str]] = []
        points, starts, text_at = split_points(texts)
        joined = "".join(texts)
        cuts = np.searchsorted(starts, text_at)
        places = starts.tolist()
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = places[low : high + 1]
            out.append([joined[a:b] for a, b in zip(own[:-1], own[1:])])
        return out

    def learn(self, words: set[str]) -> None:
        """Put the tokens of words that the cache lacks into it, as little-endian 32-bit integers."""
        new = []
        for word in words:
            raw = word.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.cache[word] = rank.to_bytes(4, "little")
            elif len(raw) > LONG_WORD:
                self.cache[word] = self.contract(raw)
            else:
                new.append((word, raw))
        costs = np.cumsum([len(raw) ** 2 for _, raw in new])
        low = 0
        while low < len(new):
            high = max(low + 1, int(np.searchsorted(costs, (costs[low - 1] if low else 0) + MAX_ROWS, side="right")))
            part = new[low : min(high, low + 100_000)]
            low += len(part)
            sizes = np.array([len(raw) for _, raw in part], dtype=np.int64)
            word = np.repeat(np.arange(len(part), dtype=np.int64), sizes)
            pos = np.arange(len(word), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            tok = self.byte_id[np.frombuffer(b"".join(raw for _, raw in part), dtype=np.uint8)]
            if (tok < 0).any():
                raise ValueError("the vocabulary lacks a byte of the text")
            nxt = np.append(tok[1:], np.int32(-1))
            nxt[np.cumsum(sizes) - 1] = -1
            found = self.query(ENCODE, "initial", pa.table({"place": word * 2048 + pos, "tok": tok, "nxt": nxt}))
            ids = found.column("tok").to_numpy().astype("<u4").tobytes()
            ends = np.searchsorted(found.column("word").to_numpy(), np.arange(len(part)), side="right") * 4
            at = 0
            for (name, _), end in zip(part, ends.tolist()):
                self.cache[name] = ids[at:end]
                at = end

    def contract(self, raw: bytes) -> bytes:
        """The same contraction for one long word, on a heap of (rank, position)."""
        n = len(raw)
        parts: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return b"".join(self.ranks[p].to_bytes(4, "little") for p in parts if p is not None)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        split = self.words(texts)
        missing = {w for words in split for w in words} - self.cache.keys()
        met = missing & self.older.keys()
        self.cache |= {w: self.older[w] for w in met}
        self.learn(missing - met)
        of = self.cache.__getitem__
        return [b"".join(map(of, words)) for words in split]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes that ids stand for."""
        sizes = np.array([len(x) // 4 for x in encoded], dtype=np.int64)
        tok = np.frombuffer(b"".join(encoded), dtype="<u4").astype(np.int64)
        if not len(tok):
            return [b""] * len(encoded)
        if unknown := set(np.unique(tok).tolist()) - self.known:
            raise ValueError(f"no entry for id {min(unknown)}")
        # Pieces of documents, and runs of whole pieces: a document of any length is decoded in bounded memory.
        ends = np.cumsum(sizes)
        owners, edges = [], [0]
        for doc, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
            cuts = [*range(end - size + DECODE_TOKENS, end, DECODE_TOKENS), end] if size else []
            edges += cuts
            owners += [doc] * len(cuts)
        places = np.array(edges, dtype=np.int64)
        low, parts = 0, [[] for _ in encoded]
        while low < len(owners):
            high = max(low + 1, int(np.searchsorted(places, places[low] + DECODE_TOKENS, side="right")) - 1)
            a, b = int(places[low]), int(places[high])
            rows = pa.table({"doc": np.repeat(np.arange(low, high, dtype=np.int64), np.diff(places[low : high + 1])), "pos": np.arange(a, b), "tok": tok[a:b].astype(np.int32)})
            found = self.query(DECODE, "tokens", rows)
            for piece, said in sorted(zip(found.column("doc").to_pylist(), found.column("said").to_pylist())):
                parts[owners[piece]].append(said.encode("latin-1"))
            low = high
        return [b"".join(p) for p in parts]


_coders: dict[tuple[str, str], Coder] = {}


def _coder(ranks: dict[bytes, int], name: str, pattern: str) -> Coder:
    """The worker's coder for a vocabulary (known by its digest); a worker keeps one."""
    if (name, pattern) not in _coders:
        _coders.clear()
        _coders[name, pattern] = Coder(ranks, pattern)
    return _coders[name, pattern]


def groups(texts: list[str], limit: int = GROUP_CHARS) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _apply(docs: DataFrame, text: str, ranks_path: str, pattern: str, made: dict[str, pa.DataType], schema: str, each_group) -> DataFrame:
    """Every column but the text, and what ``each_group(coder, values)`` makes of the text column."""
    ranks = read_ranks(ranks_path)
    name = hashlib.sha256(b"".join(k + b" %d " % v for k, v in sorted(ranks.items()))).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    others = [c for c in docs.columns if c != text and c not in made]
    rows = docs.select(*others, text)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            own = own or _coder(shared.value, name, pattern)
            columns = each_group(own, batch.column(len(others)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, made.values()))], [*others, *made])
        tidy()

    return rows.mapInArrow(each, fields + schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, text: str = "text") -> DataFrame:
    """Every column but the text, and ``ids``, the array of its token ids."""

    def each_group(own: Coder, values: list[str | None]) -> list[list]:
        found = [np.frombuffer(x, dtype="<u4") for part in groups([v or "" for v in values]) for x in own.encode(part)]
        return [found]

    return _apply(docs, text, ranks_path, pattern, {"ids": pa.list_(pa.int64())}, "ids array<long>", each_group)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """Every column but the ids, and ``decoded``, the bytes they stand for."""

    def each_group(own: Coder, values: list[list[int] | None]) -> list[list]:
        return [own.decode([np.asarray(v or [], dtype="<u4").tobytes() for v in values])]

    return _apply(encoded, ids, ranks_path, PATTERN, {"decoded": pa.binary()}, "decoded binary", each_group)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, text: str = "text") -> DataFrame:
    """Encode and decode in one pass: every column but the text, ``n_tokens`` and digests of the ids (little-endian unsigned 32-bit) and of the decoded bytes."""

    def each_group(own: Coder, values: list[str | None]) -> list[list]:
        counts, ids, said = [], [], []
        for part in groups([v or "" for v in values]):
            encoded = own.encode(part)
            counts += [len(x) // 4 for x in encoded]
            ids += [hashlib.sha256(x).hexdigest() for x in encoded]
            said += [hashlib.sha256(x).hexdigest() for x in own.decode(encoded)]
        return [counts, ids, said]

    made = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _apply(docs, text, ranks_path, pattern, made, "n_tokens long, ids_sha256 string, decoded_sha256 string", each_group)
