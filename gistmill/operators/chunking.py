"""Documents into chunks: rows (sample_id, chunk_index, text, token_count and, where the method knows it, the place)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Chunking
from ..functions import text as T


def merge_sentences(text: Column, limit: int) -> Column:
    """Greedy merge: a sentence joins the buffer while it fits, a longer one stands alone.  Array of (text, n, start)."""
    parts = F.transform(T.units(text, "sentence"), lambda s: F.struct(s.alias("t"), T.n_tokens(s).alias("n")))
    item = "struct<text:string,n:int,start:int>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"), F.lit(0).alias("start"), F.coalesce(text, F.lit("")).alias("whole"))

    def step(acc: Column, s: Column) -> Column:
        full = (acc["n"] + s["n"] > limit) & (acc["cur"] != "")
        done = F.struct(acc["cur"].alias("text"), acc["n"].alias("n"), acc["start"].alias("start"))
        found = F.call_function("locate", s["t"], acc["whole"], acc["start"] + 1) - 1
        return F.struct(
            F.when(full, F.array_append(acc["out"], done)).otherwise(acc["out"]).alias("out"),
            F.when(full | (acc["cur"] == ""), s["t"]).otherwise(F.concat(acc["cur"], F.lit(" "), s["t"])).alias("cur"),
            F.when(full, s["n"]).otherwise(acc["n"] + s["n"]).alias("n"),
            F.when(full, found).otherwise(acc["start"]).alias("start"), acc["whole"].alias("whole"),
        )

    last = lambda acc: F.when(acc["cur"] != "", F.array_append(acc["out"], F.struct(acc["cur"].alias("text"), acc["n"].alias("n"), acc["start"].alias("start")))).otherwise(acc["out"])
    return F.aggregate(parts, start, step, last)


def windows(text: Column, size: int, step: int) -> Column:
    """Windows of tokens, none that only repeats the tail of the one before.  Array of (text, n, start), the start in tokens."""

    def cut(toks: Column) -> Column:
        n = F.size(toks)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: (n > 0) & ((i == 0) | (i - step + size < n)))
        return F.transform(starts, lambda i: F.struct(F.array_join(F.slice(toks, i + 1, F.lit(size)), "").alias("text"), F.least(n - i, F.lit(size)).alias("n"), i.alias("start")))

    return T.let(T.tokens(F.coalesce(text, F.lit(""))), cut)


def paragraphs(text: Column, separator: str) -> Column:
    parts = T.trimmed_non_empty(F.split(text, separator))
    return F.transform(parts, lambda p: F.struct(p.alias("text"), T.n_tokens(p).alias("n"), F.lit(None).cast("int").alias("start")))


def chunk(docs: DataFrame, config: Chunking = Chunking(), key: str = "sample_id", text: str = "text") -> DataFrame:
    """Narrow: one explode, no shuffle.  A null or blank text has no chunks."""
    column = F.col(text)
    if config.method == "sentence":
        found = merge_sentences(column, config.max_chunk_tokens)
    elif config.method == "paragraph":
        found = paragraphs(column, config.separator)
    elif config.method == "fixed_tokens":
        found = windows(column, config.max_chunk_tokens, config.max_chunk_tokens)
    else:
        found = windows(column, config.max_chunk_tokens, config.max_chunk_tokens - config.overlap)
    rows = docs.select(key, F.posexplode(found).alias("chunk_index", "c"))
    return rows.select(key, "chunk_index", F.col("c.text").alias("text"), F.col("c.n").alias("token_count"), F.col("c.start").alias("start"))
