"""Readers and row adapters: heterogeneous question-answering rows to (document, question, answer), files by suffix, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by its suffix: .tsv (header, strings), .jsonl and .json, .csv (header), .parquet."""
    suffix = path.rsplit(".", 1)[-1]
    reader = spark.read.schema(schema) if schema else spark.read
    if suffix == "tsv":
        return reader.csv(path, sep="\t", header=True)
    if suffix in ("jsonl", "json"):
        return reader.json(path)
    if suffix == "csv":
        return reader.csv(path, header=True, inferSchema=not schema)
    if suffix == "parquet":
        return reader.parquet(path)
    raise ValueError(f"no reader for .{suffix}")


def flatten_titled(context: Column, separator: str = "\n\n") -> Column:
    """``title. sentence sentence`` for each paragraph of a struct of titles and sentence lists, joined."""
    return F.array_join(titled_paragraphs(context), separator)


def titled_paragraphs(context: Column) -> Column:
    made = F.zip_with(context["title"], context["sentences"], lambda t, s: F.concat(t, F.lit(". "), F.array_join(F.coalesce(s, F.array().cast("array<string>")), " ")))
    return F.filter(made, lambda p: F.trim(p) != "")


def paragraphs(text: Column) -> Column:
    """Split at blank lines; without any, at ``. `` with line breaks as spaces; else the whole text."""
    blank = F.filter(F.split(text, "\n\n"), lambda p: F.trim(p) != "")
    dots = F.filter(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"\. "), lambda p: F.trim(p) != "")
    return F.when(F.size(blank) > 1, blank).when(F.size(dots) > 1, dots).otherwise(F.array(text))


def _first(value: str, kind: str) -> Column:
    """A string column, or the first of an array column."""
    return F.coalesce(F.get(F.col(value), F.lit(0)), F.lit("")) if kind.startswith("array") else F.coalesce(F.col(value).cast("string"), F.lit(""))


def adapt(rows: DataFrame, dataset: str) -> DataFrame:
    """(document, question, answer) from a data set's own rows, chosen by its name; rows without document or question go."""
    kinds, name = dict(rows.dtypes), dataset.lower()
    if "hotpot" in name:
        out = rows.select(flatten_titled(F.col("context")).alias("document"), "question", F.coalesce("answer", F.lit("")).alias("answer"))
    elif "longbench" in name:
        out = rows.select(F.col("context").alias("document"), F.col("input").alias("question"), _first("answers", kinds["answers"]).alias("answer"))
    elif "2wiki" in name or "musique" in name:
        context = flatten_titled(F.col("context")) if kinds["context"].startswith("struct") else F.col("context").cast("string")
        out = rows.select(context.alias("document"), "question", F.coalesce("answer", F.lit("")).alias("answer"))
    elif "qasper" in name:
        out = rows.select(F.array_join(F.flatten("full_text.paragraphs"), "\n\n").alias("document"), F.get(F.col("qas.question"), F.lit(0)).alias("question"), F.lit("").alias("answer"))
    elif "trivia" in name:
        out = rows.select(F.array_join("search_results.search_context", " ").alias("document"), "question", F.coalesce("answer.value", F.lit("")).alias("answer"))
    else:
        pick = lambda names: F.coalesce(*[F.nullif(_first(n, kinds[n]), F.lit("")) for n in names if n in kinds], F.lit(""))
        out = rows.select(pick(("context", "document", "article")).alias("document"), pick(("question", "query")).alias("question"), pick(("answer", "answers")).alias("answer"))
    return out.filter((F.coalesce("document", F.lit("")) != "") & (F.coalesce("question", F.lit("")) != ""))


def instances(samples: DataFrame) -> DataFrame:
    """Optimiser instances (input, expected, question); rows that lack document, question or answer go."""
    full = samples.filter("document <> '' AND question <> '' AND answer <> ''")
    return full.select(F.concat(F.lit("Context:\n"), "document", F.lit("\n\nQuestion: "), "question").alias("input"), F.col("answer").alias("expected"), "question")


def truncate_instance(text: Column, limit: int) -> Column:
    """An instance cut to the limit, its question kept whole."""
    mark = "\n\nQuestion:"
    tail = F.concat(F.lit(mark), F.substring_index(text, mark, -1))
    head = F.substring(text, F.lit(1), F.greatest(F.lit(0), F.lit(limit) - F.length(tail)))
    return F.when(F.length(text) <= limit, text).when(F.contains(text, F.lit(mark)), F.concat(head, tail)).otherwise(F.substring(text, 1, limit))


def classified(rows: DataFrame) -> DataFrame:
    """Valid items (text, label): trimmed, the label in lower case, neither empty."""
    out = rows.select(F.trim("text").alias("text"), F.lower(F.trim("label")).alias("label"))
    return out.filter((F.col("text") != "") & (F.col("label") != ""))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a digest of seed and key: the same on any partitioning."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def label_ids(rows: DataFrame, order: str, label: str = "label") -> DataFrame:
    """(label, id): ids in the order in which labels are first seen."""
    from pyspark.sql import Window as W

    firsts = rows.groupBy(label).agg(F.min(order).alias("_first"))
    return firsts.select(label, (F.row_number().over(W.orderBy("_first")) - 1).alias("id"))  # as many rows as labels


def synthetic(spark: SparkSession, n: int, positive: list[str], negative: list[str], seed: int = 42) -> DataFrame:
    """n labelled sentences, labels alternating, phrases by hash."""
    rows = spark.range(n)
    good = F.col("id") % 2 == 0
    pick = lambda names: F.get(F.array(*map(F.lit, names)), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(len(names))).cast("int"))
    return rows.select("id", F.when(good, pick(positive)).otherwise(pick(negative)).alias("sentence"), F.when(good, "positive").otherwise("negative").alias("label"))
