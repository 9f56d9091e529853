"""Registration of queries with their SQL, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The default tokenizer, unit splitters and words, as DuckDB says them.
TOK = r"regexp_extract_all({0}, '[ \t\n\r\f]*(?:[\p{{L}}\p{{N}}_]+|[^ \t\n\r\f\p{{L}}\p{{N}}_])|[ \t\n\r\f]+$')"
TRIMMED = r"list_filter(list_transform({0}, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"


def tok(column: str) -> str:
    return TOK.format(column)


def ntok(column: str) -> str:
    return f"coalesce(len({tok(column)}), 0)::int"


def sentences(column: str) -> str:
    return TRIMMED.format(rf"string_split_regex(regexp_replace({column}, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n+')")


def phrases(column: str) -> str:
    return TRIMMED.format(rf"string_split_regex({column}, '[,:;\-]+|\n+')")


def paragraphs(column: str) -> str:
    return TRIMMED.format(f"string_split({column}, chr(10))")


def words(column: str) -> str:
    return rf"list_filter(string_split_regex(lower({column}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"


def keywords(column: str) -> str:
    return f"list_distinct(list_filter({words(column)}, lambda w: regexp_full_match(w, '[a-z]{{4,}}')))"


def normalized(column: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
