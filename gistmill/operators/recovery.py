"""Response recovery: spans of a reply that come from a compressed prompt are replaced by what the original says."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_ENDS = re.compile(r"[.!?\n]+")


def _original_of(span: str, original: str, sentences: list[str], holders: dict[str, list[int]]) -> str:
    """The span itself where the original has it, else the first of the sentences that share most of its words, half of them at least."""
    if span in original:
        return span
    wanted = set(span.lower().split())
    shared = Counter(i for w in wanted for i in holders.get(w, ()))
    best = max(shared.values(), default=0)
    return sentences[min(i for i, n in shared.items() if n == best)] if best and 2 * best >= len(wanted) else span


def recover_text(original: str, compressed: str, response: str) -> str:
    """Greedy: the longest run of words from here on that the compressed prompt holds is looked up, other words stay."""
    said = response.split(" ")
    sentences = [s for part in _ENDS.split(original) if (s := part.strip())]
    holders: dict[str, list[int]] = {}
    for i, sentence in enumerate(sentences):
        for w in set(sentence.lower().split()):
            holders.setdefault(w, []).append(i)
    out, at = [], 0
    while at < len(said):
        size, span, place = 0, "", 0
        # A longer run can't begin before the first place of a shorter one.
        while at + size < len(said):
            longer = f"{span} {said[at + size]}" if size else said[at]
            place = compressed.find(longer, place)
            if place < 0:
                break
            span, size = longer, size + 1
        out.append(_original_of(span, original, sentences, holders) if size else said[at])
        at += max(size, 1)
    return " ".join(out)


@pandas_udf(StringType())
def _recover(original: pd.Series, compressed: pd.Series, response: pd.Series) -> pd.Series:
    return pd.Series([recover_text(*(x or "" for x in row)) for row in zip(original, compressed, response)])


def recover(original: str, compressed: str, response: str) -> Column:
    return _recover(original, compressed, response)
