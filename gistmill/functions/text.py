"""Text functions as Columns: tokens, units, clean-up rules, words and answer comparison.  All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default tokenizer: white space goes with the token after it, so joining tokens gives back the text.
TOKEN = r"[ \t\n\r\f]*(?:[\p{L}\p{N}_]+|[^ \t\n\r\f\p{L}\p{N}_])|[ \t\n\r\f]+$"

#: The patterns of the clean-up rules and unit splitters.
URL = r"https?://[^\s<>\"']+|www\.[^\s<>\"']+"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
SPECIAL = r"[^\w\s.,;:!?'\"\-\(\)\[\]{}]"
WORD_GAP = r"[^\p{L}\p{N}_]+"
#: White space as ``(?U)\\s`` has it.
WHITE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
UNITS = {"token": r"\s+", "phrase": r"[,:;\-]+|\n+", "sentence": r"(?<=[.!?])\s+|\n+"}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def n_tokens(text: Column) -> Column:
    """Tokens of a text; null and empty count 0."""
    return F.coalesce(F.size(tokens(text)), F.lit(0))


def compression_ratio(before: Column, after: Column) -> Column:
    """1 - after / before, 0 where nothing was there."""
    return F.when(before == 0, F.lit(0.0)).otherwise(1 - after / before)


def truncate_tokens(text: Column, n: Column) -> Column:
    """The first n tokens."""
    return F.array_join(F.slice(tokens(text), F.lit(1), F.greatest(n, F.lit(0))), "")


def trimmed_non_empty(parts: Column) -> Column:
    """Strip white space off each part and leave the empty ones out."""
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(WHITE))), lambda x: x != "")


def units(text: Column, granularity: str) -> Column:
    """The text's tokens, phrases or sentences, trimmed, without empty ones."""
    if granularity not in UNITS:
        raise ValueError(f"unknown granularity: {granularity}")
    return trimmed_non_empty(F.split(text, UNITS[granularity]))


def synced_sentences(text: Column) -> Column:
    """Sentences with the white space after them, so that joining them gives back the text."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?][ \t\n\r\f]+)", "$1\u0001"), "\u0001"), lambda s: s != "")


def clean(text: Column, urls: bool = True, emails: bool = True, special: bool = False, whitespace: bool = True, lowercase: bool = False) -> Column:
    """The text rules, in fixed order; Unicode normalisation is :func:`gistmill.functions.unicode.nfkc`."""
    # Few texts hold what every match has; the others needn't be searched from each of their characters.
    if urls:
        text = let(text, lambda x: F.when(F.contains(x, F.lit("://")) | F.contains(x, F.lit("www.")), F.regexp_replace(x, URL, "")).otherwise(x))
    if emails:
        text = let(text, lambda x: F.when(F.contains(x, F.lit("@")), F.regexp_replace(x, EMAIL, "")).otherwise(x))
    if special:
        text = F.regexp_replace(text, f"(?U){SPECIAL}", "")
    if whitespace:
        text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.lower(text) if lowercase else text


def words(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), WORD_GAP), lambda w: w != "")


def keywords(text: Column) -> Column:
    """The distinct words of four or more ASCII letters."""
    return F.filter(F.array_distinct(F.split(F.lower(text), WORD_GAP)), lambda w: w.rlike("^[a-z]{4,}$"))


def keyword_retention(original: Column, reduced: Column) -> Column:
    """Per cent of the original's keywords that the reduced text keeps; 0 where it has none."""
    return keyword_share(keywords(original), reduced)


def keyword_share(found: Column, reduced: Column) -> Column:
    """The same of keywords that are already found."""
    kept, all_ = F.size(F.array_intersect(found, F.split(F.lower(reduced), WORD_GAP))), F.size(found)
    return F.when(all_ == 0, F.lit(0.0)).otherwise(100.0 * kept / all_)


def normalize(text: Column) -> Column:
    """Lower case, punctuation to spaces, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def answer_retained(answer: Column, context: Column) -> Column:
    """Whether the context holds the answer: false for an empty one, true for yes and no, else as a substring."""
    said = normalize(answer)
    return F.when(F.coalesce(said, F.lit("")) == "", False).when(said.isin("yes", "no"), True).otherwise(F.contains(normalize(context), said))


def answer_words(text: Column) -> Column:
    """Normalised words without articles."""
    return F.filter(F.split(normalize(text), " "), lambda w: (w != "") & ~w.isin("a", "an", "the"))


def exact_match(a: Column, b: Column) -> Column:
    return F.array_join(answer_words(a), " ") == F.array_join(answer_words(b), " ")


def bag_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two word lists as bags: 1 if both are empty, 0 if one is."""
    times = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    common = F.aggregate(F.array_distinct(predicted), F.lit(0), lambda acc, w: acc + F.least(times(predicted, w), times(gold, w)))
    both = F.size(predicted) + F.size(gold)
    return F.when(both == 0, F.lit(1.0)).when((F.size(predicted) == 0) | (F.size(gold) == 0), F.lit(0.0)).otherwise(2.0 * common / both)


def answer_score(predicted: Column, gold: Column) -> Column:
    """1 for an exact match, else the bag F1."""
    return F.when(exact_match(predicted, gold), F.lit(1.0)).otherwise(bag_f1(answer_words(predicted), answer_words(gold)))


def info_density(text: Column) -> Column:
    """Share of distinct words plus a tenth for each word with a digit; 0 without words."""
    ws = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.when(F.size(ws) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(ws)) / F.size(ws) + 0.1 * F.size(F.filter(ws, lambda w: w.rlike("[0-9]"))))


def structured_segments(prompt: Column, default_rate: float) -> Column:
    """Tagged segments as (segment, rate, compress); text outside tags is left out.

    A tag's attributes come in either order; without a rate the default holds, or 1 where compress=False.
    """
    pattern = r"<llmlingua\s*(?:,\s*rate\s*=\s*[0-9.]+)?\s*(?:,\s*compress\s*=\s*(?:True|False))?\s*(?:,\s*rate\s*=\s*[0-9.]+)?\s*>[^<]*</llmlingua>"
    found = F.regexp_extract_all(prompt, F.lit(pattern), F.lit(0))

    def read(tag: Column) -> Column:
        head = F.regexp_extract(tag, r"^<llmlingua([^>]*)>", 1)
        rate = F.regexp_extract(head, r"rate\s*=\s*([0-9.]+)", 1)
        compress = ~F.contains(F.regexp_replace(head, r"\s", ""), F.lit("compress=False"))
        given = F.when(rate != "", F.expr("try_cast(NULL AS double)"))
        given = F.when(rate != "", rate.try_cast("double")).otherwise(given)
        return F.struct(
            F.regexp_extract(tag, r"^<llmlingua[^>]*>([^<]*)</llmlingua>$", 1).alias("segment"),
            F.coalesce(given, F.when(compress, F.lit(default_rate)).otherwise(F.lit(1.0))).alias("rate"), compress.alias("compress"),
        )

    return F.transform(found, read)


def trigger_fill(template: str, columns: list[str]) -> Column:
    """A template with its fields in braces replaced by columns; slots like [T] stay."""
    out: Column = F.lit(template)
    for c in columns:
        out = F.replace(out, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out


def slot_mask(filled: Column, slot: str = "[T]") -> Column:
    """For each space-separated token whether it is the slot."""
    return F.transform(F.split(filled, " "), lambda t: t == slot)


def padded(values: Column, width: Column, pad: int = 0) -> Column:
    """An array filled up at its end to the width."""
    return F.concat(values, F.array_repeat(F.lit(pad), F.greatest(width - F.size(values), F.lit(0))))
