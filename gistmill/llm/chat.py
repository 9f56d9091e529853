"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own, all turns before it are context, only that reply is trainable.

The template writes ``<s>`` and then, for each turn, ``<|turn|>role<|text|>text<|end|>``.  Control strings inside roles and
texts get a backslash after their first character and backslashes are doubled, so formatted text reads back exactly.

All examples of a conversation are prefixes of one text, so an example is stored as what it adds to the one before
(``delta``, whole turns) and as the span of its reply in the whole (``loss_start``, ``loss_end``, in characters).  That
is linear in the input, whatever a conversation's length; :func:`full_text` spells the examples out.  Turns stream through a
task in order, so a long conversation needs no memory of its own.

Defined cases: a null text or role is empty; turns are ordered by turn, role and text, nulls first, so ties and repeated
rows have a fixed order and all count; a null conv_id is a conversation; one without assistant turns has no example, only
rows whose ``example`` is null; turns after the last reply follow in such rows; an empty table gives no rows; extra columns
are ignored; conv_id may have any type that Spark can sort and Arrow can hold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BEGIN, TURN, TEXT, END = "<s>", "<|turn|>", "<|text|>", "<|end|>"
#: What the template escapes inside texts: its own marks and the control strings of common chat templates.
CONTROL = [BEGIN, "</s>", "[INST]", "[/INST]", TURN, TEXT, END]
_SPECIAL = re.compile("|".join([re.escape("\\"), *map(re.escape, CONTROL)]))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PARSED = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)

#: Turns without a reply are handed on once they have so many characters.
FLUSH_CHARS = 1 << 20


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}"


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _PARSED.findall(formatted)]


def expand(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Rows (conv_id, seq, example, start, delta, loss_start, loss_end), in the order of seq within each conversation.

    ``example`` numbers the examples of a conversation from 0; example i is the text of all deltas up to its own.
    """
    kind = dict(turns.dtypes)["conv_id"]
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "seq", "example", "start", "delta", "loss_start", "loss_end"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, open_, seq, example, start, held, size, own_type = None, False, 0, 0, 0, [], 0, None

        def close(span: tuple[int, int] | None) -> None:
            nonlocal seq, example, start, held, size
            out.append((conv, seq, example if span else None, start, "".join(held), *(span or (None, None))))
            seq, start, held, size = seq + 1, start + size, [], 0
            example += bool(span)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([own_type, *types])], names)

        weight = 0
        for batch in batches:
            own_type = batch.schema.field(0).type
            ids, roles, texts = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for own, role, text in zip(ids, roles, texts):
                if not open_ or own != conv:
                    if open_ and held:
                        close(None)
                    conv, open_, seq, example, start, held, size = own, True, 0, 0, 0, [BEGIN], len(BEGIN)
                said = format_turn(role, text)
                held.append(said)
                size += len(said)
                weight += len(said)
                if role == trained_role:
                    last = start + size - len(END)
                    close((last - len(escape(text)), last))
                elif size >= FLUSH_CHARS:
                    close(None)
                if weight >= 4 * FLUSH_CHARS and out:
                    yield made()
                    out, weight = [], 0
        if open_ and held:
            close(None)
        if out:
            yield made()

    return rows.mapInArrow(each, f"conv_id {kind}, seq long, example long, start long, delta string, loss_start long, loss_end long")


def full_text(examples: DataFrame) -> DataFrame:
    """Rows (conv_id, example, text, loss_start, loss_end) with every example spelt out: for conversations of bounded length, as the text grows with its square."""
    order = W.partitionBy("conv_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    spelt = examples.withColumn("text", F.array_join(F.collect_list("delta").over(order), ""))
    return spelt.filter(F.col("example").isNotNull()).select("conv_id", "example", "text", "loss_start", "loss_end")


def read_back(examples: DataFrame, ordered: bool = False) -> DataFrame:
    """Parse what :func:`expand` wrote: per conversation the turns, their digest, and the characters and digest of the text under the loss mask, unescaped.

    Rows are brought together by conversation and sorted by seq, as a table that was written and read again has neither.
    ``ordered`` leaves that out where ``examples`` comes from :func:`expand` in the same plan, which hands rows on in that order.
    """
    if not ordered:
        examples = examples.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    kind = dict(examples.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, state, own_type = None, None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([own_type, *types])], names)

        for batch in batches:
            own_type = batch.schema.field("conv_id").type
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "seq", "start", "delta", "loss_start", "loss_end")]
            for own, seq, start, delta, first, last in zip(*columns):
                if seq == 0:
                    if state:
                        out.append(_closed(conv, state))
                    conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse_turns(delta):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if first is not None:
                    said = unescape(delta[first - start : last - start])
                    state[2] += len(said)
                    state[3].update(said.encode())
                    state[5] += 1
                state[4] += len(delta)
            if len(out) >= 1000:
                yield made()
                out = []
        if state:
            out.append(_closed(conv, state))
        if out:
            yield made()

    return examples.mapInArrow(each, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")


def _closed(conv, state: list) -> tuple:
    return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])
