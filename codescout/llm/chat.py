"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

The context of an example is all turns before its target, and only the text of the target is trainable. Turns are written as
``<|im_start|>role``, a line break, the text and ``<|im_end|>``. Inside roles and texts a backslash is doubled, and one is put behind the
first character of every control string, so an escaped text holds none and reads back as it was.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from codescout.llm.common import ready, slices

START, END = "<|im_start|>", "<|im_end|>\n"
# Control strings of well-known chat templates; those of this one come first.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
TARGET = "assistant"
#: Turns whose examples one task makes; those of longer conversations are shared out.
SPAN = 256
#: Characters of examples that are sent on together.
BATCH_CHARS = 1 << 22
_ESCAPED = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_READ = re.compile(r"\\(\\|n)?")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0] + "\\", text)


def escape_role(role: str) -> str:
    """As in a text; line breaks, which would end the role, are written as backslash and n."""
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    """A doubled backslash is one, one before ``n`` (in roles) a line break, any other nothing."""
    return _READ.sub(lambda m: {None: "", "\\": "\\", "n": "\n"}[m[1]], text)


def read_turns(example: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of an example."""
    for found in _TURN.finditer(example):
        yield unescape(found[1]), unescape(found[2])


def expand(turns: DataFrame, target: str = TARGET, span: int = SPAN) -> DataFrame:
    """Examples: ``conv_id``, ``position`` (of the target among the turns, from 0), ``text``, ``loss_start`` and ``loss_end`` (code points,
    the end excluded) and ``complete`` (the example holds the whole conversation).

    Input columns are ``conv_id``, ``turn``, ``role`` and ``text``; others are ignored. Turns are ordered by turn (null first), role and
    text; rows that are equal in all of them are turns of their own. Null roles and texts count as empty; rows without ``conv_id``
    are one conversation. A conversation that doesn't end with a target has one more example, all context and no target, with the
    position after its last turn, so that no turn is lost.

    A task streams through sorted turns and holds the context so far. Examples of long conversations are made by several tasks, one
    for each ``span`` turn numbers; turns are sent to all tasks that need them as context.
    """
    ready(turns)
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    part = F.coalesce(F.floor(F.col("turn") / span).cast("long"), F.lit(-(1 << 62)))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), part.alias("_own"))
    held = rows.groupBy(F.col("conv_id").alias("_conv")).agg(F.collect_set("_own").alias("_parts")).filter(F.size("_parts") > 1)
    joined = rows.join(held, rows["conv_id"].eqNullSafe(held["_conv"]), "left")
    later = F.filter("_parts", lambda p: p >= F.col("_own"))
    sent = joined.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "_own",
        F.explode(F.coalesce(later, F.array("_own"))).alias("_part"),
        F.coalesce(F.array_max("_parts"), F.col("_own")).alias("_last"),
    )
    dealt = sent.repartition("conv_id", "_part").sortWithinPartitions("conv_id", "_part", "turn", "role", "text")
    fields = [
        turns.schema["conv_id"],
        T.StructField("position", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("loss_start", T.LongType()),
        T.StructField("loss_end", T.LongType()),
        T.StructField("complete", T.BooleanType()),
    ]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in _examples(batches, target):
            out.append(row)
            size += len(row[2])
            if size > BATCH_CHARS:
                yield to_batch(out)
                out, size = [], 0
        if out:
            yield to_batch(out)

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return dealt.mapInArrow(run, T.StructType(fields))


def _examples(batches: Iterator[pa.RecordBatch], target: str) -> Iterator[tuple]:
    """Examples from sorted turns. An example waits until it is known whether another turn follows."""
    current, context, count, waiting, whole = None, [], 0, None, False

    def close() -> Iterator[tuple]:
        if waiting is not None:
            yield (*waiting, whole)
        elif context and whole:
            yield current[0], count, "".join(context), 0, 0, True

    for batch in batches:
        for rows in slices(batch, 256):
            values = [c.to_pylist() for c in rows.columns]
            for conv, role, text, own, part, last in zip(values[0], *values[2:]):
                if current != (conv, part):
                    yield from close()
                    current, context, count, waiting, whole = (conv, part), [], 0, None, part == last
                elif waiting is not None:
                    yield (*waiting, False)
                    waiting = None
                escaped = escape(text)
                context.append(f"{START}{escape_role(role)}\n{escaped}{END}")
                if role == target and own == part:
                    joined = "".join(context)
                    stop = len(joined) - len(END)
                    waiting = (conv, count, joined, stop - len(escaped), stop)
                count += 1
    yield from close()


def digests(examples: DataFrame) -> DataFrame:
    """What a conversation's examples say when they are read back: turns from the complete one, trainable text from all.

    Only the trainable texts and one whole text per conversation are shuffled; they are read in order and hashed as they come.
    """
    span = F.col("loss_end") - F.col("loss_start")
    loss = F.substring("text", (F.col("loss_start") + 1).cast("int"), span.cast("int"))
    narrow = examples.select(
        "conv_id", "position", loss.alias("loss"), F.when(F.col("complete"), F.col("text")).alias("whole"), F.char_length("text").alias("chars")
    )
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    fields = [
        examples.schema["conv_id"],
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in _read_back(batches):
            held.append(row)
            if len(held) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], [f.name for f in fields])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], [f.name for f in fields])

    return dealt.mapInArrow(run, T.StructType(fields))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The digests of one conversation after the other, from its sorted examples."""
    started, current = False, None
    for batch in batches:
        for rows in slices(batch, 256):
            for conv, _, loss, whole, chars in zip(*[c.to_pylist() for c in rows.columns]):
                if not started or conv != current:
                    if started:
                        yield current, n_turns, turns.hexdigest(), loss_chars, losses.hexdigest(), formatted
                    started, current = True, conv
                    n_turns, loss_chars, formatted, turns, losses = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                plain = unescape(loss)
                losses.update(plain.encode())
                loss_chars += len(plain)
                formatted += chars
                for role, text in read_turns(whole or ""):
                    n_turns += 1
                    turns.update(f"{role}\n{text}\n".encode())
    if started:
        yield current, n_turns, turns.hexdigest(), loss_chars, losses.hexdigest(), formatted
