"""Operator 3: chat formatting by prefix-target expansion.

Every turn becomes a piece of its conversation's transcript: system ``<<SYS>>..<</SYS>>``,
user ``[INST]..[/INST]``, assistant ``<s>..</s>``, any other role
``[ROLE]role[/ROLE]..</s>``. Inside texts and role names a backslash is doubled, and a
control string gets one behind its first character, so none is left and the escape can
be undone: a backslash stands for the character behind it.

Every assistant turn is one example: its context is the transcript up to and with its
``<s>``, and its reply alone is under the loss mask. All examples of a conversation share
one stored transcript, of which an example names three places (context_end, loss_start,
loss_end); so what is written grows with the turns, not with their square.
``render_examples`` writes the texts out.

Turns are dealt by ranges of (conv_id, turn), so one conversation may lie in many
partitions; the driver gets one row a partition, from which places across partitions
follow.

Defined cases: a null text is empty; a null or empty role is kept as the empty role; a
null conv_id is one conversation, read back as null; turns with equal numbers are ordered
by role, then text, and null turns come first; a conversation without an assistant gives
no examples; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import materialize, small_batches

#: The control strings of the template (fixed values).
CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PIECE = re.compile(r"<<SYS>>(.*)<</SYS>>|\[INST\](.*)\[/INST\]|<s>(.*)</s>|\[ROLE\](.*)\[/ROLE\](.*)</s>", re.DOTALL)
NULL_ID = -(1 << 63)
PIECES = "part int, conv_key long, place long, role_kind string, piece string, start_in_part long, chars int, loss_start int, loss_end int"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The piece, and where its text stands in it."""
    body = escape(text or "")
    head, tail = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}.get(role) or (f"[ROLE]{escape(role or '')}[/ROLE]", "</s>")
    return head + body + tail, len(head), len(head) + len(body)


def parse_turn(piece: str) -> tuple[str, str]:
    """(role, text) of a piece."""
    m = _PIECE.fullmatch(piece)
    if m is None:
        raise ValueError("not a piece of this template")
    for role, text in zip(("system", "user", "assistant"), m.groups()):
        if text is not None:
            return role, unescape(text)
    return unescape(m[4]), unescape(m[5])


def format_conversations(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """The written transcript: one piece a turn, with its place and start in the conversation."""
    spark = turns.sparkSession
    small_batches(spark, 2000)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now, place, start = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            rows = []
            for key, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key != now:
                    now, place, start = key, 0, 0
                piece, begin, end = format_turn(role, text)
                rows.append((part, key, place, role, piece, start, len(piece), begin, end))
                place, start = place + 1, start + len(piece)
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in PIECES.split(", ")])

    keyed = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv_key"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").alias("turn_no"))
    dealt = keyed.repartitionByRange(partitions, "conv_key", "turn_no", "role", "text").sortWithinPartitions("conv_key", "turn_no", "role", "text")
    pieces = materialize(dealt.select("conv_key", "role", "text").mapInArrow(render, PIECES), "chat-pieces")
    edge = pieces.groupBy("part").agg(F.min("conv_key").alias("first"), F.max("conv_key").alias("last"))
    ends = pieces.groupBy("part", "conv_key").agg(F.max("place").alias("place"), F.sum("chars").alias("chars"))
    rows = ends.join(F.broadcast(edge), "part").where(F.col("conv_key") == F.col("last")).collect()
    carried, before = [], None
    for row in sorted(rows, key=lambda r: r.part):  # what earlier partitions hold of each one's first conversation
        place, chars = (before[1], before[2]) if before and before[0] == row.first else (0, 0)
        carried.append((row.part, row.first, place, chars))
        more = (place, chars) if row.first == row.last else (0, 0)
        before = row.last, more[0] + row.place + 1, more[1] + row.chars
    known = spark.createDataFrame(carried, "part int, first long, more_places long, more_chars long")
    joined = pieces.join(F.broadcast(known), "part")
    is_first = F.col("conv_key") == F.col("first")
    return joined.select(
        "conv_key",
        F.when(F.col("conv_key") != NULL_ID, F.col("conv_key")).alias("conv_id"),
        (F.col("place") + F.when(is_first, F.col("more_places")).otherwise(0)).alias("place"),
        F.col("role_kind").alias("role"),
        "piece",
        (F.col("start_in_part") + F.when(is_first, F.col("more_chars")).otherwise(0)).alias("start"),
        "chars",
        "loss_start",
        "loss_end",
    )


def expand(pieces: DataFrame) -> DataFrame:
    """One example for every assistant turn, as places in the transcript of its conversation."""
    replies = pieces.where(F.col("role") == "assistant")
    return replies.select(
        "conv_key", "conv_id", F.col("place").alias("target_place"), (F.col("start") + F.col("loss_start")).alias("context_end"), (F.col("start") + F.col("loss_start")).alias("loss_start"), (F.col("start") + F.col("loss_end")).alias("loss_end")
    )


def render_examples(pieces: DataFrame) -> DataFrame:
    """(conv_id, target_place, context, target) with all texts written out.

    The size of this grows with the square of a conversation's turns; conversations that
    are too long for that are better read by place.
    """
    replies = pieces.where(F.col("role") == "assistant").select(F.col("conv_key").alias("k"), F.col("place").alias("target_place"))
    parts = pieces.join(replies, (F.col("conv_key") == F.col("k")) & (F.col("place") <= F.col("target_place")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), "")
    span = F.max_by(F.struct((F.col("start") + F.col("loss_start")).alias("a"), (F.col("start") + F.col("loss_end")).alias("b")), "place")
    whole = parts.groupBy("conv_id", "target_place").agg(text.alias("t"), span.alias("s"))
    return whole.select("conv_id", "target_place", F.expr("substring(t, 1, int(s.a))").alias("context"), F.expr("substring(t, int(s.a) + 1, int(s.b - s.a))").alias("target"))


def digest(pieces: DataFrame, examples: DataFrame) -> DataFrame:
    """What the written output says of each conversation, read in order and unescaped.

    A conversation streams through one task, for a digest takes its text in order.
    """
    spans = examples.select(F.col("conv_key").alias("k"), F.col("target_place").alias("p"), F.col("loss_start").alias("a"), F.col("loss_end").alias("b"))
    masked = pieces.join(spans, (F.col("conv_key") == F.col("k")) & (F.col("place") == F.col("p")), "left")
    masked = masked.select("conv_key", "conv_id", "place", "piece", "chars", (F.col("a") - F.col("start")).alias("a"), (F.col("b") - F.col("start")).alias("b"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def done(rows: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        def row() -> tuple:
            return state[1], state[2], state[3].hexdigest(), state[4], state[5].hexdigest(), state[6]

        for batch in batches:
            rows = []
            for key, conv, piece, chars, a, b in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if state is None or state[0] != key:
                    if state is not None:
                        rows.append(row())
                    state = [key, conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(piece)
                state[2] += 1
                state[3].update(f"{role}\n{text}\n".encode())
                state[6] += chars
                if a is not None:
                    loss = unescape(piece[a:b])
                    state[4] += len(loss)
                    state[5].update(loss.encode())
            if rows:
                yield done(rows)
        if state is not None:
            yield done([row()])

    ordered = masked.repartition("conv_key").sortWithinPartitions("conv_key", "place")
    ordered = ordered.select("conv_key", "conv_id", "piece", "chars", "a", "b")
    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))
    pieces = materialize(format_conversations(turns), "chat-transcripts")
    return digest(pieces, materialize(expand(pieces), "chat-examples"))
