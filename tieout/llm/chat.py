"""Chat formatting by columnar byte assembly.

The turns of a conversation become one text. Each turn is

    <s> role \\n text </s>          for trained roles (their text is under the loss mask)
    [INST] role \\n text [/INST]    for all others

without blanks around the marks. Inside roles and texts a backslash is doubled,
a control string gets a backslash after its first character, and a line break in
a role is preceded by one: no control string ever stands in a text, and dropping
each backslash before its next character restores the original.

Turns are dealt by ranges of (conv_id, turn), so a very long conversation is
spread over tasks and comes out as numbered pieces. A task writes all headers,
texts and ends of a batch into one preallocated buffer at positions computed
from cumulative lengths; rows of the result are slices of that buffer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm import columnar as col

#: The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TRAINED = ("assistant",)
_MARK = re.compile(b"|".join(re.escape(c.encode()) for c in CONTROL))
_HEAD = re.compile(rb"(?:[^\\\n]|\\.)*", re.S)
_SHAPE = "conv_id bigint, piece long, n_turns int, formatted binary, loss array<struct<start:bigint,stop:bigint>>"


def escape(texts: pa.Array, role: bool = False) -> pa.Array:
    out = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\\", "\\\\")
    for c in CONTROL:
        out = pc.replace_substring(out, c, f"{c[0]}\\{c[1:]}")
    return pc.replace_substring(out, "\n", "\\\n") if role else out


def unescape(text: bytes) -> bytes:
    return re.sub(rb"\\(.)", rb"\1", text, flags=re.S)


def assemble(role: pa.Array, text: pa.Array, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns in one buffer, where each turn begins (one entry more
    than turns), and where each text begins (its end is ``end of turn - mark``)."""
    kinds = (("[INST]", "[/INST]"), ("<s>", "</s>"))
    marks = np.frombuffer("".join(a + b for a, b in kinds).encode() + b"\n", np.uint8)
    width = np.array([[len(a), len(b)] for a, b in kinds])
    place = np.array([[0, 6], [13, 16]])
    roles, role_at = col.flat(escape(role, role=True))
    texts, text_at = col.flat(escape(text))
    kind = trained.astype(np.int64)
    n = len(kind)
    source = np.concatenate([marks, roles, texts])
    # five segments a turn: mark, role, line break, text, mark
    start = np.stack([place[kind, 0], role_at[:-1] + len(marks), np.full(n, len(marks) - 1), text_at[:-1] + len(marks) + len(roles), place[kind, 1]], axis=1).ravel()
    size = np.stack([width[kind, 0], np.diff(role_at), np.ones(n, np.int64), np.diff(text_at), width[kind, 1]], axis=1).ravel()
    buffer, edges = col.gather(source, start, size)
    return buffer, edges[::5], edges[3::5][:n]


def format_conversations(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, piece, n_turns, formatted, loss): the conversation is its pieces
    in order; ``loss`` holds the byte ranges of a piece under the loss mask.

    Turns are ordered by turn, then role, then text; nulls come first, a null role
    or text counts as empty, and null conv_ids form one conversation. Repeated
    rows are repeated turns.
    """
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    order = ["conv_id", "turn", "role", "text"]

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in col.pieces(batches, "role", "text"):
            trained = pc.is_in(batch.column("role"), pa.array(TRAINED)).to_numpy(zero_copy_only=False)
            buffer, turn_at, text_at = assemble(batch.column("role"), batch.column("text"), trained)
            # null ids are their own conversation: compare values and nulls
            ids = batch.column("conv_id")
            same = np.stack([ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)])
            first = np.flatnonzero(np.concatenate([[True], (same[:, 1:] != same[:, :-1]).any(axis=0)]))
            last = np.append(first[1:], batch.num_rows)
            spans = [[{"start": int(text_at[i] - turn_at[a]), "stop": int(turn_at[i + 1] - len("</s>") - turn_at[a])} for i in range(a, b) if trained[i]] for a, b in zip(first, last)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.record_batch(
                [ids.take(pa.array(first)), pa.array(count + np.arange(len(first))), pa.array((last - first).astype(np.int32)), col.take_spans(buffer, turn_at[first], turn_at[last]), pa.array(spans, kind)],
                ["conv_id", "piece", "n_turns", "formatted", "loss"])
            count += len(first)

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # ranges ascend with the partition number, pieces within it
    pieces = ranged.mapInArrow(formatted, _SHAPE)
    return pieces.withColumn("piece", F.shiftleft(F.spark_partition_id().cast("bigint"), 40) + F.col("piece"))


def read_back(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Roles and texts of a formatted piece, restored."""
    out = []
    marks = [(m.start(), m.end()) for m in _MARK.finditer(formatted)]
    for (_, a), (b, _) in zip(marks[::2], marks[1::2]):
        head = _HEAD.match(formatted, a, b).end()
        out.append((unescape(formatted[a:head]), unescape(formatted[head + 1 : b])))
    return out


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted pieces: conv_id, n_turns,
    turns_sha256 (of role, line break, text, line break per turn), loss_chars,
    loss_sha256 and formatted_chars. Pieces stream through in order; a
    conversation costs its hash states, not its length."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state, done = None, []

        def out(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        def closed(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for batch in batches:
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(closed(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in read_back(text):
                    state[1] += 1
                    state[2].update(role + b"\n" + body + b"\n")
                for span in spans:
                    body = unescape(text[span["start"] : span["stop"]])
                    state[3] += len(body.decode())
                    state[4].update(body)
                state[5] += len(text.decode())
            if len(done) > 1000:
                yield out(done)
                done = []
        if state is not None:
            yield out([*done, closed(state)])

    shape = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    rows = pieces.select("conv_id", "piece", "formatted", "loss")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(folded, shape)
