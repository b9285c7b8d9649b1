"""Delimited files as records, where a quoted cell may hold line breaks.

A file is read as lines in the splits that Spark deals out. Where a split begins,
nobody knows yet whether that is inside a quoted cell. So a first pass takes every
line as a function of two states (outside or inside quotes) and composes them:
each split gives, for either start, the state it ends in and the records it
begins. A prefix over the splits of a file settles the starts and the row numbers;
it has a row per split, like the driver's own list of files. The second pass puts
lines together to records, in the order of the scan and without a shuffle. Only
records that cross into another split meet again by their number.

A quote opens a cell only at its beginning, doubled quotes stand for one, and text behind a
closing quote belongs to the cell, quotes included, as common readers do.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPLITS = "source_file string, block bigint, outside boolean, inside boolean, lines_o bigint, lines_i bigint, rows_o bigint, rows_i bigint"
_RECORDS = "source_file string, line_number bigint, row_number bigint, part bigint, whole boolean, record string"


def line_functions(lines: pa.Array, delimiter: str) -> tuple[np.ndarray, np.ndarray]:
    """For each line, whether it ends inside a quoted cell if it begins outside, and if it begins inside."""
    d = re.escape(delimiter)
    quoted, open_ = '"(?:[^"]|"")*"', '"(?:[^"]|"")*'
    rest = f'(?:[^"{d}][^{d}]*)?'
    cells = f'(?:(?:{quoted}{rest}|[^"{d}][^{d}]*)?{d})*'
    has = pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)
    outside, inside = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    at = np.flatnonzero(has)
    if len(at):
        some = lines.take(pa.array(at))
        outside[at] = pc.match_substring_regex(some, rf"\A{cells}{open_}\z").to_numpy(zero_copy_only=False)
        inside[at] = pc.match_substring_regex(some, rf'\A(?:[^"]|"")*(?:\z|"{rest}{d}{cells}{open_}\z)').to_numpy(zero_copy_only=False)
    return outside, inside


def states(outside: np.ndarray, inside: np.ndarray, start: bool) -> np.ndarray:
    """State after each line: that of the last line that forgets its start, turned
    by each line since that swaps the two."""
    n = np.arange(len(outside))
    last = np.maximum.accumulate(np.where(outside == inside, n, -1))
    swaps = np.cumsum(outside & ~inside)
    known = last >= 0
    base = np.where(known, outside[last], start)
    return base ^ ((swaps - np.where(known, swaps[last], 0)) % 2 == 1)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """line, source_file and block (the first byte of the split) in the order of the scan."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.make_valid_utf8("value").alias("line"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """Consecutive lines of one split: file, block and lines without their carriage returns and the file's byte-order mark."""
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks, files = batch.column("block").to_numpy(), batch.column("source_file").dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(files) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            lines = pc.replace_substring_regex(batch.column("line").slice(a, b - a), r"\r\z", "")
            if blocks[a] == 0:
                lines = pc.replace_substring_regex(lines, "\\A\ufeff", "")
            yield batch.column("source_file")[a].as_py(), int(blocks[a]), lines


def split_table(lines: DataFrame, delimiter: str) -> DataFrame:
    """A row per split: the state it ends in and the records it begins, blank ones
    counted in ``lines_*`` and not in ``rows_*``, for a start outside (o) and inside (i) quotes."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        for file, block, some in _runs(batches):
            total = found.setdefault((file, block), [False, True, 0, 0, 0, 0])
            outside, inside = line_functions(some, delimiter)
            filled = pc.not_equal(some, "").to_numpy(zero_copy_only=False)
            for i in (0, 1):
                after = states(outside, inside, total[i])
                begins = ~np.concatenate([[total[i]], after[:-1]])
                total[i] = bool(after[-1])
                total[2 + i] += int(begins.sum())
                total[4 + i] += int((begins & filled).sum())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(*k, *v) for k, v in found.items()]) if found else [[]] * 8, [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4])],
                                         ["source_file", "block", "outside", "inside", "lines_o", "lines_i", "rows_o", "rows_i"])

    return lines.mapInArrow(summed, _SPLITS)


def resolved(splits: list) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """For each split its start state and the numbers of its first record, with and without blank ones."""
    out: dict[tuple[str, int], tuple[bool, int, int]] = {}
    file, state, line, row = None, False, 0, 0
    for s in sorted(splits, key=lambda s: (s.source_file, s.block)):
        if s.source_file != file:
            file, state, line, row = s.source_file, False, 0, 0
        out[s.source_file, s.block] = state, line, row
        line, row = line + (s.lines_i if state else s.lines_o), row + (s.rows_i if state else s.rows_o)
        state = s.inside if state else s.outside
    return out


def _assembler(starts: dict[tuple[str, int], tuple[bool, int, int]], delimiter: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records of a scan. A piece of a record that begins in an earlier split, or
    goes on in a later one, has ``whole`` false and the number of its record."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    names = ["source_file", "line_number", "row_number", "part", "whole", "record"]

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, state, line, row, foreign = None, [], False, 0, 0, False

        def piece() -> pa.RecordBatch:
            """What is held at the end of a split: the beginning or the middle of a record."""
            return pa.record_batch([pa.array([x], t) for x, t in zip((*here[:1], line - 1, row - 1, here[1], False, "\n".join(held)), types)], names)

        for file, block, some in _runs(batches):
            if (file, block) != here:
                if held:
                    yield piece()
                if (file, block) not in starts:
                    raise RuntimeError(f"{file} was split in another way than when it was counted; read it again")
                here, held = (file, block), []
                state, line, row = starts[here]
                foreign = state
            outside, inside = line_functions(some, delimiter)
            after = states(outside, inside, state)
            begins = ~np.concatenate([[state], after[:-1]])
            ends = np.flatnonzero(~after)
            filled = pc.not_equal(some, "").to_numpy(zero_copy_only=False) & begins
            lines_at, rows_at = line + np.cumsum(begins) - 1, row + np.cumsum(filled) - 1
            if len(ends):
                first = np.concatenate([[0], ends[:-1] + 1])
                record = some.take(pa.array(ends))
                long = np.flatnonzero(first < ends)
                whole = np.ones(len(ends), bool)
                whole[0] = not foreign
                if len(long) or held:
                    texts = record.to_pylist()
                    for i in long:
                        texts[i] = "\n".join(some.slice(first[i], ends[i] - first[i] + 1).to_pylist())
                    if held:
                        texts[0] = "\n".join([*held, texts[0]])
                    record = pa.array(texts, pa.string())
                yield pa.record_batch([pa.repeat(file, len(ends)), pa.array(lines_at[ends]), pa.array(rows_at[ends]), pa.repeat(block, len(ends)).cast(pa.int64()), pa.array(whole), record.cast(pa.string())], names)
                held, foreign = some.slice(ends[-1] + 1).to_pylist(), False
            else:
                held += some.to_pylist()
            state = bool(after[-1])
            line, row = int(lines_at[-1]) + 1, int(rows_at[-1]) + 1
        if held:
            yield piece()

    return assembled


def read_records(spark: SparkSession, path: str | list[str], delimiter: str = ",") -> DataFrame:
    """source_file, line_number (0-based number of the record in its file),
    row_number (the same without blank lines; a blank line has that of the record
    before it) and ``record``, its text with inner line breaks as ``\\n``."""
    lines = _lines(spark, path)
    splits = split_table(lines, delimiter).collect()  # a row per split
    starts = resolved(splits)
    found = lines.mapInArrow(_assembler(starts, delimiter), _RECORDS)
    names = ["source_file", "line_number", "row_number", "record"]
    broken = {f for (f, _), s in starts.items() if s[0]} | {s.source_file for s in splits if (s.inside if starts[s.source_file, s.block][0] else s.outside)}
    records = found.where("whole").select(*names)
    if broken:  # some records cross splits: their files are read once more for the pieces
        again = found.where(F.col("source_file").isin(sorted(broken)) if len(broken) < 1000 else F.lit(True)).where("not whole")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "record"))), lambda p: p.record), "\n")
        records = records.union(again.groupBy("source_file", "line_number", "row_number").agg(joined.alias("record")).select(*names))
    return records


def header_names(record: str, delimiter: str = ",") -> list[str]:
    """Column names of a header record: a blank cell is named after its position, a
    name that repeats gets a number."""
    cells = next(csv.reader(io.StringIO(record, newline=""), delimiter=delimiter), [])
    out: list[str] = []
    for i, cell in enumerate(cells):
        name, n = cell or f"_c{i}", 0
        while name in out:
            n += 1
            name = f"{cell}.{n}"
        out.append(name)
    return out


def cells(record: str, width: int, delimiter: str = ","):
    """The first ``width`` cells of a record as an array, '' where it has fewer."""
    schema = ", ".join(f"c{i} string" for i in range(max(width, 1)))
    parsed = F.from_csv(record, schema, {"sep": delimiter, "escape": '"', "quote": '"'})
    return F.array(*[F.coalesce(parsed[f"c{i}"], F.lit("")) for i in range(max(width, 1))])
