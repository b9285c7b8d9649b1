"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes when some string of ``LENGTH`` bytes around it also starts earlier in
the corpus (smaller doc_id, or earlier in the document). Suffixes are sorted, and
for each one the nearest suffixes before and after it in that order that start
earlier in the corpus (previous and next smaller positions) hold its longest
earlier match; where that match is long enough, the suffix is a later copy.

Sorting every suffix of a corpus in one place is neither possible nor needed:

* Every window of LENGTH bytes has an anchor, the 24-byte gram of smallest hash
  in it. Equal windows have equal anchors, so only the neighbourhoods of anchors
  that occur twice can hold repeats (counted over the whole corpus with map-side
  sums).
* The text around such an anchor that holds all windows it is the anchor of is a
  segment. Segments meet by anchor hash; equal segments are folded, and the
  suffixes of the rest are sorted and searched in batches of whole groups.
* A group with many segments is split by document. Each part removes its own
  later copies; the windows it could not match inside go on to a second step
  that aggregates them by digest over all parts, so the answer does not depend
  on the split.

Copies of whole texts need no segments and are settled by their digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tieout.llm import columnar as col
from tieout.llm.stash import id_key, stash, text_key

LENGTH = 100
GRAM = 24
#: Segments of an anchor that are searched together.
GROUP = 2048
#: Segments of a batch of whole groups.
BATCH = 2048


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, byte position (in ``data``), first and last window start of each anchor."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4
    grams = n - GRAM + 1
    start = np.arange(grams)
    gram = col.grams(data, GRAM // 8)
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | start.astype(np.uint64)
    width, need = 1, LENGTH - GRAM + 1
    while 2 * width <= need:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: grams - need + 1], least[need - width :])
    inside = np.zeros(n + 1, np.int8)
    sizes = np.diff(offsets)
    big = sizes >= LENGTH
    np.add.at(inside, offsets[:-1][big], 1)
    np.add.at(inside, offsets[1:][big] - LENGTH + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[: len(least)]) > 0)
    at = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
    last = np.concatenate([new[1:], [len(at)]]) - 1 if len(at) else at
    place = at[new]
    return gram[place], np.searchsorted(offsets, place, side="right") - 1, place, window[new], window[last]


def smaller_neighbours(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest earlier and the nearest later entry with a smaller value; -1 and len where there is none."""
    n = len(rank)
    guarded = np.concatenate([[-1], rank, [-1]])  # sentinels at both ends
    out = []
    for step in (-1, 1):
        near = np.arange(n + 2) + step
        near[0], near[-1] = 0, n + 1
        while True:
            open_ = (guarded[near] > guarded) & (near != np.arange(n + 2))
            if not open_.any():
                break
            near[open_] = near[near[open_]]
        out.append(near[1:-1] - 1)
    return out[0], out[1]


def later_copies(windows: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which rows of ``windows`` (one suffix each, LENGTH bytes) occur with a smaller ``rank`` too.
    Ranks are distinct. In suffix order, the common prefix with the nearest
    smaller position on either side is the longest earlier match."""
    # byte 0 would be cut off at the end of a fixed-width string; UTF-8 never holds 0xFF
    order = np.argsort(np.where(windows == 0, np.uint8(0xFF), windows).view(f"S{LENGTH}").ravel(), kind="stable")
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (windows[order[1:]] == windows[order[:-1]]).all(axis=1)
    run = np.cumsum(~same[:-1])  # suffixes whose neighbours share LENGTH bytes are of one run
    before, after = smaller_neighbours(rank[order])
    reach = np.concatenate([run, [-1]])
    copy = np.zeros(len(order), bool)
    copy[order] = (reach[before] == run) & (before >= 0) | (reach[np.minimum(after, len(order))] == run)
    return copy


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in col.pieces(batches, "text"):
            data, offsets = col.flat(batch.column("text"))
            gram, owner, place, _, _ = anchors(data, offsets)
            d, t = (batch.column(c).to_numpy() for c in "dt")
            yield pa.record_batch([pa.array(gram.view(np.int64)), pa.array(d[owner]), pa.array(t[owner]), pa.array((place - offsets[owner]).astype(np.int32))], ["h", "d", "t", "at"])

    return docs.select("d", "t", "text").mapInArrow(found, "h bigint, d bigint, t int, at int")


def _segments(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """A row for each anchor in ``hits`` (d, t, hits: array of (at, parts)): its hash, part, place and text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in col.pieces(batches, "text"):
            data, offsets = col.flat(batch.column("text"))
            gram, owner, place, first, last = anchors(data, offsets)
            lists = batch.column("hits")
            inner = lists.flatten()
            whose = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            wanted = offsets[whose] + inner.field("at").to_numpy()
            got = np.searchsorted(place, wanted)
            d, t = batch.column("d").to_numpy(), batch.column("t").to_numpy()
            parts = inner.field("parts").to_numpy()
            part = (col.mix(d[whose].view(np.uint64) ^ np.uint64(0x5BD1E995)) % parts.astype(np.uint64)).astype(np.int32)
            a, b = first[got], last[got] + LENGTH
            text = col.take_spans(data, a, b)
            yield pa.record_batch([pa.array(gram[got].view(np.int64)), pa.array(part), pa.array(parts), pa.array(d[whose]), pa.array(t[whose]), pa.array((a - offsets[whose]).astype(np.int32)), text],
                                  ["h", "part", "parts", "d", "t", "at", "segment"])

    shape = "h bigint, part int, parts int, d bigint, t int, at int, segment binary"
    return docs.join(hits, ["d", "t"]).select("d", "t", "text", "hits").mapInArrow(cut, shape)


FOUND = pa.schema([("d", pa.int64()), ("t", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("window", pa.binary())])


def search(rows: pa.Table) -> pa.RecordBatch:
    """Later copies among the segments of whole groups (or parts of groups).

    Gives removed spans, and for parts of a split group each window without an
    earlier match here (``window`` is then its digest and stop is null)."""
    data, offsets = col.flat(rows["segment"])
    d, t, at, h = (rows[c].to_numpy() for c in ("d", "t", "at", "h"))
    size = np.diff(offsets)
    seg = col.Hasher(data)(offsets[:-1], offsets[1:])
    order = np.lexsort((at, t, d, seg, h))
    d, t, at, h, seg, size, start = (x[order] for x in (d, t, at, h, seg, size, offsets[:-1]))
    split = rows["parts"].to_numpy()[order] > 1
    like = np.zeros(len(order), bool)
    like[1:] = (seg[1:] == seg[:-1]) & (h[1:] == h[:-1]) & (size[1:] == size[:-1])
    twin = np.flatnonzero(like)  # equal hashes: the bytes decide
    (mine, edge), (theirs, _) = (col.gather(data, start[x], size[x]) for x in (twin, twin - 1))
    like[twin] = np.add.reduceat(np.append(mine != theirs, False).astype(np.int64), edge[:-1]) == 0 if len(twin) else False
    again = np.zeros(len(order), bool)  # the same place once more: a repeated row
    again[1:] = like[1:] & (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (at[1:] == at[:-1])
    head = np.maximum.accumulate(np.where(like, 0, np.arange(len(order))))
    # at the head's own place again: not a later copy
    whole = like & ~((d == d[head]) & (t == t[head]) & (at == at[head]))
    spans = [(d[whole], t[whole], at[whole], at[whole] + size[whole])]
    group = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
    heads = ~like
    many = np.bincount(group[heads], minlength=group[-1] + 1)[group] > 1
    pick = np.flatnonzero(heads & (many | split))
    fresh: tuple = (d[:0], t[:0], at[:0], [])
    if len(pick):
        count = size[pick] - LENGTH + 1
        owner = np.repeat(pick, count)
        ends = np.cumsum(count)
        step = np.arange(ends[-1]) - np.repeat(ends - count, count)
        windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[start[owner] + step]
        place = np.lexsort((at[owner] + step, t[owner], d[owner]))
        rank = np.empty(len(place), np.int64)
        rank[place] = np.arange(len(place))
        copy = later_copies(windows, rank)
        spans.append((d[owner[copy]], t[owner[copy]], at[owner[copy]] + step[copy], at[owner[copy]] + step[copy] + LENGTH))
        rest = np.flatnonzero(~copy & split[owner])
        fresh = (d[owner[rest]], t[owner[rest]], at[owner[rest]] + step[rest], [hashlib.blake2b(windows[i].tobytes(), digest_size=16).digest() for i in rest])
    d, t, a, b = (np.concatenate(x) for x in zip(*spans))
    order = np.lexsort((a, t, d))
    d, t, a, b = d[order], t[order], a[order], b[order]
    if len(d):  # touching spans of a document become one
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
        doc = np.cumsum(new)
        lead = np.maximum.accumulate(b + doc * (1 << 32))
        new[1:] |= a[1:] + doc[1:] * (1 << 32) > lead[:-1]
        at_new = np.flatnonzero(new)
        b = np.maximum.reduceat(b, at_new)
        d, t, a = d[at_new], t[at_new], a[at_new]
    n, m = len(d), len(fresh[3])
    columns = [np.concatenate([d, fresh[0]]).astype(np.int64), np.concatenate([t, fresh[1]]).astype(np.int32), np.concatenate([a, fresh[2]]).astype(np.int32)]
    return pa.record_batch([*map(pa.array, columns), pa.array([*b.tolist(), *[None] * m], pa.int32()), pa.array([*[None] * n, *fresh[3]], pa.binary())], schema=FOUND)


def _searched(segments: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in ("h", "part")]
            edges = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1
            if held and (key[0][0], key[1][0]) != (held[-1].column("h")[-1].as_py(), held[-1].column("part")[-1].as_py()):
                edges = np.concatenate([[0], edges])
            done = 0
            for cut in edges:
                if rows + cut - done >= BATCH:
                    held.append(batch.slice(done, cut - done))
                    yield search(pa.Table.from_batches(held))
                    held, rows, done = [], 0, cut
            held.append(batch.slice(done))
            rows += batch.num_rows - done
        if rows:
            yield search(pa.Table.from_batches(held))

    return segments.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(run, "d bigint, t int, start int, stop int, window binary")


def removed_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removed byte spans (d, t, spans) and the keys (d, t) of texts that repeat an
    earlier document's whole text. ``docs`` has d, t and text (no null)."""
    digest = docs.where(F.octet_length("text") >= LENGTH).select("d", "t", F.unhex(F.sha2("text", 256)).alias("digest"))
    first = digest.groupBy("digest").agg(F.min(F.struct("d", "t")).alias("first"))
    copies = stash(digest.join(first, "digest").where(F.struct("d", "t") != F.col("first")).select("d", "t").distinct(), "copies")
    marks = _anchor_rows(docs)
    twice = marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.ceil(F.col("n") / GROUP).cast("int").alias("parts"))
    twice = stash(twice, "twice")  # read back, so that the join below can split a frequent anchor over tasks
    hits = marks.join(twice, "h").join(copies, ["d", "t"], "left_anti").groupBy("d", "t").agg(F.collect_set(F.struct("at", "parts")).alias("hits"))
    found = stash(_searched(_segments(docs, hits)), "copies")
    fresh = found.where("window is not null").select("window", "d", "t", "start")
    least = fresh.groupBy("window").agg(F.min(F.struct("d", "t", "start")).alias("least"), F.count("*").alias("n")).where("n > 1")
    late = fresh.join(least, "window").where(F.struct("d", "t", "start") != F.col("least"))
    spans = found.where("window is null").select("d", "t", "start", "stop").union(late.select("d", "t", "start", F.col("start") + LENGTH))
    return spans.groupBy("d", "t").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), copies


def merged(spans: np.ndarray, size: int) -> np.ndarray:
    """Spans (start, stop) as maximal runs in order."""
    if not len(spans):
        return spans.reshape(0, 2)
    depth = np.zeros(size + 1, np.int64)
    np.add.at(depth, spans[:, 0], 1)
    np.add.at(depth, spans[:, 1], -1)
    on = np.concatenate([[False], np.cumsum(depth[:-1]) > 0, [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return edge.reshape(-1, 2)


def without_repeats(docs: DataFrame, whole_characters: bool = False) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and more) as ``row``, with ``spans``, the
    removed byte ranges as an array of (start, stop), and ``kept``, the bytes that
    stay. With ``whole_characters`` spans shrink to character borders, so that
    ``kept`` is valid UTF-8.

    A null text counts as empty and a null doc_id as the smallest id. Rows that
    repeat doc_id and text are one document, and each shows its result; rows that
    share a doc_id with different texts are documents ordered by text hash.
    """
    # the text hash tells rows apart that share a doc_id; where none do, it is left out of all shuffles
    shared = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    keyed = docs.select(id_key().cast("bigint").alias("d"), (text_key() if shared else F.lit(0)).alias("t"), F.coalesce("text", F.lit("")).alias("text"), F.struct("*").alias("row"))
    spans, copies = removed_spans(keyed.select("d", "t", "text"))
    found = keyed.join(spans, ["d", "t"], "left").join(copies.withColumn("copy", F.lit(True)), ["d", "t"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in col.pieces(batches, "text"):
            data, offsets = col.flat(batch.column("text"))
            lead = (data & 0xC0) != 0x80
            lists, copy = batch.column("spans").fill_null([]), batch.column("copy").fill_null(False).to_numpy(zero_copy_only=False)
            inner, edges = lists.flatten(), lists.offsets.to_numpy()
            pairs = np.stack([inner.field("start").to_numpy(), inner.field("stop").to_numpy()], axis=1).astype(np.int64)
            edges = edges - edges[0]
            out, kept = [], []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                runs = np.array([[0, len(text)]]) if copy[i] else merged(pairs[edges[i] : edges[i + 1]], len(text))
                if whole_characters and len(runs):
                    border = np.concatenate([np.flatnonzero(lead[offsets[i] : offsets[i + 1]]), [len(text)]])
                    runs = np.stack([border[np.searchsorted(border, runs[:, 0])], border[np.searchsorted(border, runs[:, 1], side="right") - 1]], axis=1)
                    runs = runs[runs[:, 0] < runs[:, 1]]
                stay = np.ones(len(text), bool)
                for a, b in runs:
                    stay[a:b] = False
                kept.append(text[stay].tobytes())
                out.append([{"start": a, "stop": b} for a, b in runs.tolist()])
            shape = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.record_batch([batch.column("row"), pa.array(out, shape), pa.array(kept, pa.binary())], ["row", "spans", "kept"])

    shape = StructType([keyed.schema["row"], *StructType.fromDDL("spans array<struct<start:bigint,stop:bigint>>, kept binary").fields])
    return found.select("row", "text", "spans", "copy").mapInArrow(cut, shape)
