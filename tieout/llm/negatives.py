"""Hard-negative mining by a secondary-sort shuffle.

Vectors are dealt into blocks; every block of anchors meets every block of rows
once, and a task scores them by one matrix product. In a first round each block
keeps an anchor's best rows of its own label, whose merge gives the anchor's
positives. In a second round each block keeps, for every positive's window of
scores, its best rows of other labels. What is kept is packed into keys (anchor,
descending score, kind, id) as 25 bytes that sort as they stand, and
``repartitionAndSortWithinPartitions`` brings an anchor's keys into one partition
in order. An iterator reads that stream: a positive opens a window, a negative
goes to every open window that its score lies in, and a window closes once it is
full or the scores have fallen below it. At most five windows and their counters
are held; an anchor's candidates are never gathered.

What a block leaves out has so many better rows in that block that it could not be
among the first ones of the whole table, so nothing is lost.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.llm.stash import stash

SCALE = 256
#: Rows and anchors that one task scores.
ROWS, ANCHORS = 8192, 4096
#: Negatives score from PERCENT hundredths of the positive's score up to that score.
PERCENT = 80
_SIGN = 1 << 63
_ALL = (1 << 64) - 1
_POSITIVE, _NEGATIVE = 0, 1
_KEY = struct.Struct(">QQBQ")
_RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, label and ``code`` (integers floor(SCALE * x)) of the rows that take
    part: id, label and vector present, no component null or non-finite, not empty.
    Of rows that share a vec_id the one with the smallest label, then code, counts."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.struct(F.col("label").cast("bigint").alias("label"), F.transform(x, lambda v: F.floor(v * SCALE).cast("bigint")).alias("code")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.code")


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products [row, anchor] of integer matrices, exact; fails beyond 64 bits."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * max(1, rows.shape[1])
    if most < 2**53:
        return (rows.astype(np.float64) @ anchors.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("inner products beyond 64 bits")
    return rows @ anchors.T


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores in order, ties to the earlier place."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
        return at[np.argsort(-scores[at], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")[:k]


def block_positives(ids: np.ndarray, labels: np.ndarray, code: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray, a_code: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """(anchor, id, score) of each anchor's k best other rows of its label in a block; ids in order."""
    out = []
    for label in np.unique(a_labels):
        mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(a_labels == label)
        if not len(mine):
            continue
        s, near = products(code[mine], a_code[theirs]), ids[mine]
        for j, anchor in enumerate(a_ids[theirs]):
            other = np.flatnonzero(near != anchor)
            best = other[_first(s[other, j], k)]
            out.append((np.full(len(best), anchor), near[best], s[best, j]))
    return out


def block_negatives(ids: np.ndarray, labels: np.ndarray, code: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray, a_code: np.ndarray, tops: list[np.ndarray], k: int) -> list[tuple[np.ndarray, ...]]:
    """(anchor, id, score) of the rows of other labels that are among a block's k best of
    some window; ``tops`` has each anchor's positive scores. ids in order."""
    out = []
    s = products(code, a_code)
    for j, anchor in enumerate(a_ids):
        top = tops[j]
        column = s[:, j]
        at = np.flatnonzero((labels != a_labels[j]) & (column <= top.max()) & (100 * column >= PERCENT * top.min()))
        at = at[np.argsort(-column[at], kind="stable")]
        value = column[at]
        from_, to = np.searchsorted(-value, -top), np.searchsorted(-100 * value, -PERCENT * top, side="right")
        picked = np.unique(np.concatenate([np.arange(f, min(f + k, t)) for f, t in zip(from_, to)]))
        if len(picked):
            picked = picked.astype(np.int64)
            out.append((np.full(len(picked), anchor), ids[at[picked]], value[picked]))
    return out


def pack_keys(anchor: np.ndarray, score: np.ndarray, kind: np.ndarray | int, ids: np.ndarray) -> list[bytes]:
    """Keys whose byte order is (anchor, descending score, kind, id)."""
    key = np.empty(len(anchor), np.dtype([("a", ">u8"), ("s", ">u8"), ("k", "u1"), ("i", ">u8")]))
    key["a"], key["i"] = (x.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN) for x in (anchor, ids))
    key["s"] = ~(score.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN))
    key["k"] = kind
    raw = key.tobytes()
    return [raw[i : i + _KEY.size] for i in range(0, len(raw), _KEY.size)]


def unpack_key(key: bytes) -> tuple[int, int, int, int]:
    a, s, kind, i = _KEY.unpack(key)
    return a - _SIGN, (s ^ _ALL) - _SIGN, kind, i - _SIGN


def mined(keys: Iterator[bytes], positives: int, k: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Rows of the result from keys in order; holds the open windows of one anchor."""
    current, opened, windows = None, 0, []
    for key in keys:
        anchor, score, kind, number = unpack_key(key)
        if anchor != current:
            current, opened, windows = anchor, 0, []
        if kind == _POSITIVE:
            if opened < positives:
                opened += 1
                windows.append([number, score, 0])
            continue
        windows = [w for w in windows if w[2] < k and 100 * score >= PERCENT * w[1]]
        for window in windows:
            if score <= window[1]:
                window[2] += 1
                yield anchor, window[0], window[2], number, window[1], score


def _owner(key: bytes) -> int:
    """Spreads anchors over partitions whatever their ids have in common."""
    a = int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 & _ALL
    return a >> 33


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    ``vectors`` has vec_id, embedding and label; ``is_anchor`` is a condition on
    vec_id. A row's score is the inner product of the integer codes; higher
    scores come first, ties by smaller vec_id. An anchor's positives are its first
    rows of the same label with another id; a positive's negatives are the first rows of
    other labels that score from 80 hundredths of the positive's score up to it. A
    positive below 0 has no such score, one of 0 only those of 0.
    Rows without id or label, null and empty vectors and those with null or non-finite components
    take no part; rows that share a vec_id are one (``codes``); vectors meet those
    of their own length. Empty tables and anchors without positives give no rows."""
    spark = vectors.sparkSession
    index = stash(codes(vectors), "codes")
    anchors = index.where(is_anchor).select(*[F.col(c).alias(c) for c in index.columns])  # columns of their own
    blocks, groups = max(1, math.ceil(index.count() / ROWS)), max(1, math.ceil(anchors.count() / ANCHORS))
    number = F.xxhash64("vec_id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = index.withColumn("b", F.pmod(number, F.lit(blocks)).cast("int")).withColumn("g", every(groups))
    asked = anchors.withColumn("g", F.pmod(number, F.lit(groups)).cast("int")).withColumn("b", every(blocks))

    def sides(left: pa.Table, right: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, pa.Table, np.ndarray]]:
        """Both tables in the order of ids with their code matrices, for each length of vectors."""
        both = []
        for side in (left, right):
            side = side.take(np.argsort(side["vec_id"].to_numpy(), kind="stable"))
            lists = side["code"].combine_chunks()
            both.append((side, np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()))
        for dims in np.intersect1d(both[0][1], both[1][1]):
            out = []
            for side, size, values in both:
                at = np.flatnonzero(size == dims)
                begin = (np.cumsum(size) - size)[at]
                out += [side.take(at), values[begin[:, None] + np.arange(dims)]]
            yield tuple(out)

    def cell(left: pa.Table, right: pa.Table) -> tuple[list[tuple[np.ndarray, ...]], int]:
        """Packed candidates of a block of rows for a block of anchors."""
        out: list[tuple[np.ndarray, ...]] = []
        second = "tops" in right.schema.names
        for mine, code, theirs, a_code in sides(left, right):
            args = mine["vec_id"].to_numpy(), mine["label"].to_numpy(), code, theirs["vec_id"].to_numpy(), theirs["label"].to_numpy(), a_code
            out += block_negatives(*args, [np.array(t) for t in theirs["tops"].to_pylist()], negatives) if second else block_positives(*args, positives)
        return out, _NEGATIVE if second else _POSITIVE

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        out, _ = cell(left, right)
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor", "id", "score"])

    def packed(left: pa.Table, right: pa.Table) -> pa.Table:
        out, kind = cell(left, right)
        anchor, ids, score = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(pack_keys(anchor, score, kind, ids), pa.binary())], names=["key"])

    def met(asked: DataFrame):
        return rows.groupBy("b", "g").cogroup(asked.groupBy("b", "g"))

    near = met(asked).applyInArrow(found, "anchor bigint, id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    best = stash(near.withColumn("rank", rank).where(F.col("rank") <= positives), "positives")
    tops = best.groupBy(F.col("anchor").alias("vec_id")).agg(F.collect_list("score").alias("tops"))
    second = met(asked.join(tops, "vec_id")).applyInArrow(packed, "key binary")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, ids, score = (batch.column(c).to_numpy() for c in ("anchor", "id", "score"))
            yield pa.record_batch([pa.array(pack_keys(anchor, score, _POSITIVE, ids), pa.binary())], ["key"])

    opening = best.select("anchor", "id", "score").mapInArrow(keyed, "key binary")
    keys = opening.union(second).rdd.map(lambda r: (bytes(r[0]), None))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionAndSortWithinPartitions(parts, _owner)
    return spark.createDataFrame(ordered.mapPartitions(lambda stream: mined((key for key, _ in stream), positives, negatives)), _RESULT)
