"""Exact top-k inner products on a bit-sliced index.

Every component becomes the integer floor(SCALE * x). A block of vectors is kept
as bitmaps: slice j of attribute d has one bit per vector, bit j of the shifted
value. A query's scores against a whole block come from bitmap arithmetic: for
each bit of the query's weights, from the highest down, the running sum is
doubled and the slices of the attributes with that bit are added by ripple
carry. (A negative weight takes the complement of the slices, so every addend is
positive; the constant this adds is subtracted at the end.) The k best rows are
then found from the highest slice of the sums downward, and rows that tie at the
boundary are settled by vector id.

Blocks of the index and blocks of queries are rows of two tables; every query
block visits every index block by an equi-join on its number, and only each
block's k best scores leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.llm.stash import stash

SCALE = 1024
#: Vectors of an index block, queries of a query block, and copies of a query block that share its visits.
ROWS, QUERIES, SPREAD = 32768, 64, 24
U64 = np.uint64


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id and ``code``, the integer components. Vectors without an id, null
    or empty vectors and vectors that hold a null or a non-finite component are left out;
    repeated rows (equal id and code) count once."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v * SCALE).cast("bigint")).alias("code"))
    return rows.distinct()


def pack(ids: np.ndarray, code: np.ndarray) -> tuple[bytes, bytes, np.ndarray]:
    """Vector ids in order, bitmaps [attribute][slice][word] and (low, slices) of a block."""
    order = np.lexsort((*code.T[::-1], ids))
    ids, code = ids[order], code[order]
    low = int(code.min()) if code.size else 0
    slices = max(1, (int(code.max()) - low).bit_length()) if code.size else 1
    shifted = (code - low).astype(U64)
    words = -(-len(ids) // 64)
    bits = np.zeros((code.shape[1], slices, words * 64), np.uint8)
    for j in range(slices):
        bits[:, j, : len(ids)] = ((shifted >> U64(j)) & U64(1)).astype(np.uint8).T
    return ids.tobytes(), np.packbits(bits, axis=2, bitorder="little").tobytes(), np.array([low, slices, len(ids), code.shape[1]])


def _add(total: list[np.ndarray], slices: np.ndarray) -> None:
    """total += slices, numbers in bit slices; the carry stops where nothing is left of it."""
    carry = None
    for j in range(len(total)):
        if j < len(slices):
            a, b = total[j], slices[j]
            half = a ^ b
            total[j], carry = (half, a & b) if carry is None else (half ^ carry, (a & b) | (half & carry))
        elif carry is None or not carry.any():
            return
        else:
            total[j], carry = total[j] ^ carry, total[j] & carry
    if carry is not None and carry.any():
        total.append(carry)


def scores(query: np.ndarray, slices: np.ndarray, low: int) -> tuple[list[np.ndarray], int]:
    """Bit slices of the query's scores against a block, and what to add to each."""
    width = slices.shape[1]
    mask = (1 << width) - 1
    size = np.abs(query)
    # x = shifted + low; for a negative weight -|q| * shifted = |q| * (mask - shifted) - |q| * mask
    offset = int(query.sum()) * low - int(size[query < 0].sum()) * mask
    terms = [~slices[d] if query[d] < 0 else slices[d] for d in range(len(query))]
    total: list[np.ndarray] = []
    for bit in range(int(size.max()).bit_length() - 1 if len(size) else -1, -1, -1):
        if total:
            total.insert(0, np.zeros_like(total[0]))
        for d in np.flatnonzero((size >> bit) & 1):
            if not total:
                total = [t.copy() for t in terms[d]]
            else:
                while len(total) < width:
                    total.append(np.zeros_like(total[0]))
                _add(total, terms[d])
    return total, offset


def best(total: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest sums among ``rows`` (a bitmap), with all that tie at the boundary."""
    sure, tied = np.zeros_like(rows), rows
    for plane in reversed(total):
        more = tied & plane
        with_more = sure | more
        n = int(np.bitwise_count(with_more).sum())
        if n > k:
            tied = more
        else:
            sure, tied = with_more, tied & ~plane
            if n == k:
                tied = np.zeros_like(rows)
                break
    return np.flatnonzero(np.unpackbits((sure | tied).view(np.uint8), bitorder="little"))


def search_block(ids: np.ndarray, slices: np.ndarray, low: int, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the block's k best rows for a query (not itself), ties to smaller ids."""
    n = len(ids)
    bits = np.zeros(slices.shape[2] * 64, np.uint8)
    bits[:n] = ids != query_id
    rows = np.packbits(bits, bitorder="little").view(U64)
    total, offset = scores(query, slices, low)
    at = best(total, rows, k)
    value = np.full(len(at), offset, np.int64)
    for j, plane in enumerate(total):
        value += ((plane[at >> 6] >> (at & 63).astype(U64)) & U64(1)).astype(np.int64) << j
    order = np.lexsort((ids[at], -value))[:k]
    return ids[at[order]], value[order]


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best vectors with
    another id; all, if there are fewer. ``is_query`` is a condition on vec_id.
    Vectors only meet queries with the same number of components. Rows that share
    an id with different vectors are all searched, as queries and as candidates."""
    index = stash(codes(vectors), "codes")
    asked = index.where(is_query)
    n = max(1, math.ceil(asked.count() / QUERIES))

    def sliced(group: pa.Table) -> pa.Table:
        ids, lists = group["vec_id"].to_numpy(), group["code"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        values = lists.flatten().to_numpy()
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        rows = []
        for dims in np.unique(size):
            mine = np.flatnonzero(size == dims)
            code = values[begin[mine][:, None] + np.arange(dims)].reshape(len(mine), dims)
            a, b, meta = pack(ids[mine], code)
            rows.append((a, b, *map(int, meta), int(group["part"][0].as_py()) % SPREAD))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.int32()))], names=["ids", "bits", "low", "slices", "rows", "dims", "spread"])

    parts = max(1, math.ceil(index.count() / ROWS))
    parted = index.withColumn("part", F.pmod(F.xxhash64("vec_id", "code"), F.lit(parts)))
    blocks = parted.groupBy("part").applyInArrow(sliced, "ids binary, bits binary, low bigint, slices bigint, rows bigint, dims bigint, spread int")
    visits = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    questions = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "code"), F.lit(n)).cast("int"))
    questions = questions.groupBy("block").agg(F.collect_list(F.struct(F.col("vec_id").alias("q"), "code")).alias("queries"))
    questions = questions.withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                n_rows, dims, width = (row[c].as_py() for c in ("rows", "dims", "slices"))
                ids = np.frombuffer(row["ids"].as_py(), np.int64)
                slices = np.frombuffer(row["bits"].as_py(), U64).reshape(dims, width, -1)
                out: list[tuple[np.ndarray, ...]] = []
                for number, query in enumerate(row["queries"].as_py()):
                    if len(query["code"]) == dims and n_rows:
                        found, value = search_block(ids, slices, row["low"].as_py(), query["q"], np.array(query["code"], np.int64), k)
                        out.append((np.full(len(found), query["q"]), np.full(len(found), number), found, value))
                if out:
                    q, number, found, value = (np.concatenate(x) for x in zip(*out))
                    yield pa.record_batch([pa.repeat(row["block"], len(q)), pa.array(q), pa.array(number), pa.array(found), pa.array(value)], ["block", "query_id", "number", "vec_id", "score"])

    pairs = visits.join(questions, ["block", "spread"]).select("block", "ids", "bits", "low", "slices", "rows", "dims", "queries")
    hits = pairs.mapInArrow(met, "block int, query_id bigint, number bigint, vec_id bigint, score bigint")
    order = W.partitionBy("query_id", "block", "number").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
