"""One-to-one matching of two tables on amount (sign ignored) and date.

Result of the reference rule: rows are taken in file order, each left row takes
the first free right row that qualifies; same-date partners in a first pass,
partners within the date tolerance in a second one.

Inputs have ``row_index`` (bigint, unique, file order), ``amount``, ``txn_date``.
Rows are handled by *cell* - all rows of one side with the same magnitude and
date - because inside a cell rows are used up strictly in file order. Nothing
here ever lists the pairs of a cell.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tieout.operators.bands import Band, band_join
from tieout.operators.ordered import CHUNK_ROWS, chunk_of, numbered, running
from tieout.session import cut_lineage

#: Rows of both sides that one tile holds, but for those that its rows reach beyond it.
GROUP_ROWS = 1_000_000
#: A cell of the grid with more rows is no work for one task: rounds instead. A date with more is cut.
HOT_ROWS = 2_000_000
#: Size of a cell, in tolerances.
TILE_REACH = 8
#: Cells along the amounts that one chunk of the numbering spans.
CHAIN_CHUNK = 10_000
PAIR_COLUMNS = ["left_index", "right_index", "left_amount", "right_amount", "left_date", "right_date", "match_kind"]


def candidates(df: DataFrame) -> DataFrame:
    """Rows that can match at all, with their magnitude."""
    return (df.select("row_index", "amount", "txn_date", F.abs("amount").alias("mag"))
            .where(F.col("mag").isNotNull() & F.col("txn_date").isNotNull()))


def _pairs(l: DataFrame, r: DataFrame, keys: list[str]) -> DataFrame:
    left = l.select(*keys, F.col("row_index").alias("left_index"), F.col("amount").alias("left_amount"),
                    F.col("txn_date").alias("left_date"))
    right = r.select(*keys, F.col("row_index").alias("right_index"), F.col("amount").alias("right_amount"),
                     F.col("txn_date").alias("right_date"))
    kind = F.when(F.col("left_date") == F.col("right_date"), "exact").otherwise("timing")
    return left.join(right, keys).withColumn("match_kind", kind).select(*PAIR_COLUMNS)


def exact_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Same magnitude, same date: the k-th row of a cell meets the k-th row of
    the other side's cell, so the pass is one equi-join on (cell, position).
    The position is part of the key, so even one huge cell spreads evenly."""
    l, r = [numbered(candidates(df).withColumn("cell_date", F.col("txn_date")), ["mag", "cell_date"],
                     ["row_index"], chunk_of("row_index")) for df in (left, right)]
    return _pairs(l, r, ["mag", "cell_date", "rn"])


def _unused(df: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    used = pairs.select(F.col(f"{side}_index").alias("row_index"))
    return df.join(used, "row_index", "left_anti")


def _cell_graph(left: DataFrame, right: DataFrame, amount_tol: Decimal, days: int) -> DataFrame:
    """Which left cells may match which right cells."""
    lc = left.select(F.col("mag").alias("l_mag"), F.col("txn_date").alias("l_date")).distinct()
    rc = right.select(F.col("mag").alias("r_mag"), F.col("txn_date").alias("r_date")).distinct()
    return band_join(lc, rc, [], [Band("l_mag", "r_mag", amount_tol), Band("l_date", "r_date", days)])


def _edges(left: DataFrame, right: DataFrame, graph: DataFrame) -> DataFrame:
    """Cells that may still match, with the first free row of either side."""
    lh = left.groupBy(F.col("mag").alias("l_mag"), F.col("txn_date").alias("l_date")).agg(F.min("row_index").alias("l_head"))
    rh = right.groupBy(F.col("mag").alias("r_mag"), F.col("txn_date").alias("r_date")).agg(F.min("row_index").alias("r_head"))
    return graph.join(lh, ["l_mag", "l_date"]).join(rh, ["r_mag", "r_date"])


def _round(left: DataFrame, right: DataFrame, edges: DataFrame, one_chunk: bool, hub: str) -> DataFrame:
    """Pairs that are certain now, found around the cells of side ``hub`` (l or r).

    A cell's members are the cells opposite that want its first free row before
    that of any other cell. Their rows, merged in file order, take the hub's rows one after
    another, as long as no cell opposite that is not a member has an earlier row,
    and no other cell offers a member an earlier row. So cells whose rows
    alternate in the file are settled together in one round.
    """
    rim = "r" if hub == "l" else "l"
    spoke = W.partitionBy(f"{rim}_mag", f"{rim}_date").orderBy(f"{hub}_head")
    ranked = edges.withColumn("_n", F.row_number().over(spoke)).withColumn("_next", F.lead(f"{hub}_head").over(spoke))
    member = F.col("_n") == 1
    stars = ranked.groupBy(f"{hub}_mag", f"{hub}_date", F.col(f"{hub}_head").alias("run")).agg(
        F.min(F.when(~member, F.col(f"{rim}_head"))).alias("rim_limit"), F.min(F.when(member, F.col("_next"))).alias("hub_limit"), F.max(member).alias("any")).where("any")
    members = ranked.where(member).join(stars.select(F.col("run").alias(f"{hub}_head"), "rim_limit"), f"{hub}_head")
    hubs = stars.select(F.col(f"{hub}_mag").alias("mag"), F.col(f"{hub}_date").alias("txn_date"), F.col("hub_limit").alias("limit"), "run")
    rims = members.select(F.col(f"{rim}_mag").alias("mag"), F.col(f"{rim}_date").alias("txn_date"), F.col("rim_limit").alias("limit"), F.col(f"{hub}_head").alias("run"))

    def side(rows: DataFrame, cells: DataFrame) -> DataFrame:
        part = rows.join(cells, ["mag", "txn_date"]).where(F.col("limit").isNull() | (F.col("row_index") < F.col("limit")))
        if one_chunk:
            return part.withColumn("rn", F.row_number().over(W.partitionBy("run").orderBy("row_index")))
        return numbered(part, ["run"], ["row_index"], chunk_of("row_index"))

    l, r = (hubs, rims) if hub == "l" else (rims, hubs)
    return _pairs(side(left, l), side(right, r), ["run", "rn"])


def _in_rounds(left: DataFrame, right: DataFrame, amount_tol: Decimal, days: int) -> list[DataFrame]:
    """Rounds until no cell has a partner cell left; what is free is all that a round reads."""
    graph = cut_lineage(_cell_graph(left, right, amount_tol, days))
    lcells = graph.select(F.col("l_mag").alias("mag"), F.col("l_date").alias("txn_date")).distinct()
    rcells = graph.select(F.col("r_mag").alias("mag"), F.col("r_date").alias("txn_date")).distinct()
    left = cut_lineage(left.join(lcells, ["mag", "txn_date"], "left_semi"))
    right = cut_lineage(right.join(rcells, ["mag", "txn_date"], "left_semi"))
    # Up to one chunk of rows per side, a plain window is as bounded as a chunk.
    one_chunk = left.unionByName(right).limit(CHUNK_ROWS + 1).count() <= CHUNK_ROWS
    done: list[DataFrame] = []
    while True:
        edges = cut_lineage(_edges(left, right, graph))
        if edges.isEmpty():
            return done
        done.append(cut_lineage(_round(left, right, edges, one_chunk, "lr"[len(done) % 2])))
        graph = edges.select("l_mag", "l_date", "r_mag", "r_date")
        left, right = cut_lineage(_unused(left, done[-1], "left")), cut_lineage(_unused(right, done[-1], "right"))


def _cells(left: DataFrame, right: DataFrame, whole: bool) -> DataFrame:
    """(strip, bucket, tile, n) of the cells of a grid over date and magnitude that hold rows.
    Consecutive cells make a tile of about GROUP_ROWS rows, or of one cell with more. With ``whole`` strips are cut only beyond HOT_ROWS."""
    rows = left.select("strip", "bucket").unionAll(right.select("strip", "bucket"))
    counts = rows.groupBy("strip", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(0))
    chunk = F.struct("strip", F.floor(F.col("bucket") / CHAIN_CHUNK).alias("b"))
    upto = running(counts, ["_all"], ["strip", "bucket"], chunk, {"upto": F.col("n")})
    place = upto.select("strip", "bucket", (F.col("upto") - F.col("n")).alias("place"), "n")
    if whole:
        strips = place.groupBy("strip").agg(F.min("place").alias("from"), F.sum("n").alias("rows"))
        start = F.when(F.col("rows") <= HOT_ROWS, F.col("from")).otherwise(F.col("place"))
        place = place.join(strips, "strip").select("strip", "bucket", start.alias("place"), "n")
    return place.select("strip", "bucket", F.floor(F.col("place") / GROUP_ROWS).alias("tile"), "n")


def _settle(left: DataFrame, right: DataFrame, tol: int, days: int) -> DataFrame:
    """Pairs that the left rows of every tile take by the rule, out of the right rows in their
    reach. A right row with a ``limit`` is lost to left rows behind that place in the file."""

    def settled(l: pa.Table, r: pa.Table) -> pa.Table:
        l, r = (t.sort_by([("row_index", "ascending"), ("id", "ascending")]) for t in (l, r))
        index, limit = (), ()
        if r["limit"].null_count < len(r):
            index = list(zip(l["row_index"].to_pylist(), l["id"].to_pylist()))
            limit = [None if i is None else (i, j) for i, j in zip(r["limit"].to_pylist(), r["limit_id"].to_pylist())]
        at = np.array(take_in_order(*(t[c].to_numpy() for t in (l, r) for c in ("cents", "day")), tol, days, index, limit), np.int64).reshape(-1, 2)
        l, r = l.take(pa.array(at[:, 0])), r.take(pa.array(at[:, 1]))
        kind = pc.if_else(pc.equal(l["day"], r["day"]), "exact", "timing")
        return pa.table([l["row_index"], r["row_index"], l["amount"], r["amount"], l["txn_date"], r["txn_date"], kind, l["tile"], l["id"], r["id"], r["shared"]],
                        names=[*PAIR_COLUMNS, "tile", "left_id", "right_id", "shared"])

    money = left.schema["amount"].dataType.simpleString(), right.schema["amount"].dataType.simpleString()
    shape = f"left_index bigint, right_index bigint, left_amount {money[0]}, right_amount {money[1]}, left_date date, right_date date, match_kind string, tile bigint, left_id bigint, right_id bigint, shared boolean"
    names = ["tile", "row_index", "id", "amount", "txn_date", "cents", "day"]
    return left.select(*names).groupBy("tile").cogroup(right.select(*names, "shared", "limit", "limit_id").groupBy("tile")).applyInArrow(settled, shape)


def _in_tiles(left: DataFrame, right: DataFrame, amount_tol: Decimal, days: int, scale: int) -> DataFrame | None:
    """All pairs, settled tile by tile; none if a cell holds too many rows for a task.

    Rows that share a ``row_index`` are told apart by ``id``. A left row belongs to one tile, a right row is shown to every tile it can be reached from.
    What two tiles took goes to the earlier left row. The tile of the later one is settled
    again without it, until nothing is taken twice. A row that was refused once is never
    given back, so the last state is the rule's: of all rows that want a right row the earliest
    one has it, and it found nothing earlier.
    """
    tol = int(amount_tol * 10**scale)
    wide, tall = TILE_REACH * max(tol, 1), TILE_REACH * days or 1
    cents = (F.col("mag") * 10**scale).cast("bigint")
    grid = {"strip": F.floor(F.col("day") / tall), "bucket": F.floor(F.col("cents") / wide)}
    left, right = (df.withColumns({"cents": cents, "day": F.unix_date("txn_date"), "id": F.monotonically_increasing_id()}).withColumns(grid) for df in (left, right))
    cells = cut_lineage(_cells(left, right, not days))  # rows of two dates never meet without days
    if not cells.where(F.col("n") > HOT_ROWS).isEmpty():
        return None
    cells = cells.select("strip", "bucket", "tile")
    left = cut_lineage(left.join(cells, ["strip", "bucket"]))
    near = lambda c, reach, size: F.explode(F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size)))
    shown = (right.withColumn("strip", near("day", days, tall)).withColumn("bucket", near("cents", tol, wide))
             .join(cells.join(left.select("tile").distinct(), "tile", "left_semi"), ["strip", "bucket"]).drop("strip", "bucket").dropDuplicates(["id", "tile"]))
    shared = F.count(F.lit(1)).over(W.partitionBy("id")) > 1
    shown = cut_lineage(shown.withColumn("shared", shared))
    none = F.lit(None).cast("bigint")
    parts = [cut_lineage(_settle(left, shown.withColumns({"limit": none, "limit_id": none}), tol, days))]
    names, claim = ["tile", "left_index", "left_id", "right_id"], F.struct("left_index", "left_id", "tile")
    claims = parts[0].where("shared").select(*names)  # rows taken now that another tile can take too
    held, again = None, []
    while True:
        first = claims.groupBy("right_id").agg(F.min(claim).alias("h"))
        held = first if held is None else held.unionByName(first).groupBy("right_id").agg(F.min("h").alias("h"))
        held = cut_lineage(held)
        lost = cut_lineage(claims.join(held, "right_id").where(claim > F.col("h")).select("tile").distinct())
        if lost.isEmpty():
            break
        again.append(lost)
        limits = held.select(F.col("right_id").alias("id"), "h")
        limit = [F.when(F.col("h.tile") != F.col("tile"), F.col(f"h.left_{a}")).alias(b) for a, b in (("index", "limit"), ("id", "limit_id"))]
        mine = shown.join(F.broadcast(lost), "tile", "left_semi").join(limits, "id", "left").select(*shown.columns, *limit)
        parts.append(cut_lineage(_settle(left.join(F.broadcast(lost), "tile", "left_semi"), mine, tol, days)))
        claims = cut_lineage(claims.join(lost, "tile", "left_anti").unionByName(parts[-1].where("shared").select(*names)))
    if not again:
        return parts[0].select(*PAIR_COLUMNS)
    # A tile's pairs are those of the last time it was settled.
    last = reduce(DataFrame.unionByName, [t.withColumn("_last", F.lit(i + 1)) for i, t in enumerate(again)]).groupBy("tile").agg(F.max("_last").alias("_last"))
    every = reduce(DataFrame.unionByName, [p.withColumn("_at", F.lit(i)) for i, p in enumerate(parts)])
    return cut_lineage(every.join(last, "tile", "left").where(F.col("_at") == F.coalesce("_last", F.lit(0))).select(*PAIR_COLUMNS))


def take_in_order(l_cents: np.ndarray, l_day: np.ndarray, r_cents: np.ndarray, r_day: np.ndarray, tol: int, days: int,
                  l_index: list[tuple[int, int]] = (), r_limit: list[tuple[int, int] | None] = ()) -> list[tuple[int, int]]:
    """Places (left, right) of the rule's pairs; both sides in file order. A left row looks
    at the first free row of each right cell in reach. Once ``l_index`` has passed the
    ``r_limit`` of a right row, that row is taken elsewhere."""
    l_cents, l_day, r_cents, r_day = (np.asarray(x, np.int64).tolist() for x in (l_cents, l_day, r_cents, r_day))
    cells: dict[tuple[int, int], list[int]] = {}
    for place in range(len(r_cents) - 1, -1, -1):
        cells.setdefault((r_day[place], r_cents[place]), []).append(place)  # first rows last, to be popped
    by_day: dict[int, list[int]] = {}
    for day, cents in sorted(cells):
        by_day.setdefault(day, []).append(cents)
    limited = any(x is not None for x in r_limit)
    reach: dict[tuple[int, int], list[list[int]]] = {}
    out = []
    for place, (cents, day) in enumerate(zip(l_cents, l_day)):
        near = reach.get((day, cents))
        if near is None:
            near = []
            for d in range(day - days, day + days + 1):
                amounts = by_day.get(d, ())
                near += [cells[d, c] for c in amounts[bisect_left(amounts, cents - tol) : bisect_right(amounts, cents + tol)]] if amounts else []
        if limited:
            for c in near:
                while c and r_limit[c[-1]] is not None and r_limit[c[-1]] < l_index[place]:
                    c.pop()
        near = reach[day, cents] = [c for c in near if c]
        if near:
            out.append((place, min(near, key=lambda c: c[-1]).pop()))
    return out


def _greedy(left: DataFrame, right: DataFrame, amount_tol: Decimal, days: int) -> list[DataFrame]:
    """Pairs of the rule, by tiles; in rounds over all tasks where amounts have more than
    18 digits or very many rows share a cell."""
    kind = [df.schema["mag"].dataType for df in (left, right)]
    if not all(isinstance(k, DecimalType) and k.precision <= 18 for k in kind) or not GROUP_ROWS:
        return _in_rounds(left, right, amount_tol, days)
    left, right = cut_lineage(left), cut_lineage(right)
    pairs = _in_tiles(left, right, amount_tol, days, max(k.scale for k in kind))
    return _in_rounds(left, right, amount_tol, days) if pairs is None else [pairs]


def match_records(left: DataFrame, right: DataFrame, amount_tol=0, days: int = 0) -> DataFrame:
    """All pairs, ``match_kind`` exact (same date) or timing (dates differ)."""
    tol = Decimal(str(amount_tol))
    l, r = candidates(left), candidates(right)
    if tol == 0:
        passes = [exact_pairs(left, right)]
        if days == 0:
            return passes[0]
        passes[0] = cut_lineage(passes[0])
    else:
        passes = _greedy(l, r, tol, 0)
    if days:
        for pairs in passes:
            l, r = _unused(l, pairs, "left"), _unused(r, pairs, "right")
        passes += _greedy(l, r, tol, days)
    if not passes:
        return exact_pairs(left, right).limit(0)
    return reduce(DataFrame.unionByName, passes)


def unmatched(rows: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Rows of one side (``left`` / ``right``) that no pass used, incomplete rows included."""
    return _unused(rows, pairs, side)


def within_table_duplicates(rows: DataFrame, amount_tol=0, days: int = 0) -> DataFrame:
    """Rows sharing magnitude and date (within tolerances) with another row.

    One line per row: how many rows it pairs with and the earliest of them.
    Half the sum of ``n_partners`` is the number of pairs. Listing the pairs of
    a group would grow with the square of its size; the counts do not.
    """
    base = candidates(rows)
    cells = base.groupBy("mag", "txn_date").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_index").alias("first"))
    other = cells.select(F.col("mag").alias("o_mag"), F.col("txn_date").alias("o_date"),
                         F.col("n").alias("o_n"), F.col("first").alias("o_first"))
    near = band_join(cells.select("mag", "txn_date"), other, [],
                     [Band("mag", "o_mag", Decimal(str(amount_tol))), Band("txn_date", "o_date", days)])
    sums = near.groupBy("mag", "txn_date").agg(
        F.sum("o_n").alias("n_near"), F.min("o_first").alias("first_near"),
        F.min(F.when((F.col("o_mag") != F.col("mag")) | (F.col("o_date") != F.col("txn_date")),
                     F.col("o_first"))).alias("first_elsewhere"))
    # The earliest row of a neighbourhood is its own earliest partner's partner:
    # it needs the second earliest row of its own cell.
    second = (base.join(cells.where("n > 1").select("mag", "txn_date", "first"), ["mag", "txn_date"])
              .where("row_index > first").groupBy("mag", "txn_date").agg(F.min("row_index").alias("second")))
    info = (sums.where("n_near > 1").join(second, ["mag", "txn_date"], "left"))
    own = F.least("second", "first_elsewhere")
    return (base.join(info, ["mag", "txn_date"])
            .select("row_index", "amount", "txn_date", (F.col("n_near") - 1).alias("n_partners"),
                    F.when(F.col("first_near") < F.col("row_index"), F.col("first_near"))
                    .otherwise(own).alias("first_partner")))
