"""Run records as tables: status, listings, comparisons, schedules, metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Review actions and what they do.
DECISIONS = {"approve_draft": "approved", "reject_ai_explanation": "rejected"}
ENGAGEMENT = ("mark_reviewed", "mark_resolved", "needs_follow_up")
FINAL, REJECTED, DRAFT = "final (human-approved)", "rejected", "draft"
MATCHED_TYPES = ("matched",)
UNMATCHED_TYPES = ("unmatched_bank", "unmatched_ledger", "timing_difference", "duplicate")
DEFAULT_INTERVAL_DAYS = 14


def run_status(events: DataFrame) -> DataFrame:
    """Latest status and review status per run from its events (run_id, ts,
    seq, action). The last decision wins; other engagement only moves pending
    to in_review; notes change nothing."""
    at = F.struct("ts", "seq")
    decision = F.col("action").isin(*DECISIONS)
    agg = events.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.max_by("action", at).alias("last_action"),
        F.max_by(F.when(decision, F.col("action")), F.when(decision, at)).alias("_d"),
        F.max(F.col("action").isin(*ENGAGEMENT).cast("int")).alias("_e"))
    decided = F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv])[F.col("_d")]
    return agg.select("run_id", "n_events", "last_action",
                      F.coalesce(decided, F.when(F.col("_e") == 1, "in_review"), F.lit("pending")).alias("review_status"))


def draft_status(actions: DataFrame) -> DataFrame:
    """Approved beats rejected beats draft, over all actions of a run."""
    rank = F.when(F.col("action") == "approve_draft", 2).when(F.col("action") == "reject_ai_explanation", 1).otherwise(0)
    top = actions.groupBy("run_id").agg(F.max(rank).alias("_r"))
    return top.select("run_id", F.when(F.col("_r") == 2, FINAL).when(F.col("_r") == 1, REJECTED).otherwise(DRAFT).alias("draft_status"))


def ai_usage(drafts: DataFrame, runs: DataFrame, actions: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per draft (draft_id, run_id, created_at, model) with its run,
    draft status and the number of distinct rows it cites."""
    cited = refs.select("draft_id", "ref").distinct().groupBy("draft_id").agg(F.count(F.lit(1)).alias("n_cited"))
    return (drafts.join(runs.select("run_id", "workflow_type"), "run_id", "left")
            .join(draft_status(actions), "run_id", "left").join(cited, "draft_id", "left")
            .select("draft_id", "run_id", "workflow_type", "created_at", "model",
                    F.coalesce("draft_status", F.lit(DRAFT)).alias("draft_status"), F.coalesce("n_cited", F.lit(0)).alias("n_cited")))


def run_listing(runs: DataFrame, limit: int, offset: int = 0, workflow_type: str | None = None, status: str | None = None,
                review_status: str | None = None, search: str | None = None) -> DataFrame:
    """One page of runs, newest first (a top-k report), with the number that fits."""
    out = runs
    for column, value in (("workflow_type", workflow_type), ("status", status), ("review_status", review_status)):
        if value:
            out = out.where(F.col(column) == value)
    if search and search.strip():
        hay = F.lower(F.concat_ws(" ", F.col("run_id").cast("string"), "workflow_type"))
        out = out.where(hay.contains(search.strip().lower()))
    total = out.agg(F.count(F.lit(1)).alias("total")).withColumn("_one", F.lit(1))
    page = out.orderBy(F.desc("created_at"), F.desc("run_id")).offset(max(offset, 0)).limit(max(limit, 0))
    return page.withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")


def next_due(current: Column, cadence: Column, interval: Column) -> Column:
    """Next due date: calendar months (clamped to the month's end) or days."""
    return (F.when(cadence == "monthly", F.add_months(current, 1)).when(cadence == "quarterly", F.add_months(current, 3))
            .otherwise(F.date_add(current, F.coalesce(interval, F.lit(DEFAULT_INTERVAL_DAYS)).cast("int"))))


def due_items(schedules: DataFrame, as_of: dt.date) -> DataFrame:
    """Active items due by ``as_of`` with the date they fall due next."""
    due = schedules.where(F.col("active") & (F.col("next_due") <= F.lit(as_of)))
    return due.withColumn("following_due", next_due(F.col("next_due"), F.col("cadence"), F.col("interval_days"))).orderBy("next_due", "item_id")


def run_metrics(findings: DataFrame, processed: DataFrame, drafts: DataFrame) -> DataFrame:
    """Per run: rows processed, matched and unmatched findings, all findings,
    rejected drafts. ``processed``: run_id, n_rows; ``drafts``: run_id, passed."""
    f = findings.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("findings_generated"), F.count_if(F.col("finding_type").isin(*MATCHED_TYPES)).alias("rows_matched"),
        F.count_if(F.col("finding_type").isin(*UNMATCHED_TYPES)).alias("rows_unmatched"))
    d = drafts.groupBy("run_id").agg(F.count_if(~F.col("passed")).alias("drafts_rejected"))
    p = processed.groupBy("run_id").agg(F.sum("n_rows").alias("rows_processed"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return p.join(f, "run_id", "left").join(d, "run_id", "left").select(
        "run_id", zero("rows_processed"), zero("rows_matched"), zero("rows_unmatched"), zero("findings_generated"), zero("drafts_rejected"))


def expectation_check(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected against actual values per check; a missing side fails."""
    e = expected.select(*keys, F.col("value").alias("expected"))
    a = actual.select(*keys, F.col("value").alias("actual"))
    return e.join(a, keys, "full_outer").select(*keys, "expected", "actual", F.col("expected").eqNullSafe(F.col("actual")).alias("passed"))


# ------------------------------------------------------------ comparing results


def _map_paths(c: str) -> Column:
    return F.transform(F.map_entries(c), lambda e: F.struct(
        F.concat(F.lit(c + "."), e["key"].cast("string")).alias("path"), e["value"].cast("string").alias("value")))


def _array_paths(c: str) -> Column:
    return F.transform(F.col(c), lambda v, i: F.struct(
        F.concat(F.lit(c + "["), i.cast("string"), F.lit("]")).alias("path"), v.cast("string").alias("value")))


def flatten(df: DataFrame, key: list[str]) -> DataFrame:
    """A result table in long form: key, path, value. Structs give dotted paths,
    maps and arrays one path per entry."""
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    dotted: list[tuple[str, Column]] = []

    def walk(prefix: str, column: Column, dtype) -> None:
        if dtype.typeName() == "struct":
            for f in dtype.fields:
                walk(f"{prefix}.{f.name}", column[f.name], f.dataType)
        else:
            dotted.append((prefix, column))

    nested = [c for c in df.columns if c not in key and types[c] in ("map", "array")]
    for f in df.schema.fields:
        if f.name not in key and f.name not in nested:
            walk(f.name, F.col(f.name), f.dataType)
    entries = [F.array(*[F.struct(F.lit(p).alias("path"), c.cast("string").alias("value")) for p, c in dotted])] if dotted else []
    entries += [_map_paths(c) if types[c] == "map" else _array_paths(c) for c in nested]
    empty = F.array().cast("array<struct<path:string,value:string>>")
    return df.select(*key, F.explode(F.concat(*[F.coalesce(e, empty) for e in entries])).alias("_e")).select(*key, "_e.path", "_e.value")


def diff_records(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Two long-form tables to added, removed and changed paths."""
    on = [*key, "path"]
    a = old.select(*on, F.col("value").alias("old_value"), F.lit(True).alias("_a"))
    b = new.select(*on, F.col("value").alias("new_value"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return (a.join(b, on, "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("old_value").eqNullSafe(F.col("new_value")))
            .select(*on, change.alias("change"), "old_value", "new_value"))


def refs_added_removed(refs_old: DataFrame, refs_new: DataFrame, key: str) -> DataFrame:
    """Cited rows one draft has and the other lacks (key, ref)."""
    a, b = refs_old.select(key, "ref").distinct(), refs_new.select(key, "ref").distinct()
    gone = a.join(b, [key, "ref"], "left_anti").withColumn("change", F.lit("removed"))
    return b.join(a, [key, "ref"], "left_anti").withColumn("change", F.lit("added")).unionByName(gone)


def latest_draft(drafts: DataFrame) -> DataFrame:
    """The last draft of each run (run_id, created_at, draft_id, ...)."""
    rest = [c for c in drafts.columns if c != "run_id"]
    return drafts.groupBy("run_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "draft_id")).alias("_l")).select(
        "run_id", *[F.col(f"_l.{c}").alias(c) for c in rest])


def _nesting(text: Column) -> Column:
    """How deep the brackets of a JSON text go, brackets inside strings left out."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:\\.|[^"\\])*+"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(acc: Column, mark: Column) -> Column:
        opened = acc["open"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct(opened.alias("open"), F.greatest(acc["most"], opened).alias("most"))

    return F.aggregate(F.split(bare, ""), start, step, lambda acc: acc["most"])


def json_changes(pairs: DataFrame, key: list[str], old: str, new: str) -> DataFrame:
    """Two JSON texts per row to their differences: key, path (``a.b[0]``), change
    (added, removed, changed), old_value and new_value as JSON.

    Both sides are opened together, level by level, as long as they are containers
    of one kind; what only one side has is one line, however much it holds. A null
    text counts as ``{}``; text that is no JSON is one value at the empty path.
    The nesting of the data is read first and gives the number of levels.
    """
    texts = pairs.select(*key, F.coalesce(old, F.lit("{}")).alias("_ta"), F.coalesce(new, F.lit("{}")).alias("_tb"))
    levels = texts.agg(F.max(F.least(_nesting(F.col("_ta")), _nesting(F.col("_tb"))))).first()[0] or 0
    plain = lambda c: F.coalesce(F.try_parse_json(c), F.to_variant_object(F.array(F.col(c))))
    rows = texts.where("_ta <> _tb").select(*key, F.lit("").alias("path"), plain("_ta").alias("a"), plain("_tb").alias("b"),
                                            F.lit(True).alias("in_a"), F.lit(True).alias("in_b"))
    for _ in range(levels):
        kind = {c: F.when(F.col(f"in_{c}"), F.regexp_extract(F.schema_of_variant(c), "^(OBJECT|ARRAY)", 1)) for c in "ab"}
        rows = rows.withColumn("_kind", F.when((kind["a"] == kind["b"]) & (F.to_json("a") != F.to_json("b")), kind["a"]).otherwise(""))
        cast = lambda c, to, k: F.when(F.col("_kind") == k, F.expr(f"try_cast({c} as {to})"))
        maps = {c: cast(c, "map<string,variant>", "OBJECT") for c in "ab"}
        lists = {c: cast(c, "array<variant>", "ARRAY") for c in "ab"}
        rows = rows.select(*key, "path", "a", "b", "in_a", "in_b", "_kind", *[maps[c].alias(f"_m{c}") for c in "ab"], *[lists[c].alias(f"_l{c}") for c in "ab"])
        longest = F.greatest(F.size("_la"), F.size("_lb"))
        at = lambda k, i: F.struct(k.cast("string").alias("key"), i.cast("int").alias("i"))
        none = F.lit(None)
        inside = (F.when(F.col("_kind") == "OBJECT", F.transform(F.array_union(F.map_keys("_ma"), F.map_keys("_mb")), lambda k: at(k, none)))
                  .when(F.col("_kind") == "ARRAY", F.transform(F.sequence(F.lit(0), longest - 1), lambda i: at(none, i)))
                  .otherwise(F.array(at(none, none))))
        rows = rows.withColumn("_at", F.explode(inside))
        name, i = F.col("_at.key"), F.col("_at.i")
        path = (F.when(F.col("_kind") == "OBJECT", F.concat("path", F.when(F.col("path") == "", "").otherwise("."), name))
                .when(F.col("_kind") == "ARRAY", F.concat(F.col("path"), F.lit("["), i.cast("string"), F.lit("]"))).otherwise(F.col("path")))
        child = lambda c: F.when(F.col("_kind") == "OBJECT", F.element_at(f"_m{c}", name)).when(F.col("_kind") == "ARRAY", F.get(f"_l{c}", i)).otherwise(F.col(c))
        has = lambda c: F.when(F.col("_kind") == "OBJECT", F.map_contains_key(f"_m{c}", name)).when(F.col("_kind") == "ARRAY", i < F.size(f"_l{c}")).otherwise(F.col(f"in_{c}"))
        rows = rows.select(*key, path.alias("path"), child("a").alias("a"), child("b").alias("b"), has("a").alias("in_a"), has("b").alias("in_b"))
    value = lambda c: F.when(F.col(f"in_{c}"), F.coalesce(F.to_json(c), F.lit("null")))
    change = F.when(~F.col("in_a"), "added").when(~F.col("in_b"), "removed").otherwise("changed")
    return (rows.select(*key, "path", change.alias("change"), value("a").alias("old_value"), value("b").alias("new_value"))
            .where(~F.col("old_value").eqNullSafe(F.col("new_value"))))


def run_changes(pairs: DataFrame, drafts: DataFrame, refs: DataFrame) -> DataFrame:
    """What the last drafts of each pair (run_a, run_b) differ in, one line each:
    kind ``path`` (the JSON of ``response``) or ``row`` (a cited row, in ``path``).
    A run without a draft counts as an empty one."""
    last = latest_draft(drafts).select("run_id", "draft_id", "response")
    key = ["run_a", "run_b"]
    both = (pairs.select(*key).distinct().join(last.select(F.col("run_id").alias("run_a"), F.col("draft_id").alias("draft_a"), F.col("response").alias("_old")), "run_a", "left")
            .join(last.select(F.col("run_id").alias("run_b"), F.col("draft_id").alias("draft_b"), F.col("response").alias("_new")), "run_b", "left"))
    paths = json_changes(both, key, "_old", "_new").withColumn("kind", F.lit("path"))
    cited = refs.select("draft_id", "ref").distinct()
    sides = [both.select(*key, F.col(f"draft_{c}").alias("draft_id")).join(cited, "draft_id").select(*key, "ref", F.lit(n).alias("_side")) for c, n in (("a", 1), ("b", 2))]
    # a row that both cite has both bits and drops out
    once = sides[0].unionByName(sides[1]).groupBy(*key, "ref").agg(F.sum("_side").alias("_side")).where("_side < 3")
    gone = F.col("_side") == 1
    rows = once.select(*key, F.col("ref").alias("path"), F.when(gone, "removed").otherwise("added").alias("change"),
                       F.when(gone, F.col("ref")).alias("old_value"), F.when(~gone, F.col("ref")).alias("new_value"), F.lit("row").alias("kind"))
    return paths.unionByName(rows).select(*key, "kind", "path", "change", "old_value", "new_value")


def change_counts(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """Per pair: cited rows gained and lost, paths added, removed and changed."""
    def n(kind: str, change: str, name: str) -> Column:
        return F.coalesce(F.count_if((F.col("kind") == kind) & (F.col("change") == change)), F.lit(0)).alias(name)

    found = changes.groupBy("run_a", "run_b").agg(n("row", "added", "rows_added"), n("row", "removed", "rows_removed"), n("path", "added", "paths_added"),
                                                  n("path", "removed", "paths_removed"), n("path", "changed", "paths_changed"))
    return pairs.select("run_a", "run_b").distinct().join(found, ["run_a", "run_b"], "left").na.fill(0, found.columns[2:])


def diff_runs(pairs: DataFrame, drafts: DataFrame) -> DataFrame:
    """Run pairs (run_a, run_b) compared by their last draft: template, model
    and summary changed, and whether each side has a draft at all."""
    last = latest_draft(drafts).select("run_id", "draft_id", "template", "model", "summary")
    a = last.select(*[F.col(c).alias(f"a_{c}") for c in last.columns])
    b = last.select(*[F.col(c).alias(f"b_{c}") for c in last.columns])
    j = pairs.join(a, pairs["run_a"] == a["a_run_id"], "left").join(b, pairs["run_b"] == b["b_run_id"], "left")
    differs = lambda c: ~F.coalesce(f"a_{c}", F.lit("")).eqNullSafe(F.coalesce(f"b_{c}", F.lit("")))
    return j.select("run_a", "run_b", F.col("a_draft_id").isNotNull().alias("has_draft_a"), F.col("b_draft_id").isNotNull().alias("has_draft_b"),
                    differs("template").alias("template_changed"), differs("model").alias("model_changed"),
                    differs("summary").alias("summary_changed"))


def run_manifest(runs: DataFrame, children: dict[str, DataFrame], entry_limit: int | None = None) -> DataFrame:
    """One record per run: its own fields, and per child table (files, findings,
    actions, exports, events) the number of entries, a digest that does not
    depend on order, and the first and last entry. The entries stay in their
    tables under the run's key: a run can have millions of them.
    """
    out = runs
    for name, df in children.items():
        cols = [c for c in df.columns if c != "run_id"]
        row = F.to_json(F.struct(*cols))
        agg = df.select("run_id", row.alias("_r")).groupBy("run_id").agg(
            F.count(F.lit(1)).alias("n"), F.min("_r").alias("first"), F.max("_r").alias("last"),
            F.sum(F.xxhash64("_r").cast("decimal(38,0)")).cast("string").alias("digest"))
        out = out.join(agg.select("run_id", F.struct("n", "first", "last", "digest").alias(name)), "run_id", "left")
    return out.select("run_id", F.to_json(F.struct(*out.columns)).alias("manifest"))


# ------------------------------------------------------------ larger test data

# How a copy differs from the original.
COPY_DAYS, COPY_SLOTS, COPY_STEP = 30, 120, "0.37"


def scale_out(df: DataFrame, copies: int, dates: list[str], amounts: list[str], ids: list[str], copy: str = "copy_no") -> DataFrame:
    """``copies`` copies of a table: copy i has its dates shifted by 30 x (i mod
    120) days, its amounts raised by 0.37 x i and its ids suffixed; all other
    columns (vendors) stay, so joins between copies of one number still line up."""
    i = F.col(copy)
    out = df.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    changes = {c: F.date_add(c, (i % COPY_SLOTS * COPY_DAYS).cast("int")) for c in dates}
    changes |= {c: (F.col(c) + F.lit(COPY_STEP).cast("decimal(4,2)") * i).cast("decimal(18,2)") for c in amounts}
    changes |= {c: F.when(i == 0, F.col(c).cast("string")).otherwise(F.array_join(F.transform(
        F.split(F.col(c).cast("string"), ";"), lambda p: F.when(F.trim(p) == "", p).otherwise(F.concat(p, F.lit("-"), i.cast("string")))), ";"))
        for c in ids}
    return out.withColumns(changes)
