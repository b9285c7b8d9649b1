"""Queries: text operators, findings, run records, streaming, scale-out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tieout.functions import scalars as s
from tieout.functions.similarity import sequence_ratio
from tieout.operators import ap, findings, runs, texts
from tieout.plans import views as v
from tieout.plans.registry import add, query
from tieout.session import scratch_path
from tieout.streaming import audit

# ------------------------------------------------------------ texts


def _docs(spark, sf):
    return v.wide_table(spark, sf, "documents")


_PHONE = r"(^|[^0-9])(\+?1[-.\s]?)?(\([0-9]{3}\)[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}|[0-9]{3}[-.\s][0-9]{3}[-.\s][0-9]{4})([^0-9]|$)"
add("pii_types", lambda spark, sf: texts.pii_types(_docs(spark, sf)), rf"""
SELECT doc_id, 'ssn' AS pattern_type FROM documents WHERE regexp_matches(text, '\b\d{{3}}[-\s]\d{{2}}[-\s]\d{{4}}\b')
UNION ALL SELECT doc_id, 'email' FROM documents WHERE regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b')
UNION ALL SELECT doc_id, 'phone' FROM documents WHERE regexp_matches(text, '{_PHONE}')
UNION ALL SELECT doc_id, 'credit_card' FROM documents WHERE regexp_matches(text, '\d([ -]?\d){{12}}')
UNION ALL SELECT doc_id, 'long_number' FROM documents WHERE regexp_matches(text, '\d{{9}}')""")
add("pii_scan", lambda spark, sf: texts.pii_scan(_docs(spark, sf)))
add("pii_redact", lambda spark, sf: texts.pii_redact(_docs(spark, sf).select("doc_id", "text")))
add("redaction_counts", lambda spark, sf: texts.redaction_counts(_docs(spark, sf)))

_DRAFT_TEXT = """CASE WHEN o_orderstatus = 'F' THEN ' This report is approved. The batch was fully reconciled!' ELSE ' The batch needs review.' END"""
add("approval_language", lambda spark, sf: texts.approval_language(v.order_drafts(spark, sf)),
    "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'F'")
add("approval_language_documents", lambda spark, sf: texts.approval_language(_docs(spark, sf)), """
SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'i approve|approved for filing|this report is correct|report is approved|final and approved|certified correct|approved for release|i certify')
  OR regexp_matches(lower(text), '\\b(this|the)\\s+(report|reconciliation|draft|memo|journal entry|entry|workbook|packet|review|variance commentary)\\s+(is|has been|was)\\s+(approved|certified|final)\\b')""")
add("resolution_claims", lambda spark, sf: texts.resolution_claims(v.order_drafts(spark, sf)),
    "SELECT o_orderkey AS doc_id, 'the batch was fully reconciled' AS sentence FROM orders WHERE o_orderstatus = 'F'")

_CLAIMS = """cl AS (SELECT o_orderkey AS doc_id, 'ref' AS kind, 'orders:' || o_orderkey::VARCHAR AS value, NULL::DECIMAL(38,18) AS number, 0 AS places, '' AS mark FROM orders
  UNION ALL SELECT o_orderkey, 'row', o_custkey::VARCHAR, NULL, 0, '' FROM orders
  UNION ALL SELECT o_orderkey, 'date', o_orderdate::DATE::VARCHAR, NULL, 0, '' FROM orders
  UNION ALL SELECT o_orderkey, 'ident', 'ORD-' || o_orderkey::VARCHAR, NULL, 0, '' FROM orders
  UNION ALL SELECT o_orderkey, 'number', '$' || format('{:,.2f}', o_totalprice), (o_totalprice::DECIMAL(18,2))::DECIMAL(38,18), 2, '$' FROM orders)"""


def _claims(spark, sf):
    return texts.extract_claims(v.order_drafts(spark, sf))


add("extract_claims", lambda spark, sf: _claims(spark, sf).drop("raw", "figure"), f"WITH {_CLAIMS} SELECT * FROM cl")
add("extract_claims_documents", lambda spark, sf: texts.extract_claims(_docs(spark, sf)).drop("raw", "figure"))
add("unsupported_claims", lambda spark, sf: texts.unsupported_claims(
    _claims(spark, sf), texts.extract_claims(v.order_grounding(spark, sf))).select("doc_id", "kind", "value"), f"""
WITH {_CLAIMS} SELECT doc_id, kind, value FROM cl JOIN orders ON o_orderkey = doc_id
WHERE (kind = 'date' AND o_orderpriority = '1-URGENT' AND o_orderdate::DATE <> DATE '2000-01-01') OR (kind = 'number' AND o_orderstatus = 'P')""")
add("invented_references", lambda spark, sf: texts.invented_references(_claims(spark, sf), v.table(spark, sf, "lineitem").select(
    F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("Orders:"), F.col("l_orderkey").cast("string")).alias("ref"))), """
SELECT o_orderkey AS doc_id, 'orders:' || o_orderkey::VARCHAR AS ref FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
add("unknown_account_claims", lambda spark, sf: texts.unknown_account_claims(v.table(spark, sf, "orders").select(
    F.col("o_orderkey").alias("doc_id"), F.array(F.col("o_custkey").cast("string"), F.lit(" ")).alias("account_codes")), v.account_codes(spark, sf)), """
SELECT o_orderkey AS doc_id, o_custkey::VARCHAR AS account_code FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""")


def _questions(spark, sf):
    """One question per customer, about findings (parts) of the run (brand) it points at."""
    return v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("question_id"), F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string")).alias("run_id"),
        F.concat(F.lit("Why are the red rings and "), F.lower("c_mktsegment"), F.lit(" widgets flagged?")).alias("question"))


def _part_findings(spark, sf):
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("finding_id"), F.col("p_brand").alias("run_id"),
                                             F.concat_ws(" ", "p_name", "p_type").alias("text"))


add("batch_relevance", lambda spark, sf: texts.batch_relevance(_questions(spark, sf), _part_findings(spark, sf)), r"""
WITH fold(t, w) AS (SELECT t, CASE WHEN length(t) > 3 AND t LIKE '%s' THEN left(t, length(t) - 1) ELSE t END FROM (SELECT DISTINCT unnest(regexp_extract_all(x, '[a-z0-9]{3,}')) AS t
    FROM (SELECT lower('Why are the red rings and ' || c_mktsegment || ' widgets flagged?') AS x FROM customer UNION SELECT lower(p_name || ' ' || p_type) FROM part))),
q AS (SELECT DISTINCT question_id, run_id, w FROM (SELECT c_custkey AS question_id, 'Brand#' || (c_nationkey + 1)::VARCHAR AS run_id,
    unnest(regexp_extract_all(lower('Why are the red rings and ' || c_mktsegment || ' widgets flagged?'), '[a-z0-9]{3,}')) AS t FROM customer) JOIN fold USING (t)
  WHERE t NOT IN ('the', 'and', 'why', 'are')),
f AS (SELECT DISTINCT finding_id, run_id, w FROM (SELECT p_partkey AS finding_id, p_brand AS run_id, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]{3,}')) AS t FROM part) JOIN fold USING (t)),
sc AS (SELECT question_id, finding_id, count(*) AS score FROM q JOIN f USING (run_id, w) GROUP BY ALL),
rk AS (SELECT *, max(score) OVER (PARTITION BY question_id) AS best, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, finding_id) AS position FROM sc)
SELECT question_id, finding_id, score, position::INTEGER AS position FROM rk WHERE position <= 3 AND score * 2 > best""")


@query("sequence_ratio")
def name_ratio(spark, sf):
    """Distinct part names against the name of the cheapest part of their type."""
    part = v.table(spark, sf, "part")
    base = part.groupBy("p_type").agg(F.min_by("p_name", F.struct("p_retailprice", "p_partkey")).alias("name_b"))
    pairs = part.select("p_type", F.col("p_name").alias("name_a")).distinct().join(base, "p_type").select("name_a", "name_b").distinct()
    return pairs.withColumn("ratio", F.round(sequence_ratio("name_a", "name_b"), 6))


# ------------------------------------------------------------ findings


def _found(spark, sf):
    """Findings of four payables rules, one run per vendor, and the rows they cite."""
    inv, ven = v.invoices(spark, sf), v.vendors(spark, sf)
    run = F.col("vendor_number")
    rules = [("missing_po_over_threshold", ap.missing_po_over_threshold(inv)), ("inactive_vendor_payment", ap.inactive_vendor(inv, ven)),
             ("unknown_vendor_payment", ap.unknown_vendor(inv, ven))]
    found = [findings.to_findings(df, rule, ["row_id"], ["invoice_number", "invoice_amount"], run) for rule, df in rules]
    dup = ap.duplicate_invoice(inv)
    found.append(findings.to_findings(dup, "duplicate_invoice_number", ["vendor_number", "invoice_number"], ["invoice_number", "n_rows"], run))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _ident(rule: str, *cols: str):
    return F.sha2(F.concat_ws("|", F.lit(rule), *cols), 256).alias("finding_id")


def _cited(spark, sf):
    inv, ven = v.invoices(spark, sf), v.vendors(spark, sf)
    rules = [("missing_po_over_threshold", ap.missing_po_over_threshold(inv)), ("inactive_vendor_payment", ap.inactive_vendor(inv, ven)),
             ("unknown_vendor_payment", ap.unknown_vendor(inv, ven))]
    out = ap.duplicate_invoice_rows(inv).select(_ident("duplicate_invoice_number", "vendor_number", "invoice_number"), F.lit("ap").alias("table_name"), "row_id")
    for rule, df in rules:
        out = out.unionByName(df.select(_ident(rule, "row_id"), F.lit("ap").alias("table_name"), "row_id"))
    return out


_FIND = """fd AS (SELECT vendor_number AS run_id, sha256('missing_po_over_threshold|' || row_id) AS finding_id, 'missing_reference' AS finding_type, 'medium' AS severity,
    'missing_po_over_threshold' AS rule_used, true AS review FROM ap WHERE po_number = '' AND invoice_amount >= 5000
  UNION ALL SELECT vendor_number, sha256('inactive_vendor_payment|' || ap.row_id), 'vendor_anomaly', 'high', 'inactive_vendor_payment', true FROM ap JOIN vendors l USING (vendor_number) WHERE status = 'Inactive'
  UNION ALL SELECT vendor_number, sha256('unknown_vendor_payment|' || row_id), 'missing_reference', 'high', 'unknown_vendor_payment', true FROM ap WHERE vendor_number NOT IN (SELECT vendor_number FROM vendors)
  UNION ALL SELECT vendor_number, sha256('duplicate_invoice_number|' || vendor_number || '|' || invoice_number), 'duplicate_payment', 'high', 'duplicate_invoice_number', true
    FROM ap GROUP BY vendor_number, invoice_number HAVING count(*) > 1)"""
_REFS = """rf AS (SELECT sha256('missing_po_over_threshold|' || row_id) AS finding_id, row_id FROM ap WHERE po_number = '' AND invoice_amount >= 5000
  UNION ALL SELECT sha256('inactive_vendor_payment|' || ap.row_id), ap.row_id FROM ap JOIN vendors l USING (vendor_number) WHERE status = 'Inactive'
  UNION ALL SELECT sha256('unknown_vendor_payment|' || row_id), row_id FROM ap WHERE vendor_number NOT IN (SELECT vendor_number FROM vendors)
  UNION ALL SELECT sha256('duplicate_invoice_number|' || vendor_number || '|' || invoice_number), row_id FROM ap
    QUALIFY count(*) OVER (PARTITION BY vendor_number, invoice_number) > 1)"""

add("findings", lambda spark, sf: _found(spark, sf).select("run_id", "finding_id", "finding_type", "severity", "rule_used", "requires_human_review"),
    f"WITH {_FIND} SELECT run_id, finding_id, finding_type, severity, rule_used, review AS requires_human_review FROM fd")
add("findings_summary", lambda spark, sf: findings.findings_summary(_found(spark, sf)), f"""
WITH {_FIND} SELECT run_id, 'rule' AS dimension, rule_used AS value, count(*) AS n_findings, count(*) AS n_review FROM fd GROUP BY ALL
UNION ALL SELECT run_id, 'severity', severity, count(*), count(*) FROM fd GROUP BY ALL
UNION ALL SELECT run_id, 'finding_type', finding_type, count(*), count(*) FROM fd GROUP BY ALL
UNION ALL SELECT run_id, 'total', '', count(*), count(*) FROM fd GROUP BY ALL""")
add("derived_counts", lambda spark, sf: findings.derived_counts(_found(spark, sf), _cited(spark, sf)), f"""
WITH {_FIND}, {_REFS}, t AS (SELECT run_id, count(*) AS n FROM fd GROUP BY 1), x AS (SELECT DISTINCT run_id, finding_id, row_id FROM rf JOIN fd USING (finding_id))
SELECT DISTINCT run_id, n FROM (SELECT * FROM t UNION ALL SELECT run_id, 150 FROM t WHERE n > 150 UNION ALL SELECT run_id, n - 150 FROM t WHERE n > 150
  UNION ALL SELECT run_id, count(*) FROM fd GROUP BY run_id, severity UNION ALL SELECT run_id, count(*) FROM fd GROUP BY run_id, finding_type
  UNION ALL SELECT run_id, count(*) FROM fd GROUP BY run_id, rule_used UNION ALL SELECT run_id, count(DISTINCT severity) FROM fd GROUP BY 1
  UNION ALL SELECT run_id, count(DISTINCT finding_type) FROM fd GROUP BY 1 UNION ALL SELECT run_id, count(DISTINCT rule_used) FROM fd GROUP BY 1
  UNION ALL SELECT run_id, count(DISTINCT finding_id) FROM x GROUP BY 1 UNION ALL SELECT run_id, count(DISTINCT row_id) FROM x GROUP BY 1
  UNION ALL SELECT run_id, 1 FROM x)""")
add("top_findings", lambda spark, sf: findings.top_findings(_found(spark, sf), "finding_id").select("run_id", "finding_id", "severity", "n_omitted"), f"""
WITH {_FIND} SELECT run_id, finding_id, severity, greatest(n - 150, 0) AS n_omitted FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS n,
  row_number() OVER (PARTITION BY run_id ORDER BY CASE severity WHEN 'high' THEN 1 ELSE 2 END, finding_id) AS k FROM fd) WHERE k <= 150""")

_CELLS = """ce AS (SELECT finding_id, 'ap' AS table_name, row_id, unnest(['vendor_number', 'invoice_number', 'invoice_date', 'invoice_amount']) AS column_name,
  unnest([vendor_number, invoice_number, invoice_date::VARCHAR, invoice_amount::VARCHAR]) AS cell FROM rf JOIN ap USING (row_id))"""


def _cells(spark, sf):
    return findings.source_values_for_refs(_cited(spark, sf), v.invoices(spark, sf), "ap", ["vendor_number", "invoice_number", "invoice_date", "invoice_amount"])


add("source_values_for_refs", _cells, f"WITH {_REFS}, {_CELLS} SELECT * FROM ce")


@query("source_evidence", f"""
WITH {_REFS}, {_CELLS}, {_FIND}, val AS (SELECT finding_id, (SELECT any_value(invoice_number) FROM ap WHERE ap.row_id = rf.row_id) AS inv,
  CASE WHEN rule_used = 'duplicate_invoice_number' THEN count(*) OVER (PARTITION BY finding_id)::DECIMAL(18,2) ELSE (SELECT any_value(invoice_amount) FROM ap WHERE ap.row_id = rf.row_id) END AS amt, row_id
  FROM rf JOIN fd USING (finding_id))
SELECT finding_id, table_name, row_id, column_name, cell,
  cell = inv OR coalesce(column_name <> 'invoice_date' AND try_cast(cell AS DECIMAL(18,2)) IN (inv::DECIMAL(18,2), amt), false) AS highlighted, 'ap.csv' AS file_name, 'n/a' AS sha256
FROM ce JOIN val USING (finding_id, row_id)""")
def source_evidence(spark, sf):
    manifest = spark.range(1).select(F.lit("ap").alias("table_name"), F.lit("ap.csv").alias("file_name"), F.lit("n/a").alias("sha256"))
    return findings.source_evidence(_found(spark, sf), _cells(spark, sf), manifest)


@query("missing_documents", f"""
WITH {_FIND} SELECT run_id, finding_id, 'ap' AS cited_table, 'vendors' AS missing_document FROM fd
WHERE rule_used = 'missing_po_over_threshold' AND run_id IN (SELECT vendor_number FROM vendors WHERE status = 'Inactive')
UNION ALL SELECT run_id, finding_id, 'ap', 'vendors' FROM fd WHERE false""")
def missing_documents(spark, sf):
    """Inactive-vendor findings also cite the vendor list."""
    found = _found(spark, sf)
    also = found.where("rule_used = 'inactive_vendor_payment'").select("finding_id", F.lit("vendors").alias("table_name"), F.col("run_id").alias("row_id"))
    return findings.missing_documents(found, _cited(spark, sf).unionByName(also))


add("result_digest", lambda spark, sf: findings.result_digest(_found(spark, sf)))

# ------------------------------------------------------------ runs


def _events(spark, sf):
    return v.audit_events(spark, sf)


_RUN_STATUS = """
SELECT run_id, count(*) AS n_events, arg_max(action, seq) AS last_action, coalesce(CASE arg_max(action, seq) FILTER (WHERE action IN ('approve_draft', 'reject_ai_explanation'))
  WHEN 'approve_draft' THEN 'approved' WHEN 'reject_ai_explanation' THEN 'rejected' END, CASE WHEN max(action = 'mark_reviewed') THEN 'in_review' END, 'pending') AS review_status
FROM acts GROUP BY run_id"""
add("run_status", lambda spark, sf: runs.run_status(_events(spark, sf)), _RUN_STATUS)
_STATUS = """ds AS (SELECT run_id, CASE WHEN max(action = 'approve_draft') THEN 'final (human-approved)' WHEN max(action = 'reject_ai_explanation') THEN 'rejected' ELSE 'draft' END AS draft_status
  FROM acts GROUP BY run_id)"""
add("draft_status", lambda spark, sf: runs.draft_status(_events(spark, sf)), f"WITH {_STATUS} SELECT * FROM ds")
add("ai_usage", lambda spark, sf: runs.ai_usage(v.drafts(spark, sf), v.runs(spark, sf), _events(spark, sf), v.draft_refs(spark, sf)), f"""
WITH {_STATUS} SELECT d.draft_id, d.run_id, r.workflow_type, d.created_at, model, coalesce(draft_status, 'draft') AS draft_status,
  (SELECT count(DISTINCT ref) FROM refs f WHERE f.draft_id = d.draft_id) AS n_cited FROM drafts d LEFT JOIN runs r USING (run_id) LEFT JOIN ds USING (run_id)""")
add("run_listing", lambda spark, sf: runs.run_listing(v.runs(spark, sf), 25, 5, workflow_type="budget_variance", status="completed", search="VARIANCE"), """
WITH f AS (SELECT * FROM runs WHERE workflow_type = 'budget_variance' AND status = 'completed')
SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC, run_id DESC LIMIT 25 OFFSET 5""")
add("due_items", lambda spark, sf: runs.due_items(v.schedules(spark, sf), dt.date(2024, 1, 31)), """
SELECT *, CASE cadence WHEN 'monthly' THEN (next_due + INTERVAL 1 MONTH)::DATE WHEN 'quarterly' THEN (next_due + INTERVAL 3 MONTH)::DATE ELSE next_due + coalesce(interval_days, 14) END AS following_due
FROM (SELECT c_custkey AS item_id, DATE '2024-01-10' + c_nationkey AS next_due, CASE c_mktsegment WHEN 'BUILDING' THEN 'monthly' WHEN 'MACHINERY' THEN 'quarterly' ELSE 'custom' END AS cadence,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 10 END AS interval_days, c_acctbal > 0 AS active FROM customer) WHERE active AND next_due <= DATE '2024-01-31'""")


@query("run_metrics", f"""
WITH {_FIND}, f AS (SELECT run_id, count(*) AS n FROM fd GROUP BY 1), d AS (SELECT run_id::VARCHAR AS run_id, count(*) FILTER (WHERE NOT passed) AS b FROM drafts GROUP BY 1)
SELECT run_id, count(*) AS rows_processed, 0::BIGINT AS rows_matched, 0::BIGINT AS rows_unmatched, coalesce(any_value(n), 0) AS findings_generated, coalesce(any_value(b), 0) AS drafts_rejected
FROM (SELECT vendor_number AS run_id FROM ap) LEFT JOIN f USING (run_id) LEFT JOIN d USING (run_id) GROUP BY run_id""")
def run_metrics(spark, sf):
    processed = v.invoices(spark, sf).groupBy(F.col("vendor_number").alias("run_id")).agg(F.count(F.lit(1)).alias("n_rows"))
    return runs.run_metrics(_found(spark, sf), processed, v.drafts(spark, sf).withColumn("run_id", F.col("run_id").cast("string")))


@query("expectation_check", """
WITH e AS (SELECT o_custkey AS customer, count(*)::VARCHAR AS expected FROM orders GROUP BY 1), a AS (SELECT c_custkey AS customer, c_nationkey::VARCHAR AS actual FROM customer)
SELECT customer, expected, actual, expected IS NOT DISTINCT FROM actual AS passed FROM e FULL JOIN a USING (customer)""")
def expectation_check(spark, sf):
    e = v.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    a = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").cast("string").alias("value"))
    return runs.expectation_check(e, a, ["customer"])


add("refs_added_removed", lambda spark, sf: runs.refs_added_removed(
    v.draft_refs(spark, sf), v.table(spark, sf, "events").where("event_type = 'click'").select(
        F.col("user_id").alias("run_id"), F.concat(F.lit("events:"), F.get_json_object("props", "$.k")).alias("ref")), "run_id"), """
WITH o AS (SELECT DISTINCT run_id, ref FROM refs), n AS (SELECT DISTINCT user_id AS run_id, 'events:' || json_extract_string(props, '$.k') AS ref FROM events WHERE event_type = 'click')
SELECT run_id, ref, 'added' AS change FROM n ANTI JOIN o USING (run_id, ref) UNION ALL SELECT run_id, ref, 'removed' FROM o ANTI JOIN n USING (run_id, ref)""")


@query("diff_records", """
WITH a AS (SELECT CASE WHEN o_totalprice < 100000 THEN -o_orderkey ELSE o_orderkey END AS k, unnest(['status', 'detail.priority', 'detail.customer']) AS path, unnest([o_orderstatus, o_orderpriority, o_custkey::VARCHAR]) AS v FROM orders),
b AS (SELECT CASE WHEN o_totalprice > 400000 THEN -o_orderkey ELSE o_orderkey END AS k, unnest(['status', 'detail.priority', 'detail.customer']) AS path,
  unnest([CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END, o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey::VARCHAR END]) AS v FROM orders)
SELECT k AS o_orderkey, path, CASE WHEN ak IS NULL THEN 'added' WHEN bk IS NULL THEN 'removed' ELSE 'changed' END AS change, av AS old_value, bv AS new_value FROM
  (SELECT coalesce(a.k, b.k) AS k, coalesce(a.path, b.path) AS path, a.k AS ak, b.k AS bk, a.v AS av, b.v AS bv FROM a FULL JOIN b ON a.k = b.k AND a.path = b.path)
WHERE ak IS NULL OR bk IS NULL OR av IS DISTINCT FROM bv""")
def diff_records(spark, sf):
    orders = v.table(spark, sf, "orders")
    shape = lambda df, st, cu: runs.flatten(df.select("o_orderkey", st.alias("status"), F.struct(
        F.col("o_orderpriority").alias("priority"), cu.alias("customer")).alias("detail")), ["o_orderkey"])
    renamed = lambda flaw: orders.withColumn("o_orderkey", F.when(flaw, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")))
    old = shape(renamed(F.col("o_totalprice") < 100000), F.col("o_orderstatus"), F.col("o_custkey"))
    new = shape(renamed(F.col("o_totalprice") > 400000), F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus")),
                F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")))
    return runs.diff_records(old, new, ["o_orderkey"])


@query("diff_runs", """
WITH l AS (SELECT run_id, arg_max(template, draft_id) AS t, arg_max(model, draft_id) AS m, arg_max(summary, draft_id) AS s FROM drafts GROUP BY 1),
p AS (SELECT DISTINCT user_id AS run_a, user_id + 1 AS run_b FROM events)
SELECT run_a, run_b, a.run_id IS NOT NULL AS has_draft_a, b.run_id IS NOT NULL AS has_draft_b, coalesce(a.t, '') <> coalesce(b.t, '') AS template_changed,
  coalesce(a.m, '') <> coalesce(b.m, '') AS model_changed, coalesce(a.s, '') <> coalesce(b.s, '') AS summary_changed
FROM p LEFT JOIN l a ON a.run_id = run_a LEFT JOIN l b ON b.run_id = run_b""")
def diff_runs(spark, sf):
    pairs = v.table(spark, sf, "events").select(F.col("user_id").alias("run_a"), (F.col("user_id") + 1).alias("run_b")).distinct()
    return runs.diff_runs(pairs, v.drafts(spark, sf))


_CHANGES = """r AS (SELECT draft_id, run_id, json_extract(summary, '$.k')::VARCHAR AS k, template AS t, model = 'm1' AS low, max(draft_id) OVER w = draft_id AS last FROM drafts WINDOW w AS (PARTITION BY run_id)), l AS (SELECT * FROM r WHERE last),
  p AS (SELECT DISTINCT user_id AS run_a, user_id + 1 AS run_b FROM events),
  s AS (SELECT run_id, draft_id, k, t = 't2' AS large, low, '{"k":' || k || '}' AS summary, '"' || t || '"' AS tag, CASE WHEN low THEN '{"at":' || k || ',"low":true}' ELSE 'null' END AS chk,
    '["' || t || '"' || CASE WHEN t = 't2' THEN ',"large"]' ELSE ']' END AS tags FROM l),
  j AS (SELECT run_a, run_b, a, b, a.run_id IS NOT NULL AS has_a, b.run_id IS NOT NULL AS has_b FROM p LEFT JOIN s a ON a.run_id = run_a LEFT JOIN s b ON b.run_id = run_b),
  c AS (SELECT run_a, run_b, unnest(CASE
      WHEN has_a AND has_b THEN [
        {'path': 'summary.k', 'o': a.k, 'n': b.k}, {'path': 'tags[0]', 'o': a.tag, 'n': b.tag}, {'path': 'tags[1]', 'o': CASE WHEN a.large THEN '"large"' END, 'n': CASE WHEN b.large THEN '"large"' END},
        {'path': CASE WHEN a.low AND b.low THEN 'check.at' ELSE 'check' END, 'o': CASE WHEN a.low AND b.low THEN a.k ELSE a.chk END, 'n': CASE WHEN a.low AND b.low THEN b.k ELSE b.chk END}]
      WHEN has_a THEN [{'path': 'summary', 'o': a.summary, 'n': NULL}, {'path': 'tags', 'o': a.tags, 'n': NULL}, {'path': 'check', 'o': a.chk, 'n': NULL}]
      WHEN has_b THEN [{'path': 'summary', 'o': NULL, 'n': b.summary}, {'path': 'tags', 'o': NULL, 'n': b.tags}, {'path': 'check', 'o': NULL, 'n': b.chk}] END) AS e FROM j),
  ra AS (SELECT DISTINCT run_a, run_b, ref FROM j JOIN refs ON refs.draft_id = j.a.draft_id), rb AS (SELECT DISTINCT run_a, run_b, ref FROM j JOIN refs ON refs.draft_id = j.b.draft_id),
  d AS (SELECT run_a, run_b, 'path' AS kind, e.path AS path, CASE WHEN e.o IS NULL THEN 'added' WHEN e.n IS NULL THEN 'removed' ELSE 'changed' END AS change, e.o AS old_value, e.n AS new_value
      FROM c WHERE e.o IS DISTINCT FROM e.n
    UNION ALL SELECT run_a, run_b, 'row', ref, 'removed', ref, NULL FROM ra ANTI JOIN rb USING (run_a, run_b, ref)
    UNION ALL SELECT run_a, run_b, 'row', ref, 'added', NULL, ref FROM rb ANTI JOIN ra USING (run_a, run_b, ref))"""


def _run_changes(spark, sf):
    pairs = v.table(spark, sf, "events").select(F.col("user_id").alias("run_a"), (F.col("user_id") + 1).alias("run_b")).distinct()
    k = F.get_json_object("summary", "$.k")
    tags = F.concat(F.lit('["'), F.col("template"), F.when(F.col("template") == "t2", '","large"]').otherwise('"]'))
    check = F.when(F.col("model") == "m1", F.concat(F.lit('{"low":true,"at":'), k, F.lit("}"))).otherwise("null")
    response = F.concat(F.lit('{"summary":'), F.col("summary"), F.lit(',"tags":'), tags, F.lit(',"check":'), check, F.lit("}"))
    drafts = v.drafts(spark, sf).withColumn("response", response)
    return pairs, runs.run_changes(pairs, drafts, v.draft_refs(spark, sf))


add("run_changes", lambda spark, sf: _run_changes(spark, sf)[1], f"WITH {_CHANGES} SELECT run_a, run_b, kind, path, change, old_value, new_value FROM d")
add("run_change_counts", lambda spark, sf: runs.change_counts(*_run_changes(spark, sf)), f"""WITH {_CHANGES}
SELECT run_a, run_b, count(*) FILTER (kind = 'row' AND change = 'added') AS rows_added, count(*) FILTER (kind = 'row' AND change = 'removed') AS rows_removed,
  count(*) FILTER (kind = 'path' AND change = 'added') AS paths_added, count(*) FILTER (kind = 'path' AND change = 'removed') AS paths_removed,
  count(*) FILTER (kind = 'path' AND change = 'changed') AS paths_changed FROM p LEFT JOIN d USING (run_a, run_b) GROUP BY run_a, run_b""")


@query("run_manifest")
def run_manifest(spark, sf):
    return runs.run_manifest(v.runs(spark, sf), {"audit_events": _events(spark, sf), "drafts": v.drafts(spark, sf), "cited_rows": v.draft_refs(spark, sf)})


def _audit_log(spark, sf):
    """The event table streamed into an append-only log in two batches of files."""
    source, target, state = (scratch_path(spark, n) for n in ("audit-in", "audit-log", "audit-state"))
    events = _events(spark, sf).select("run_id", "ts", "seq", "action")
    for part in (F.col("action") == "created", F.col("action") != "created"):
        events.where(part).write.mode("append").parquet(source)
        audit.audit_append(spark, source, target, state)
    return audit.audit_trail(spark, target)


@query("run_status_stream", _RUN_STATUS)
def run_status_stream(spark, sf):
    """The event log as files of one event type each, folded into run states file by file."""
    source, target, state = (scratch_path(spark, n) for n in ("events", "status", "state"))
    _events(spark, sf).repartition("action").write.partitionBy("action").parquet(source)
    audit.follow_run_status(spark, source, target, state, files_per_batch=1)
    return audit.current_run_status(spark, target)


add("audit_append", _audit_log, "SELECT run_id, ts, seq, action FROM acts")

# ------------------------------------------------------------ larger test data


@query("scale_out", """
SELECT i AS copy_no, s_suppkey AS vendor_number, CASE WHEN i = 0 THEN o.o_orderkey::VARCHAR ELSE o.o_orderkey::VARCHAR || '-' || i::VARCHAR END AS po_number,
  o_orderdate::DATE + (i % 120 * 30)::INTEGER AS po_date, (o_totalprice::DECIMAL(18,2) + 0.37 * i)::DECIMAL(18,2) AS line_amount
FROM (SELECT *, o_custkey AS s_suppkey FROM orders) o, (SELECT unnest(range(3))::INTEGER AS i)""")
def scale_out(spark, sf):
    rows = v.table(spark, sf, "orders").select(F.col("o_custkey").alias("vendor_number"), F.col("o_orderkey").cast("string").alias("po_number"),
                                               F.col("o_orderdate").cast("date").alias("po_date"), F.col("o_totalprice").cast(s.MONEY).alias("line_amount"))
    return runs.scale_out(rows, 3, ["po_date"], ["line_amount"], ["po_number"])
