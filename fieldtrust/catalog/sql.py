"""Shared fragments of the SQL twins (DuckDB dialect)."""

from __future__ import annotations

FIELDS = [
    "invoice_number", "invoice_date", "due_date", "vendor_name", "vendor_gstin", "vendor_address",
    "buyer_name", "buyer_gstin", "currency", "subtotal", "total_amount", "tax",
]


def n1(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[\s\p{{Z}}]+', ' ', 'g'))"


def n2(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def n3(x: str) -> str:
    return rf"try_cast(regexp_replace({x}, '[^0-9.\-]', '', 'g') AS DOUBLE)"


def n4(x: str) -> str:
    forms = "['%Y-%m-%d','%d/%m/%Y','%d-%m-%Y','%m/%d/%Y','%d.%m.%Y','%B %d, %Y','%d %B %Y']"
    return f"coalesce(strftime(try_strptime(trim({x}), {forms}), '%Y-%m-%d'), trim({x}))"


def rendered_date(k: str, d: str) -> str:
    return f"""CASE {k} % 7 WHEN 0 THEN strftime({d}, '%Y-%m-%d') WHEN 1 THEN strftime({d}, '%d/%m/%Y')
        WHEN 2 THEN strftime({d}, '%d-%m-%Y') WHEN 3 THEN strftime({d}, '%m/%d/%Y')
        WHEN 4 THEN strftime({d}, '%d.%m.%Y') WHEN 5 THEN strftime({d}, '%B %d, %Y')
        ELSE strftime({d}, '%d %B %Y') END"""


RECORDS = """
totals AS (
  SELECT l_orderkey AS k, min(l_suppkey) AS suppkey,
    round(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1.0::DOUBLE - l_discount AS DECIMAL(3,2))), 2) AS net,
    round(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1.0::DOUBLE - l_discount AS DECIMAL(3,2))
              * CAST(l_tax AS DECIMAL(3,2))), 2) AS tax
  FROM lineitem GROUP BY l_orderkey),
records AS (
  SELECT o_orderkey AS k, 'invoice_' || o_orderkey || '.pdf' AS doc_name,
    'INV-' || o_orderkey AS invoice_number,
    strftime(o_orderdate, '%Y-%m-%d') AS invoice_date,
    CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS due_date,
    s_name AS vendor_name, '27GST' || lpad(s_suppkey::VARCHAR, 10, '0') AS vendor_gstin,
    s_suppkey || ' Trade Street, ' || n_name AS vendor_address,
    c_name AS buyer_name,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN '29GST' || lpad(c_custkey::VARCHAR, 10, '0') END AS buyer_gstin,
    'INR' AS currency, net::DOUBLE AS subtotal, (net + tax)::DOUBLE AS total_amount, tax::DOUBLE AS tax
  FROM orders JOIN totals ON o_orderkey = totals.k JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""

_NUM = ("subtotal", "total_amount", "tax")


def _truth_rows() -> str:
    return ", ".join(
        f"{{'i': {i}, 'field': '{f}', 'truth': {f}::VARCHAR, 'truth_num': {f if f in _NUM else 'NULL::DOUBLE'}}}"
        for i, f in enumerate(FIELDS)
    )


_PRED = {
    "invoice_number": "CASE WHEN k % 97 = 5 THEN NULL WHEN k % 10 = 3 THEN '  ' || lower(invoice_number) || ' ' ELSE invoice_number END",
    "invoice_date": rendered_date("k", "invoice_date::DATE"),
    "due_date": "strftime(due_date::DATE, '%d/%m/%Y')",
    "vendor_name": "upper(vendor_name) || '  '",
    "vendor_gstin": "CASE WHEN k % 29 <> 0 THEN vendor_gstin END",
    "vendor_address": "replace(vendor_address, ', ', chr(10))",
    "buyer_name": "CASE WHEN k % 11 = 0 THEN 'Unknown Buyer' ELSE buyer_name END",
    "buyer_gstin": "buyer_gstin",
    "currency": "'inr'",
    "subtotal": "'INR ' || format('{:,.2f}', subtotal + CASE WHEN k % 13 = 0 THEN 0.01::DOUBLE WHEN k % 17 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)",
    "total_amount": "format('{:,.2f}', total_amount)",
    "tax": "CASE WHEN k % 19 <> 0 THEN format('{:,.2f}', tax) END",
}
_PRED_NUM = {
    "total_amount": "total_amount",
    "tax": "CASE WHEN k % 19 <> 0 THEN tax END",
}


def _pred_rows() -> str:
    return ", ".join(
        f"{{'i': {i}, 'field': '{f}', 'value': {_PRED[f]}, 'num': {_PRED_NUM.get(f, 'NULL::DOUBLE')}}}"
        for i, f in enumerate(FIELDS)
    )


PRED_LONG = f"""
pred_raw AS (SELECT k, doc_name, unnest([{_pred_rows()}], recursive := true) FROM records),
pred AS (
  SELECT *, 0.5::DOUBLE + ((k * 31 + i * 17) % 51)::DOUBLE / 100.0::DOUBLE AS confidence,
    (k + i) % 23 <> 0 AS located
  FROM pred_raw)"""

GATED = PRED_LONG + """,
gated AS (
  SELECT *, CASE WHEN value IS NOT NULL AND confidence < 0.8::DOUBLE THEN 'abstained' ELSE 'extracted' END AS status
  FROM pred)"""

TRUTH_LONG = f"""
truth AS (SELECT k, doc_name, unnest([{_truth_rows()}], recursive := true) FROM records)"""

SCORED = f"""WITH {RECORDS}, {TRUTH_LONG}, {GATED},
paired AS (
  SELECT t.k, t.doc_name, CASE t.field WHEN 'tax' THEN 'tax.total_tax' ELSE t.field END AS field,
    t.truth, t.truth_num, g.value, g.num, g.confidence, g.located, g.status,
    CASE WHEN g.status <> 'abstained' THEN g.value END AS pv,
    CASE WHEN g.status <> 'abstained' THEN g.num END AS pn
  FROM truth t JOIN gated g ON t.k = g.k AND t.i = g.i),
scored AS (
  SELECT *, CASE WHEN truth IS NULL THEN NULL WHEN pv IS NULL THEN false
    WHEN field IN ('invoice_date', 'due_date') THEN {n4('pv')} = {n4('truth')}
    WHEN field IN ('subtotal', 'total_amount', 'tax.total_tax')
      THEN coalesce(abs(coalesce(pn, {n3('pv')}) - truth_num) < 0.011::DOUBLE, false)
    WHEN field = 'vendor_address' THEN {n2('pv')} = {n2('truth')}
    ELSE {n1('pv')} = {n1('truth')} END AS correct
  FROM paired)"""

EVENT_SCORES = """WITH base AS (
  SELECT *, (props->>'$.k')::INTEGER AS kk FROM events),
scored AS (
  SELECT user_id AS doc_name, event_id, event_type AS field,
    CASE WHEN event_id % 9 <> 0 THEN value END AS value,
    kk::DOUBLE / 100.0::DOUBLE AS confidence, event_id % 7 <> 0 AS located,
    CASE WHEN event_id % 15 <> 0 THEN value * kk < 4000.0::DOUBLE + kk * kk END AS correct
  FROM base)"""
