"""A settlement ledger for many merchants, derived from an orders table.

The bodies below mean the same in Spark SQL and in DuckDB. `@date(x)` is the day
x days after 2026-07-01. Each merchant gets payments, a gateway report with
refunds, chargebacks and transfers, payouts, and bank credits with the defects a
reconciliation has to face: lost and cut references, merged, missing and short
credits, twins that cannot be told apart, and deposits from elsewhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import cut, stamp

BODIES = {
    "base": """
SELECT CAST(floor(o_custkey / 60) AS bigint) AS merchant_id, o_orderkey AS k,
       CAST(round(CAST(o_totalprice AS decimal(18,2)) * 100, 0) AS bigint) AS amount,
       CAST(o_orderkey % 21 AS int) AS d, CAST(floor(o_orderkey / 21) % 2 AS int) AS cycle
FROM {orders}""",
    "ledger_orders": """
SELECT merchant_id, concat('order_', CAST(k AS string)) AS order_id, concat('rcpt_', CAST(k AS string)) AS order_receipt,
       amount, 'INR' AS currency, @date(d) AS created_on
FROM {base}""",
    "sold": """
SELECT s.*, CASE WHEN method <> 'card' THEN NULL WHEN floor(k / 20) % 20 = 0 THEN 'international'
                 WHEN floor(k / 20) % 20 IN (1, 2) THEN 'domestic_corporate' ELSE 'domestic_consumer' END AS card_type
FROM (SELECT b.*, CASE WHEN k % 20 < 9 THEN 'upi' WHEN k % 20 < 16 THEN 'card' WHEN k % 20 < 18 THEN 'netbanking'
                       WHEN k % 20 = 18 THEN 'wallet' ELSE 'emi' END AS method
      FROM {base} b WHERE k % 25 <> 0) s""",
    "payments": """
SELECT merchant_id, concat('pay_', CAST(k AS string)) AS payment_id, concat('order_', CAST(k AS string)) AS order_id, amount, method, card_type,
       CASE WHEN method = 'card' THEN CASE WHEN k % 3 = 0 THEN 'Visa' WHEN k % 3 = 1 THEN 'Mastercard' ELSE 'RuPay' END END AS card_network,
       @date(d) AS captured_on
FROM {sold}""",
    "priced": """
SELECT merchant_id, k, d, cycle, amount, method, card_type, due, fee,
       CAST(round(CAST(fee AS decimal(20,0)) * CAST(0.18 AS decimal(6,4)), 0) AS bigint) AS tax,
       CASE WHEN merchant_id % 8 = 5 THEN CAST(round(CAST(amount AS decimal(20,0)) * CAST(0.01 AS decimal(6,4)), 0) AS bigint) ELSE 0 END AS tds,
       concat('setl_', CAST(merchant_id AS string), '_', lpad(CAST(due AS string), 2, '0'), '_', CAST(cycle AS string)) AS settlement_id
FROM (SELECT p.*, CAST(round(CAST(amount AS decimal(20,0)) * CASE
                  WHEN card_type = 'domestic_corporate' THEN CAST(0.0215 AS decimal(6,4))
                  WHEN card_type = 'international' THEN CAST(0.03 AS decimal(6,4))
                  WHEN card_type = 'domestic_consumer' AND floor(k / 7) % 4 = 0 THEN CAST(0.0215 AS decimal(6,4))
                  ELSE CAST(0.02 AS decimal(6,4)) END, 0) AS bigint) AS fee,
             d - b + n + 2 * CAST(floor((w + n) / 5) AS int) AS due
      FROM (SELECT s.*, greatest(0, (d + 2) % 7 - 4) AS b, least((d + 2) % 7, 4) AS w,
                   CASE WHEN card_type = 'international' THEN 7 ELSE 2 END AS n
            FROM {sold} s WHERE floor(k / 7) % 71 <> 0) p) q""",
    "first_batches": """
SELECT merchant_id, settlement_id, due, gross, row_number() OVER (PARTITION BY merchant_id ORDER BY due, settlement_id) AS rn
FROM (SELECT merchant_id, settlement_id, due, sum(amount) AS gross FROM {priced} GROUP BY merchant_id, settlement_id, due) g""",
    "twinned": """
SELECT merchant_id, max(settlement_id) AS settlement_id FROM {first_batches} WHERE merchant_id % 5 = 0 GROUP BY merchant_id""",
    "refund_asks": """
SELECT r.*, principal + fee + tax AS debit
FROM (SELECT q.*, CAST(round(CAST(fee AS decimal(20,0)) * CAST(0.18 AS decimal(6,4)), 0) AS bigint) AS tax
      FROM (SELECT p.merchant_id, p.k, p.d, f.rn AS own_rn, CAST(floor(p.amount / 4) AS bigint) AS principal,
                   CAST(CASE WHEN p.k % 85 <> 3 THEN 0 WHEN floor(p.amount / 4) <= 100000 THEN 799 WHEN floor(p.amount / 4) <= 2500000 THEN 1199 ELSE 1499 END AS bigint) AS fee
            FROM {priced} p JOIN {first_batches} f ON p.merchant_id = f.merchant_id AND p.settlement_id = f.settlement_id
            WHERE p.k % 17 = 3) q) r""",
    "refund_homes": """
SELECT merchant_id, k, settlement_id, due
FROM (SELECT r.merchant_id, r.k, f.settlement_id, f.due,
             row_number() OVER (PARTITION BY f.merchant_id, f.settlement_id ORDER BY r.k) AS place
      FROM {refund_asks} r JOIN {first_batches} f ON r.merchant_id = f.merchant_id AND f.rn = r.own_rn + 6
      LEFT JOIN {twinned} t ON t.merchant_id = f.merchant_id AND t.settlement_id = f.settlement_id
      WHERE r.debit * 2 <= f.gross AND t.settlement_id IS NULL) h
WHERE place = 1""",
    "plain_rows": """
SELECT merchant_id, concat('pay_', CAST(k AS string)) AS entity_id, 'payment' AS type, CAST(0 AS bigint) AS debit, amount - fee - tax - tds AS credit,
       amount, fee, tax, false AS on_hold, @date(d) AS created_on, @date(due) AS settled_on, settlement_id,
       concat('order_', CAST(k AS string)) AS order_id, concat('pay_', CAST(k AS string)) AS payment_id, method, card_type,
       CASE WHEN method = 'card' THEN CASE WHEN k % 3 = 0 THEN 'Visa' WHEN k % 3 = 1 THEN 'Mastercard' ELSE 'RuPay' END END AS card_network
FROM {priced}
UNION ALL
SELECT r.merchant_id, concat('rfnd_', CAST(r.k AS string)), 'refund', r.debit, CAST(0 AS bigint), r.principal, r.fee, r.tax,
       h.settlement_id IS NULL AND r.k % 34 = 3, @date(r.d + 3), @date(h.due), h.settlement_id,
       concat('order_', CAST(r.k AS string)), concat('pay_', CAST(r.k AS string)), NULL, NULL, NULL
FROM {refund_asks} r LEFT JOIN {refund_homes} h ON h.merchant_id = r.merchant_id AND h.k = r.k
UNION ALL
SELECT merchant_id, concat('adj_', CAST(k AS string)), 'adjustment', CAST(floor(amount / 10) AS bigint), CAST(0 AS bigint), CAST(floor(amount / 10) AS bigint), CAST(0 AS bigint), CAST(0 AS bigint),
       false, @date(due), @date(due), settlement_id, concat('order_', CAST(k AS string)), concat('pay_', CAST(k AS string)), NULL, NULL, NULL
FROM {priced} WHERE k % 67 = 5
UNION ALL
SELECT merchant_id, concat('trf_', CAST(k AS string)), 'transfer', principal + fee + CAST(round(CAST(fee AS decimal(20,0)) * CAST(0.18 AS decimal(6,4)), 0) AS bigint), CAST(0 AS bigint),
       principal, fee, CAST(round(CAST(fee AS decimal(20,0)) * CAST(0.18 AS decimal(6,4)), 0) AS bigint),
       false, @date(d), @date(due), settlement_id, concat('order_', CAST(k AS string)), concat('pay_', CAST(k AS string)), NULL, NULL, NULL
FROM (SELECT t.*, CAST(round(CAST(principal AS decimal(20,0)) * CAST(0.001 AS decimal(6,4)), 0) AS bigint) AS fee
      FROM (SELECT merchant_id, k, d, due, settlement_id, CAST(floor(amount * 3 / 10) AS bigint) AS principal FROM {priced} WHERE k % 50 = 7) t) x""",
    "settlement_rows": """
SELECT s.*, CASE WHEN settlement_id IS NULL THEN NULL ELSE upper(substr(md5(settlement_id), 1, 12)) END AS settlement_utr
FROM (SELECT * FROM {plain_rows}
      UNION ALL
      SELECT p.merchant_id, concat(entity_id, 't'), type, debit, credit, amount, fee, tax, on_hold, created_on, settled_on, concat(p.settlement_id, 't'),
             order_id, concat(payment_id, 't'), method, card_type, card_network
      FROM {plain_rows} p JOIN {twinned} t ON p.merchant_id = t.merchant_id AND p.settlement_id = t.settlement_id) s""",
    "paid_out": """
SELECT b.*, f.due, f.rn, upper(substr(md5(b.settlement_id), 1, 12)) AS utr, t.settlement_id IS NOT NULL AS twin
FROM (SELECT merchant_id, settlement_id, CASE WHEN substr(settlement_id, length(settlement_id), 1) = 't' THEN substr(settlement_id, 1, length(settlement_id) - 1) ELSE settlement_id END AS first_id,
             sum(credit - debit) AS net, sum(CASE WHEN type = 'payment' THEN amount ELSE 0 END) AS gross,
             sum(CASE WHEN type = 'payment' THEN fee ELSE 0 END) AS fee, sum(CASE WHEN type = 'payment' THEN tax ELSE 0 END) AS tax
      FROM {settlement_rows} WHERE settlement_id IS NOT NULL GROUP BY merchant_id, settlement_id) b
JOIN {first_batches} f ON f.merchant_id = b.merchant_id AND f.settlement_id = b.first_id
LEFT JOIN {twinned} t ON t.merchant_id = b.merchant_id AND t.settlement_id = b.first_id""",
    "open_refunds": """
SELECT merchant_id, debit, row_number() OVER (PARTITION BY merchant_id ORDER BY entity_id) AS place
FROM {settlement_rows} WHERE type = 'refund' AND settlement_id IS NULL""",
    "paid_lines": """
SELECT p.merchant_id, p.settlement_id, p.utr, p.due, p.net,
       CASE WHEN p.twin THEN 'twin' WHEN rn % 16 = 15 THEN 'missing' WHEN rn % 16 = 5 THEN 'hidden_fee' WHEN rn % 16 = 7 THEN 'wrong_gst'
            WHEN rn % 16 = 12 AND o.debit IS NOT NULL AND o.debit < p.net THEN 'refund_elsewhere' WHEN rn % 16 IN (9, 10) THEN 'merged'
            WHEN rn % 48 = 24 THEN 'posted_twice'
            WHEN rn % 3 = 1 THEN 'reference_lost' WHEN rn % 5 = 2 THEN 'reference_cut' ELSE 'none' END AS defect,
       CAST(CASE WHEN p.twin THEN 0
            WHEN rn % 16 = 5 THEN round(CAST(gross AS decimal(20,0)) * CAST(0.0015 AS decimal(6,4)), 0) + round(round(CAST(gross AS decimal(20,0)) * CAST(0.0015 AS decimal(6,4)), 0) * CAST(0.18 AS decimal(6,4)), 0)
            WHEN rn % 16 = 7 THEN round(CAST(fee AS decimal(20,0)) * CAST(0.28 AS decimal(6,4)), 0) - tax
            WHEN rn % 16 = 12 AND o.debit IS NOT NULL AND o.debit < p.net THEN o.debit ELSE 0 END AS bigint) AS short,
       CAST(CASE WHEN p.twin OR rn % 16 IN (5, 7, 12) THEN 0 ELSE tax - round(CAST(fee AS decimal(20,0)) * CAST(0.18 AS decimal(6,4)), 0) END AS bigint) AS drift,
       CASE WHEN p.twin THEN p.settlement_id WHEN rn % 16 = 10 THEN CAST(rn - 1 AS string) ELSE CAST(rn AS string) END AS line,
       rn
FROM {paid_out} p LEFT JOIN {open_refunds} o ON o.merchant_id = p.merchant_id AND p.rn % 16 = 12 AND o.place = floor(p.rn / 16) + 1""",
    "bank_credits": """
SELECT merchant_id, credit_id, amount, @date(on_day) AS value_date, narration, utr
FROM (SELECT merchant_id, concat('bank_', CAST(merchant_id AS string), '_', line) AS credit_id, CAST(sum(net + drift - short) AS bigint) AS amount,
             max(CASE WHEN defect = 'reference_cut' THEN due + 5 ELSE due END) AS on_day,
             max(CASE WHEN defect IN ('twin', 'merged', 'reference_lost') OR defect = 'none' AND rn % 4 = 0 THEN 'NEFT CR RAZORPAY SOFTWARE PVT LTD SETTLEMENT'
                      WHEN defect = 'reference_cut' THEN concat('NEFT CR RAZORPAY SOFTWARE PVT LTD ', substr(utr, 1, 10))
                      ELSE concat('NEFT CR ', utr, ' RAZORPAY SOFTWARE PVT LTD') END) AS narration,
             max(CASE WHEN defect = 'none' AND rn % 4 = 0 THEN utr END) AS utr
      FROM {paid_lines} WHERE defect <> 'missing' GROUP BY merchant_id, line
      UNION ALL
      SELECT merchant_id, concat('bank_', CAST(merchant_id AS string), '_', line, '_again'), CAST(net + drift - short AS bigint), due, concat('NEFT CR ', utr, ' RAZORPAY SOFTWARE PVT LTD'), NULL
      FROM {paid_lines} WHERE defect = 'posted_twice'
      UNION ALL
      SELECT merchant_id, concat('bank_', CAST(merchant_id AS string), '_z', CAST(n AS string)), CAST(7654321 + 111111 * n + 13 * merchant_id AS bigint), CAST(3 + 7 * n AS int),
             concat('NEFT ACME TRADERS REF', CAST(1000 + n AS string)), NULL
      FROM (SELECT DISTINCT merchant_id FROM {base}) m CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2) z) c""",
    "credit_truth": """
SELECT merchant_id, credit_id, defect, matchable, provable
FROM (SELECT merchant_id, concat('bank_', CAST(merchant_id AS string), '_', line) AS credit_id, max(defect) AS defect,
             max(defect) NOT IN ('twin', 'posted_twice') AS matchable, sum(short) = 0 AS provable
      FROM {paid_lines} WHERE defect <> 'missing' GROUP BY merchant_id, line
      UNION ALL
      SELECT merchant_id, concat('bank_', CAST(merchant_id AS string), '_', line, '_again'), defect, false, true FROM {paid_lines} WHERE defect = 'posted_twice'
      UNION ALL
      SELECT merchant_id, credit_id, 'orphan', false, false FROM {bank_credits} WHERE narration LIKE 'NEFT ACME%') t""",
    "truth_links": """
SELECT merchant_id, concat('bank_', CAST(merchant_id AS string), '_', line) AS credit_id, settlement_id FROM {paid_lines} WHERE defect <> 'missing'""",
    "leak_truth": """
SELECT p.merchant_id, concat('pay_', CAST(p.k AS string), s.suffix) AS payment_id
FROM {priced} p
JOIN (SELECT '' AS suffix UNION ALL SELECT 't') s ON s.suffix = '' OR p.merchant_id % 5 = 0
LEFT JOIN {twinned} t ON t.merchant_id = p.merchant_id AND t.settlement_id = p.settlement_id
WHERE p.card_type = 'domestic_consumer' AND floor(p.k / 7) % 4 = 0 AND (s.suffix = '' OR t.settlement_id IS NOT NULL)
  AND p.fee > CAST(round(CAST(p.amount AS decimal(20,0)) * CAST(0.02 AS decimal(6,4)), 0) AS bigint)""",
}

#: Tables that others read more than once: their lineage is cut.
CUT = ("base", "payments", "priced", "first_batches", "refund_asks", "settlement_rows", "paid_lines", "bank_credits")

_DATE = re.compile(r"@date\(([^()]*)\)")


def spark_body(name: str) -> str:
    return _DATE.sub(r"date_add(DATE'2026-07-01', CAST(\1 AS int))", BODIES[name])


def duckdb_body(name: str) -> str:
    body = _DATE.sub(r"(DATE '2026-07-01' + CAST(\1 AS integer))", BODIES[name])
    return re.sub(r"\{(\w+)\}", r"\1", body)


@dataclass(frozen=True)
class Ledger:
    """The tables of one run, all merchants together. The truth, where it is known, is only for scoring."""

    orders: DataFrame
    payments: DataFrame
    rows: DataFrame
    credits: DataFrame
    truth: DataFrame | None = None
    truth_links: DataFrame | None = None
    leak_truth: DataFrame | None = None


#: The given tables and the columns that the rules read.
TABLES = {
    "orders": "merchant_id order_id amount",
    "payments": "merchant_id payment_id order_id amount method card_type captured_on",
    "settlement_rows": "merchant_id entity_id type debit credit amount fee tax created_on settled_on settlement_id settlement_utr payment_id order_id method card_type",
    "bank_credits": "merchant_id credit_id amount value_date narration utr",
}


def given(tables: dict[str, DataFrame]) -> Ledger:
    """A ledger from the four tables as they are given. One merchant's tables may lack merchant_id; other columns stay."""
    made = []
    for name, columns in TABLES.items():
        df = tables[name]
        if "merchant_id" not in df.columns:
            df = df.withColumn("merchant_id", F.lit(0).cast("long"))
        if missing := [c for c in columns.split() if c not in df.columns]:
            raise ValueError(f"{name} lacks {', '.join(missing)}")
        made.append(df)
    return Ledger(*made)


def read(spark: SparkSession, folder: str) -> Ledger:
    """A ledger from a folder with the four tables as Parquet."""
    return given({name: spark.read.parquet(f"{folder}/{name}.parquet") for name in TABLES})


_loaded: dict[tuple, dict[str, DataFrame]] = {}


def derive(orders: DataFrame) -> dict[str, DataFrame]:
    """Every table of the ledger from orders (o_orderkey, o_custkey, o_totalprice)."""
    frames = {"orders": orders.select("o_orderkey", "o_custkey", "o_totalprice")}
    for name in BODIES:
        body = spark_body(name)
        made = orders.sparkSession.sql(body, **{x: frames[x] for x in set(re.findall(r"\{(\w+)\}", body))})
        frames[name] = cut(made) if name in CUT else made
    return frames


def frames_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every table derived from a folder's orders, kept for the session."""
    key = (spark.sparkContext.applicationId, *stamp(spark, f"{sf_dir}/orders.parquet"))
    if key not in _loaded:
        _loaded[key] = derive(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return _loaded[key]


def load(spark: SparkSession, sf_dir: str) -> Ledger:
    f = frames_of(spark, sf_dir)
    return Ledger(f["ledger_orders"], f["payments"], f["settlement_rows"], f["bank_credits"], f["credit_truth"], f["truth_links"], f["leak_truth"])
