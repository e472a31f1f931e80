"""DuckDB SQL that computes the same tables anew, as named common table expressions."""

from __future__ import annotations

import re

from ..functions.text import BANK_WORDS, GATEWAY_WORDS, RAILS, REFERENCE_NOISE
from ..operators.causes import CAUSES, LEAST
from ..sources.ledger import BODIES, duckdb_body


def total(x: str) -> str:
    return f"CAST(coalesce(sum({x}), 0) AS BIGINT)"


def rated(base: str, rate: str) -> str:
    return f"CAST(round(CAST({base} AS DECIMAL(20,0)) * CAST({rate} AS DECIMAL(6,4)), 0) AS BIGINT)"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


PLATFORM = "CASE WHEN method = 'card' AND card_type = 'domestic_corporate' THEN corporate_card WHEN method = 'card' AND card_type = 'international' THEN international_card ELSE standard END"
BAND = "CASE WHEN method <> 'card' OR card_type IS NULL THEN 'standard' WHEN card_type = 'domestic_corporate' THEN 'corporate' WHEN card_type = 'international' THEN 'international' ELSE 'consumer' END"
REFERENCE = rf"list_filter(regexp_extract_all(upper(narration), '\b([A-Z0-9]{{12,22}})\b', 1), lambda x: x NOT IN ({quoted(REFERENCE_NOISE)}) AND regexp_matches(x, '[0-9]'))[1]"
SAID = rf"regexp_replace(regexp_replace(upper(narration), '\b(?:{'|'.join(BANK_WORDS)})\b', ' ', 'g'), '[^A-Z0-9]', '', 'g')"
STEM = rf"array_to_string(regexp_extract_all(regexp_replace(regexp_replace(upper(narration), '\b[A-Z0-9]{{10,22}}\b', ' ', 'g'), '\b(?:{'|'.join(RAILS)})\b', ' ', 'g'), '[A-Z]{{3,}}')[1:4], ' ')"
INR = lambda x: f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || 'Rs ' || CASE WHEN abs({x}) >= 100000 THEN reverse(regexp_replace(regexp_replace(reverse(left(CAST(abs({x}) // 100 AS VARCHAR), -3)), '(\\d\\d)', '\\1,', 'g'), ',$', '')) || ',' || right(CAST(abs({x}) // 100 AS VARCHAR), 3) ELSE CAST(abs({x}) // 100 AS VARCHAR) END || '.' || lpad(CAST(abs({x}) % 100 AS VARCHAR), 2, '0'))"


def days_after(start: str, n: str) -> str:
    """The n-th working day after a day, by walking."""
    return f"CASE WHEN {n} = 0 THEN {start} ELSE list_filter(list_transform(range(1, 40), lambda i: {start} + CAST(i AS INTEGER)), lambda x: isodow(x) < 6)[{n}] END"


def days_between(start: str, end: str) -> str:
    """Signed working days, by walking."""
    ahead = f"len(list_filter(range(1, {end} - {start} + 1), lambda i: isodow({start} + CAST(i AS INTEGER)) < 6))"
    back = f"-len(list_filter(range(1, {start} - {end} + 1), lambda i: isodow({start} - CAST(i AS INTEGER)) < 6))"
    return f"CAST(CASE WHEN {end} >= {start} THEN {ahead} ELSE {back} END AS INTEGER)"


DUE = days_after("captured_on", "CASE WHEN card_type = 'international' THEN 7 ELSE 2 END")
KEY = "merchant_id, credit_id"

CTES = {name: duckdb_body(name) for name in BODIES}
CTES |= {
    "batches": f"""
SELECT merchant_id, settlement_id, arg_min(settlement_utr, entity_id) FILTER (WHERE settlement_utr <> '') AS settlement_utr,
       arg_min(settled_on, entity_id) FILTER (WHERE settled_on IS NOT NULL) AS settled_on, count(*) AS rows,
       count(*) FILTER (WHERE type = 'payment') AS payments,
       {', '.join(f"{total(f"CASE WHEN type = 'payment' THEN {c} ELSE 0 END")} AS {n}" for c, n in (("amount", "gross"), ("fee", "fee"), ("tax", "tax"), ("credit", "pay_credit")))},
       {', '.join(f"{total(f"CASE WHEN type <> 'payment' THEN {c} ELSE 0 END")} AS {n}" for c, n in (("fee", "debit_fee"), ("tax", "debit_tax"), ("debit", "debits"), ("debit - fee - tax", "refund_principal")))},
       {total('credit - debit')} AS expected_net,
       (count(*) FILTER (WHERE type = 'payment' AND tax <> 0) + 1) // 2 + 1 AS allowance
FROM settlement_rows WHERE settlement_id IS NOT NULL GROUP BY merchant_id, settlement_id HAVING count(settled_on) > 0""",
    "held": f"""
SELECT merchant_id, exact, paid, CASE WHEN paid < 12 THEN CASE WHEN paid = 0 THEN false END WHEN exact = paid THEN true WHEN exact * 2 <= paid THEN false END AS held
FROM (SELECT merchant_id, count(*) FILTER (WHERE type = 'payment' AND credit <> 0) AS paid,
             count(*) FILTER (WHERE type = 'payment' AND credit <> 0 AND amount - fee - tax - credit = {rated('amount', '0.01')}) AS exact
      FROM settlement_rows GROUP BY merchant_id)""",
    "pairs": f"""
SELECT merchant_id, {BAND} AS band, fee AS charged, amount AS base FROM settlement_rows WHERE type = 'payment' AND amount > 0 AND method IS NOT NULL
UNION ALL SELECT merchant_id, 'gst', tax, fee FROM settlement_rows WHERE type = 'payment' AND amount > 0 AND method IS NOT NULL AND fee > 0""",
    "votes": """
SELECT merchant_id, band, rate, count(*) AS votes
FROM (SELECT *, CAST(round(CAST(charged AS DECIMAL(28,8)) / CAST(base AS DECIMAL(20,0)), 4) AS DECIMAL(6,4)) AS rate FROM pairs) GROUP BY ALL""",
    "modal": "SELECT merchant_id, band, rate AS candidate, n FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id, band ORDER BY votes DESC, rate) AS place, sum(votes) OVER (PARTITION BY merchant_id, band) AS n FROM votes) WHERE place = 1",
    "induced": f"""
SELECT merchant_id, band, CASE WHEN n >= 12 AND exact >= n * 0.6 THEN candidate END AS rate, CASE WHEN n < 12 THEN 0 ELSE exact END AS rows, CAST(n AS BIGINT) AS "of"
FROM (SELECT p.merchant_id, p.band, any_value(candidate) AS candidate, any_value(n) AS n, count(*) FILTER (WHERE {rated('base', 'candidate')} = charged) AS exact
      FROM pairs p JOIN modal m ON p.merchant_id = m.merchant_id AND p.band = m.band GROUP BY ALL)""",
    "rates": """
SELECT h.merchant_id, coalesce(max(rate) FILTER (WHERE band = 'standard'), max(rate) FILTER (WHERE band = 'consumer'), 0.02::DECIMAL(6,4)) AS standard,
       coalesce(max(rate) FILTER (WHERE band = 'corporate'), 0.0215::DECIMAL(6,4)) AS corporate_card,
       coalesce(max(rate) FILTER (WHERE band = 'international'), 0.03::DECIMAL(6,4)) AS international_card,
       coalesce(max(rate) FILTER (WHERE band = 'gst'), 0.18::DECIMAL(6,4)) AS gst, 0.01::DECIMAL(6,4) AS tds, 0.001::DECIMAL(6,4) AS route,
       coalesce(any_value(held), true) AS tds_applies
FROM held h LEFT JOIN induced i ON h.merchant_id = i.merchant_id GROUP BY h.merchant_id""",
    "leaks": f"""
SELECT *, fee - contracted_fee AS overcharge, CAST(round_even((fee - contracted_fee) * 1.18::DECIMAL(3,2), 0) AS BIGINT) - (fee - contracted_fee) AS gst_on_overcharge
FROM (SELECT *, {rated('amount', 'contracted_rate')} AS contracted_fee
      FROM (SELECT r.*, {PLATFORM} AS contracted_rate FROM settlement_rows r JOIN rates USING (merchant_id) WHERE type = 'payment' AND amount > 0 AND method IS NOT NULL))
WHERE fee > contracted_fee""",
    "complete": "SELECT merchant_id, max(settled_on) AS complete_to FROM settlement_rows WHERE settled_on IS NOT NULL GROUP BY merchant_id",
    "unsettled": f"""
SELECT p.*, complete_to, due FROM (SELECT *, {DUE} AS due FROM payments) p JOIN complete USING (merchant_id)
WHERE due <= complete_to AND NOT EXISTS (SELECT 1 FROM settlement_rows r WHERE r.merchant_id = p.merchant_id AND (r.entity_id = p.payment_id OR r.payment_id = p.payment_id))""",
    "as_of": "SELECT merchant_id, max(captured_on) - 10 AS as_of FROM payments GROUP BY merchant_id",
    "routed": "SELECT r.merchant_id, payment_id, CAST(sum(debit) AS BIGINT) AS routed FROM settlement_rows r JOIN as_of USING (merchant_id) WHERE type = 'transfer' AND payment_id IS NOT NULL AND created_on <= as_of GROUP BY ALL",
    "promised": f"""
SELECT merchant_id, payment_id, as_of, captured_on, due, CASE WHEN card_type = 'international' THEN 7 ELSE 2 END AS cycle_days, amount AS gross, routed,
       amount - fee - {rated('fee', 'gst')} - CASE WHEN tds_applies THEN {rated('amount', 'tds')} ELSE 0 END - routed AS net, due <= as_of AS overdue
FROM (SELECT p.*, as_of, gst, tds, tds_applies, coalesce(routed, 0) AS routed, {DUE} AS due, {rated('amount', PLATFORM)} AS fee
      FROM payments p JOIN as_of USING (merchant_id) LEFT JOIN rates USING (merchant_id) LEFT JOIN routed USING (merchant_id, payment_id)
      WHERE captured_on <= as_of AND NOT EXISTS (SELECT 1 FROM settlement_rows r WHERE r.merchant_id = p.merchant_id AND r.type = 'payment' AND r.settled_on <= as_of AND (r.entity_id = p.payment_id OR r.payment_id = p.payment_id)))""",
    "landed": f"""
SELECT c.merchant_id, c.payment_id, due, net AS predicted, settled_on AS landed_on, coalesce(actual, 0) AS actual,
       CASE WHEN settled_on IS NOT NULL THEN {days_between('due', 'settled_on')} END AS days_out, coalesce(actual, 0) - net AS error
FROM promised c
LEFT JOIN (SELECT r.merchant_id, r.payment_id, r.settled_on, r.credit - r.debit - coalesce((SELECT CAST(sum(t.debit) AS BIGINT) FROM settlement_rows t WHERE t.type = 'transfer' AND t.merchant_id = r.merchant_id AND t.payment_id = r.payment_id), 0) AS actual
           FROM settlement_rows r WHERE r.type = 'payment' AND r.settled_on IS NOT NULL) a USING (merchant_id, payment_id)
WHERE NOT overdue""",
}


#: The longest stretch that two texts have in common, the first of such in x: 100 for each character, less its place in x.
_LONGEST = "list_max(list_filter(flatten(list_transform(range(1, length({x}) + 1), lambda k: list_transform(range(0, length({x}) - k + 1), lambda i: CASE WHEN contains({y}, substr({x}, CAST(i + 1 AS INTEGER), CAST(k AS INTEGER))) THEN k * 100 - i END))), lambda v: v IS NOT NULL))"


def _similar(i: int) -> dict[str, str]:
    """Attempts by similarity. A ratio: the longest common stretch, then the same on both sides of it, by recursion."""
    key = lambda x, y: _LONGEST.format(x=x, y=y)
    return {
        f"win{i}": f"""
SELECT merchant_id, credit_id, settlement_id, x, substr(said, CAST(spot AS INTEGER), length(x) + 3) AS y
FROM (SELECT c.merchant_id, c.credit_id, b.settlement_id, said, regexp_replace(upper(b.settlement_utr), '[^A-Z0-9]', '', 'g') AS x, unnest(range(1, length(said) + 1)) AS spot
      FROM (SELECT *, {SAID} AS said FROM u{i}) c JOIN a{i} b ON b.merchant_id = c.merchant_id WHERE said <> '' AND b.settlement_utr <> '')
WHERE x <> ''""",
        f"ratio{i}": f"""
SELECT x, y, 2.0::DOUBLE * sum((longest + 99) // 100) / (length(x) + length(y)) AS ratio FROM (
WITH RECURSIVE part AS (
SELECT x, y, x AS a, y AS b, {key('x', 'y')} AS longest FROM (SELECT DISTINCT x, y FROM win{i})
UNION ALL
SELECT x, y, a, b, {key('a', 'b')} FROM (
SELECT x, y, CASE WHEN side = 0 THEN substr(a, 1, spot) ELSE substr(a, spot + n + 1) END AS a, CASE WHEN side = 0 THEN substr(b, 1, there) ELSE substr(b, there + n + 1) END AS b
FROM (SELECT *, CAST(strpos(b, substr(a, spot + 1, n)) - 1 AS INTEGER) AS there FROM (SELECT *, CAST((longest + 99) // 100 AS INTEGER) AS n, CAST((longest + 99) // 100 * 100 - longest AS INTEGER) AS spot FROM part WHERE longest IS NOT NULL)), (VALUES (0), (1)) sides(side))
WHERE a <> '' AND b <> '')
SELECT * FROM part) GROUP BY x, y""",
        f"scored{i}": f"""
SELECT *, coalesce(lead(score) OVER near, 0.0) AS second, lead(settlement_id) OVER near AS second_id, row_number() OVER near AS place
FROM (SELECT *, max(score) OVER (PARTITION BY merchant_id, credit_id) AS best
      FROM (SELECT merchant_id, credit_id, settlement_id, max(ratio) AS score FROM win{i} JOIN ratio{i} USING (x, y) GROUP BY ALL))
WHERE best >= 0.78::DOUBLE AND best - score < 0.10::DOUBLE
WINDOW near AS (PARTITION BY merchant_id, credit_id ORDER BY score DESC, settlement_id)""",
        f"t{i}": f"""
SELECT u.merchant_id, u.credit_id, u.amount, 'fuzzy_narration' AS strategy, CASE WHEN score IS NULL THEN 'NO_CANDIDATE' WHEN score - second >= 0.10::DOUBLE THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS verdict,
       CASE WHEN score - second >= 0.10::DOUBLE THEN [settlement_id] ELSE [] END AS ids,
       CASE WHEN score IS NULL THEN [] WHEN score - second >= 0.10::DOUBLE THEN [settlement_id] ELSE list_filter([settlement_id, second_id], lambda v: v IS NOT NULL) END AS candidates,
       CASE WHEN score - second >= 0.10::DOUBLE THEN least(0.70::DOUBLE, 0.40::DOUBLE + 0.35::DOUBLE * score) ELSE 0.0::DOUBLE END AS confidence
FROM u{i} u LEFT JOIN (SELECT * FROM scored{i} WHERE place = 1) USING (merchant_id, credit_id)""",
    }


def _rung(i: int, name: str, anchored: bool = False) -> dict[str, str]:
    """The expressions of one rung over credits u{i} and batches a{i}; anchored: and the outcome o{i - 1}."""
    near = lambda before, after: f"FROM u{i} c JOIN a{i} b ON b.merchant_id = c.merchant_id AND b.settled_on BETWEEN c.value_date - {before} AND c.value_date + {after}"
    out, fits = {}, ""
    if name == "exact":
        fits = f"SELECT c.{KEY.replace(', ', ', c.')}, [b.settlement_id] AS ids, 1.0::DOUBLE AS sure FROM (SELECT *, coalesce(nullif(utr, ''), {REFERENCE}) AS ref FROM u{i}) c JOIN a{i} b ON b.merchant_id = c.merchant_id AND b.settlement_utr = c.ref"
    elif name == "amount":
        fits = f"SELECT c.merchant_id, c.credit_id, [b.settlement_id] AS ids, CASE WHEN amount = expected_net THEN 0.95::DOUBLE ELSE 0.80::DOUBLE - 0.10::DOUBLE * abs(amount - expected_net) / allowance END AS sure {near(1, 1)} WHERE abs(amount - expected_net) <= allowance"
    elif name == "short":
        band = "(greatest(standard, corporate_card, international_card) * (1 + gst) + CASE WHEN tds_applies THEN tds ELSE 0 END)"
        fits = f"SELECT c.merchant_id, c.credit_id, [b.settlement_id] AS ids, 0.35::DOUBLE AS sure {near(1, 1)} JOIN rates r ON r.merchant_id = c.merchant_id WHERE expected_net - amount > allowance AND expected_net - amount <= expected_net * {band}"
    elif name == "subset":
        out[f"pool{i}"] = f"""
SELECT * FROM (SELECT c.merchant_id, c.credit_id, c.amount, b.settlement_id, b.expected_net AS net, b.allowance,
       row_number() OVER (PARTITION BY c.merchant_id, c.credit_id ORDER BY b.expected_net DESC, b.settlement_id) AS place,
       count(*) OVER (PARTITION BY c.merchant_id, c.credit_id) AS n {near(3, 1)} WHERE expected_net > 0 AND expected_net <= amount + allowance) WHERE n > 1"""
        two = f"pool{i} p JOIN pool{i} q ON p.merchant_id = q.merchant_id AND p.credit_id = q.credit_id AND p.place < q.place"
        three = f"{two} JOIN pool{i} s ON p.merchant_id = s.merchant_id AND p.credit_id = s.credit_id AND q.place < s.place"
        sure = "CASE WHEN gap = 0 THEN 0.75::DOUBLE ELSE 0.65::DOUBLE END - 0.05::DOUBLE * (len(ids) - 2)"
        if anchored:
            out[f"n{i}"] = f"SELECT x.merchant_id, x.credit_id, list(x.settlement_id) AS anchors FROM (SELECT merchant_id, credit_id, unnest(withdrawn) AS settlement_id FROM o{i - 1}) x JOIN a{i} USING (merchant_id, settlement_id) GROUP BY ALL"
            out[f"pool{i}"] = f"SELECT z.*, coalesce(anchors, []) AS anchors FROM ({out.pop(f'pool{i}')}) z LEFT JOIN n{i} USING (merchant_id, credit_id)"
            sure = f"CASE WHEN len(anchors) > 0 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + {sure}"
        kept, named = (" AND list_has_all([p.settlement_id, q.settlement_id], p.anchors)", "p.anchors, ") if anchored else ("", "")
        fits = f"""SELECT merchant_id, credit_id, ids, {sure} AS sure FROM (
SELECT p.merchant_id, p.credit_id, {named}[p.settlement_id] AS ids, abs(p.amount - p.net) AS gap FROM pool{i} p WHERE abs(p.amount - p.net) <= p.allowance{" AND (len(anchors) = 0 OR list_contains(anchors, settlement_id))" if anchored else ""}
UNION ALL SELECT p.merchant_id, p.credit_id, {named}[p.settlement_id, q.settlement_id], abs(p.amount - p.net - q.net) FROM {two} WHERE abs(p.amount - p.net - q.net) <= p.allowance + q.allowance{kept}
UNION ALL SELECT p.merchant_id, p.credit_id, {named}[p.settlement_id, q.settlement_id, s.settlement_id], abs(p.amount - p.net - q.net - s.net) FROM {three}
WHERE NOT (abs(p.amount - p.net - q.net) <= p.allowance + q.allowance{kept}) AND abs(p.amount - p.net - q.net - s.net) <= p.allowance + q.allowance + s.allowance{" AND list_has_all([p.settlement_id, q.settlement_id, s.settlement_id], p.anchors)" if anchored else ""})"""
    if name == "fuzzy":
        return _similar(i) | _after(i)
    strategy = {"exact": "exact_utr", "amount": "amount_date", "subset": "subset_sum", "short": "shortfall"}[name]
    out[f"f{i}"] = fits
    out[f"t{i}"] = f"""
SELECT u.merchant_id, u.credit_id, u.amount, '{strategy}' AS strategy, CASE WHEN n IS NULL THEN 'NO_CANDIDATE' WHEN n = 1 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS verdict,
       CASE WHEN n = 1 THEN list_sort(ids) ELSE [] END AS ids, coalesce(every, []) AS candidates, CASE WHEN n = 1 THEN sure ELSE 0.0::DOUBLE END AS confidence
FROM u{i} u LEFT JOIN (SELECT merchant_id, credit_id, count(*) AS n, any_value(ids) AS ids, list_sort(list_distinct(flatten(list(ids)))) AS every, max(sure) AS sure FROM f{i} GROUP BY merchant_id, credit_id) g USING (merchant_id, credit_id)"""
    return out | _after(i)


def _after(i: int) -> dict[str, str]:
    """What becomes of a rung's attempts t{i}: the veto, contested payouts, the fold."""
    out = {}
    out[f"w{i}"] = f"""
SELECT t.* REPLACE (CASE WHEN broken THEN 'NO_CANDIDATE' ELSE verdict END AS verdict, CASE WHEN broken THEN [] ELSE ids END AS ids, CASE WHEN broken THEN 0.0::DOUBLE ELSE confidence END AS confidence), CASE WHEN broken THEN ids ELSE [] END AS withdrawn
FROM (SELECT t.*, coalesce(abs(amount - explained) > allowance, false) AS broken FROM t{i} t
      LEFT JOIN (SELECT x.merchant_id, x.credit_id, sum(pay_credit - debits) AS explained, sum(allowance) AS allowance
                 FROM (SELECT merchant_id, credit_id, unnest(ids) AS settlement_id FROM t{i} WHERE verdict = 'MATCHED') x JOIN batches USING (merchant_id, settlement_id) GROUP BY ALL) s USING (merchant_id, credit_id)) t"""
    out[f"b{i}"] = f"""
SELECT merchant_id, unnest(claimants) AS credit_id, settlement_id, claimants
FROM (SELECT merchant_id, settlement_id, list_sort(list(credit_id)) AS claimants FROM (SELECT merchant_id, credit_id, unnest(ids) AS settlement_id FROM w{i} WHERE verdict = 'MATCHED') GROUP BY ALL) WHERE len(claimants) > 1"""
    out[f"d{i}"] = f"""
SELECT w.merchant_id, w.credit_id, strategy, CASE WHEN blame IS NULL THEN verdict ELSE 'AMBIGUOUS' END AS verdict, CASE WHEN blame IS NULL THEN ids ELSE [] END AS ids,
       CASE WHEN blame IS NULL THEN candidates ELSE [blame] END AS candidates, CASE WHEN blame IS NULL THEN confidence ELSE 0.0::DOUBLE END AS confidence, withdrawn,
       CASE WHEN blame IS NULL THEN [] ELSE list_filter(rivals, lambda x: x <> w.credit_id) END AS contested
FROM w{i} w LEFT JOIN (SELECT merchant_id, credit_id, min(settlement_id) AS blame, arg_min(claimants, settlement_id) AS rivals FROM b{i} GROUP BY ALL) USING (merchant_id, credit_id)"""
    if i % 10 == 0:
        out[f"o{i}"] = f"SELECT * FROM d{i}"
    else:
        old = "d.verdict = 'NO_CANDIDATE' AND o.verdict = 'AMBIGUOUS'"
        fields = ", ".join(f"CASE WHEN {old} THEN o.{c} ELSE d.{c} END AS {c}" for c in ("strategy", "verdict", "ids", "candidates", "confidence"))
        out[f"o{i}"] = f"""
SELECT d.merchant_id, d.credit_id, {fields}, CASE WHEN d.verdict = 'MATCHED' OR len(d.withdrawn) > 0 THEN d.withdrawn ELSE coalesce(o.withdrawn, d.withdrawn) END AS withdrawn,
       CASE WHEN {old} THEN o.contested ELSE d.contested END AS contested
FROM d{i} d LEFT JOIN o{i - 1} o USING (merchant_id, credit_id)"""
    return out


FULL = ("exact", "amount", "subset", "fuzzy", "short")
PLAIN = ("exact", "amount", "subset", "short")


def outcome_after(rungs: int, base: int = 0) -> str:
    """The outcome of every credit after so many rungs of a chain."""
    last = base + rungs - 1
    return " UNION ALL ".join([*(f"SELECT * FROM o{i} WHERE verdict = 'MATCHED'" for i in range(base, last)), f"SELECT * FROM o{last}"])


def _chain(names: tuple[str, ...], base: int, anchored: bool = False) -> None:
    """The rungs in order, numbered from base."""
    for i, name in enumerate(names, base):
        CTES[f"u{i}"] = "SELECT * FROM bank_credits" if i == base else f"SELECT * FROM bank_credits SEMI JOIN (SELECT * FROM o{i - 1} WHERE verdict <> 'MATCHED') USING (merchant_id, credit_id)"
        gone = " UNION ALL ".join(f"SELECT merchant_id, unnest(ids) AS settlement_id FROM o{j} WHERE verdict = 'MATCHED'" for j in range(base, i))
        CTES[f"a{i}"] = "SELECT * FROM batches" if i == base else f"SELECT * FROM batches ANTI JOIN ({gone}) USING (merchant_id, settlement_id)"
        CTES.update(_rung(i, name, anchored))


_chain(FULL, 0)
_chain(PLAIN, 20)
_chain(PLAIN, 40, anchored=True)
CTES |= {
    "outcome": outcome_after(len(FULL)),
    "claims": "SELECT merchant_id, credit_id, strategy, confidence, ids, true AS matched FROM outcome WHERE verdict = 'MATCHED' UNION ALL SELECT merchant_id, credit_id, strategy, confidence, withdrawn, false FROM outcome WHERE verdict <> 'MATCHED' AND len(withdrawn) > 0",
    "tried": f"""
SELECT c.merchant_id, c.credit_id, strategy, confidence, list_sort(ids) AS ids, matched, amount, value_date, narration, explained, allowance, amount - explained AS residual, abs(amount - explained) <= allowance AS proved, gross, fee, tax, n_rows, n_payments
FROM claims c JOIN bank_credits USING (merchant_id, credit_id)
JOIN (SELECT x.merchant_id, x.credit_id, {total('pay_credit - debits')} AS explained, {total('allowance')} AS allowance, {total('gross')} AS gross, {total('fee')} AS fee, {total('tax')} AS tax, {total('rows')} AS n_rows, {total('payments')} AS n_payments
      FROM (SELECT merchant_id, credit_id, unnest(ids) AS settlement_id FROM claims) x JOIN batches USING (merchant_id, settlement_id) GROUP BY ALL) USING (merchant_id, credit_id)""",
    "proofs": "SELECT *, residual AS drift FROM tried WHERE matched AND proved",
    "shorts": "SELECT * FROM tried WHERE NOT matched AND NOT proved",
    "refund_fits": """
SELECT s.merchant_id, s.credit_id, r.entity_id, r.debit, r.settlement_id, r.debit = -s.residual AS exact
FROM shorts s JOIN settlement_rows r ON r.merchant_id = s.merchant_id AND r.type IN ('refund', 'adjustment') AND abs(r.debit + s.residual) <= s.allowance
WHERE s.residual < 0 AND (r.settlement_id IS NULL OR NOT list_contains(s.ids, r.settlement_id))""",
    "refund_exact": "SELECT merchant_id, credit_id, any_value(entity_id) AS entity, any_value(debit) AS debit, coalesce(any_value(settlement_id), 'no batch yet') AS home FROM refund_fits WHERE exact GROUP BY ALL HAVING count(*) = 1",
    "refund_near": "SELECT merchant_id, credit_id, any_value(entity_id) AS entity, any_value(debit) AS debit, coalesce(any_value(settlement_id), 'no batch yet') AS home FROM refund_fits GROUP BY ALL HAVING count(*) = 1",
    "named": f"""
SELECT *, CASE WHEN exact_entity IS NOT NULL THEN 'PARTIAL_PAYMENT' WHEN slab IS NOT NULL THEN 'TAX_DEDUCTION' WHEN near_entity IS NOT NULL THEN 'PARTIAL_PAYMENT' WHEN share IS NOT NULL THEN 'FEE_DEDUCTION' ELSE 'UNEXPLAINED' END AS code
FROM (SELECT s.*, e.entity AS exact_entity, n.entity AS near_entity, coalesce(e.home, n.home) AS home, coalesce(e.entity, n.entity) AS entity,
             CASE WHEN residual < 0 AND fee <> 0 THEN nullif(CASE {' '.join(f"WHEN abs((tax - residual)::DECIMAL(28,8) / fee::DECIMAL(20,0) - {x}) <= 0.005 THEN {x}" for x in ('0.05', '0.12', '0.18', '0.28'))} END, gst) END AS slab,
             CASE WHEN residual < 0 AND gross <> 0 AND CAST(round_even(-residual / (1 + gst::DOUBLE), 0) AS BIGINT)::DOUBLE / gross BETWEEN 0.0005 AND 0.01 THEN CAST(round_even(-residual / (1 + gst::DOUBLE), 0) AS BIGINT)::DOUBLE / gross END AS share
      FROM shorts s JOIN rates USING (merchant_id) LEFT JOIN refund_exact e USING (merchant_id, credit_id) LEFT JOIN refund_near n USING (merchant_id, credit_id))""",
    "missing": """
SELECT b.*, claimed_by, count(*) OVER (PARTITION BY b.merchant_id, settled_on) AS that_day, settlement_id IN (SELECT unnest(ids) FROM proofs p WHERE p.merchant_id = b.merchant_id) AS found
FROM batches b LEFT JOIN (SELECT merchant_id, settlement_id, min(credit_id) AS claimed_by FROM (SELECT merchant_id, credit_id, unnest(withdrawn) AS settlement_id FROM outcome WHERE verdict <> 'MATCHED') GROUP BY ALL) USING (merchant_id, settlement_id)""",
    "unclaimed": "SELECT o.*, amount, value_date, narration FROM outcome o JOIN bank_credits USING (merchant_id, credit_id) ANTI JOIN shorts USING (merchant_id, credit_id) WHERE verdict <> 'MATCHED'",
    "queue": f"""
SELECT merchant_id, code, credit_id AS subject_id, abs(residual) AS amount, array_to_string(ids, ', ') AS settlements, CASE WHEN code = 'PARTIAL_PAYMENT' THEN home END AS recovered_by,
       CASE WHEN code = 'TAX_DEDUCTION' THEN CAST(CAST(slab * 100 AS INTEGER) AS VARCHAR) || '%' END AS rate_applied,
       CASE WHEN code = 'FEE_DEDUCTION' THEN CAST(floor(round(share, 5) / 0.0002 + 1e-9) AS BIGINT) END AS rate_bucket,
       CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS settlement, CAST(NULL AS VARCHAR) AS stem, CAST(NULL AS DATE) AS settled_on, CAST(NULL AS BIGINT) AS that_day, CAST(NULL AS VARCHAR) AS method
FROM named
UNION ALL SELECT merchant_id, 'UNEXPLAINED', credit_id, amount, NULL, NULL, NULL, NULL, CASE WHEN verdict <> 'AMBIGUOUS' THEN 'no candidate' WHEN len(contested) > 0 THEN 'contested settlement' ELSE 'ambiguous' END,
       CASE WHEN verdict = 'AMBIGUOUS' AND len(contested) > 0 THEN candidates[1] END, {STEM}, NULL, NULL, NULL FROM unclaimed
UNION ALL SELECT merchant_id, 'MISSING_SETTLEMENT', settlement_id, CASE WHEN claimed_by IS NULL THEN expected_net ELSE 0 END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, settled_on, that_day, NULL FROM missing WHERE NOT found
UNION ALL SELECT merchant_id, 'UNSETTLED_PAYMENT', payment_id, amount, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, method FROM unsettled""",
    "their_stems": f"SELECT * FROM queue WHERE reason = 'no candidate' AND stem <> '' AND NOT list_has_any(string_split(stem, ' '), [{quoted(GATEWAY_WORDS)}])",
    "credit_score": """
SELECT t.*, e.expected, p.drift, p.ids IS NOT NULL AS claimed, coalesce(t.matchable AND p.ids = e.expected, false) AS "right", coalesce(t.matchable AND coalesce(p.ids, s.ids) = e.expected, false) AS attributed,
       coalesce(len(e.expected), 0) AS members, EXISTS (SELECT 1 FROM named n WHERE n.merchant_id = t.merchant_id AND n.credit_id = t.credit_id AND n.code <> 'UNEXPLAINED') AS named
FROM credit_truth t LEFT JOIN (SELECT merchant_id, credit_id, list_sort(list(settlement_id)) AS expected FROM truth_links GROUP BY ALL) e USING (merchant_id, credit_id)
LEFT JOIN proofs p USING (merchant_id, credit_id) LEFT JOIN shorts s USING (merchant_id, credit_id)""",
}


#: The key that each rule of causes gives an exception, in their order.
_CAUSE_KEYS = (
    "CASE WHEN code = 'MISSING_SETTLEMENT' AND (merchant_id, subject_id) IN (SELECT (merchant_id, subject_id) FROM listed_payouts) THEN 'named' END",
    "CASE WHEN code = 'FEE_DEDUCTION' THEN CAST(rate_bucket AS VARCHAR) END",
    "CASE WHEN code = 'TAX_DEDUCTION' THEN rate_applied END",
    "CASE WHEN code = 'MISSING_SETTLEMENT' AND settled_on IS NOT NULL AND min(that_day) OVER day = count(*) OVER day AND max(that_day) OVER day = count(*) OVER day THEN CAST(settled_on AS VARCHAR) END",
    "CASE WHEN reason = 'contested settlement' THEN settlement END",
    f"CASE WHEN reason = 'no candidate' AND stem <> '' AND NOT list_has_any(string_split(stem, ' '), [{quoted(GATEWAY_WORDS)}]) THEN stem END",
    "CASE WHEN code = 'PARTIAL_PAYMENT' AND recovered_by IS NOT NULL THEN 'all' END",
    "CASE WHEN code = 'MISSING_SETTLEMENT' THEN 'all' END",
    "CASE WHEN code = 'UNSETTLED_PAYMENT' THEN 'all' END",
)


def _cause_ctes() -> dict[str, str]:
    """Each rule over what the rules before it left, then the causes they found."""
    out = {"listed_payouts": "SELECT DISTINCT merchant_id, unnest(string_split(settlements, ', ')) AS subject_id FROM queue WHERE settlements IS NOT NULL"}
    left, taken = "queue", []
    for no, (name, key) in enumerate(zip(CAUSES, _CAUSE_KEYS, strict=True), 1):
        out[f"keyed_{no}"] = f"SELECT *, count(key) OVER (PARTITION BY merchant_id, key) AS alike FROM (SELECT *, {key} AS key FROM {left} WINDOW day AS (PARTITION BY merchant_id, code, settled_on))"
        left = f"(SELECT * EXCLUDE (key, alike) FROM keyed_{no} WHERE alike < {LEAST})"
        taken.append(f"SELECT merchant_id, {no} AS rule_no, '{name}' AS cause, key AS cause_key, code, subject_id, amount FROM keyed_{no} WHERE alike >= {LEAST}")
    out["caused"] = " UNION ALL ".join(taken)
    out["causes_found"] = f"""
SELECT *, CAST(row_number() OVER (PARTITION BY merchant_id ORDER BY total DESC, members DESC, cause, cause_key) AS INTEGER) AS place
FROM (SELECT merchant_id, cause, cause_key, count(*) AS members, {total('abs(amount)')} AS total, array_to_string(list_sort(list(DISTINCT code)), ', ') AS codes,
      array_to_string(list_sort(list(subject_id)), ',') AS member_ids FROM caused GROUP BY merchant_id, rule_no, cause, cause_key)"""
    return out


CTES |= _cause_ctes()

CTES["told"] = f"""
SELECT merchant_id, code, credit_id AS subject_id, abs(residual) AS amount, CASE code
WHEN 'PARTIAL_PAYMENT' THEN 'Short by ' || {INR('abs(residual)')} || ', which is ' || CASE WHEN abs(residual) = debit THEN '' ELSE {INR('abs(abs(residual) - debit)')} || CASE WHEN abs(residual) > debit THEN ' more than ' ELSE ' less than ' END END || type || ' ' || entity || ', recovered from ' || home
WHEN 'TAX_DEDUCTION' THEN 'GST came off at ' || CAST(CAST(slab * 100 AS INTEGER) AS VARCHAR) || '%; the difference is ' || {INR('abs(residual)')}
WHEN 'FEE_DEDUCTION' THEN 'Short by ' || {INR('abs(residual)')} || ': an extra ' || printf('%.3f', round_even(share, 5) * 100) || '% of gross and GST on it, not in the report'
ELSE {INR('abs(residual)')} || ' of this credit is not explained by its rows' END AS summary,
list_filter([CASE WHEN code = 'PARTIAL_PAYMENT' THEN created_on END], lambda v: v IS NOT NULL) AS days
FROM named n LEFT JOIN (SELECT merchant_id, entity_id AS entity, type, debit, created_on FROM settlement_rows) USING (merchant_id, entity)
UNION ALL SELECT merchant_id, 'UNEXPLAINED', credit_id, amount, {INR('amount')} || CASE WHEN verdict <> 'AMBIGUOUS' THEN ' arrived with no settlement behind it' WHEN len(contested) > 0 THEN ' and other credits fit one settlement' ELSE ' fits ' || CAST(len(candidates) AS VARCHAR) || ' settlements equally well' END, [] FROM unclaimed
UNION ALL SELECT merchant_id, 'MISSING_SETTLEMENT', settlement_id, CASE WHEN claimed_by IS NULL THEN expected_net ELSE 0 END, 'The gateway reported ' || {INR('expected_net')} || CASE WHEN claimed_by IS NULL THEN '; no bank credit matches it' ELSE '; ' || claimed_by || ' came up short against it' END, [settled_on] FROM missing WHERE NOT found
UNION ALL SELECT merchant_id, 'UNSETTLED_PAYMENT', payment_id, amount, {INR('amount')} || ' was captured and appears nowhere in the report', list_distinct([captured_on, complete_to]) FROM unsettled"""


def scored_after(rungs: int, select: str) -> str:
    """A select over credit_score, as it would be after so many rungs: the expressions behind it once more, under other names."""
    names = ("outcome", "claims", "tried", "proofs", "shorts", "refund_fits", "refund_exact", "refund_near", "named", "credit_score")
    def of(text: str) -> str:
        return re.sub(r"\b(FROM|JOIN|SEMI JOIN|ANTI JOIN) (" + "|".join(names) + r")\b", rf"\1 \2_after_{rungs}", text)

    for name in names:
        CTES[f"{name}_after_{rungs}"] = outcome_after(rungs) if name == "outcome" else of(CTES[name])
    return of(select)


def with_ctes(select: str) -> str:
    """The select with the expressions it needs before it."""
    names = list(CTES)
    word = {n: re.compile(rf"\b{n}\b") for n in names}
    needed: set[str] = set()
    texts = [select]
    while texts:
        text = texts.pop()
        for n in names:
            if n not in needed and word[n].search(text):
                needed.add(n)
                texts.append(CTES[n])
    own = [n for n in names if n in needed]
    if not own:
        return select
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in own) + "\n" + select
