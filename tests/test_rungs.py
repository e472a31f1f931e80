"""Small cases for each rung, the fold over rungs, and proofs."""

import datetime as dt

import pytest
from reckoner.operators import claims, proofs, rungs
from reckoner.operators.batches import rebuild
from reckoner.plans.reconcile import cascade

D = dt.date(2026, 7, 8)
ROW = "merchant_id long, entity_id string, type string, debit long, credit long, amount long, fee long, tax long, on_hold boolean, created_on date, settled_on date, settlement_id string, settlement_utr string, order_id string, payment_id string, method string, card_type string, card_network string"
CREDIT = "merchant_id long, credit_id string, amount long, value_date date, narration string, utr string"
RATES = "merchant_id long, standard decimal(6,4), corporate_card decimal(6,4), international_card decimal(6,4), gst decimal(6,4), tds decimal(6,4), route decimal(6,4), tds_applies boolean"


def pay(settlement, amount, utr=None, day=D, entity=None, fee=None, tax=None):
    fee = round(amount * 0.02) if fee is None else fee
    tax = round(fee * 0.18) if tax is None else tax
    entity = entity or f"pay_{settlement}"
    return (1, entity, "payment", 0, amount - fee - tax, amount, fee, tax, False, day, day, settlement, utr, "o", entity, "upi", None, None)


def net(amount):
    fee = round(amount * 0.02)
    return amount - fee - round(fee * 0.18)


@pytest.fixture
def made(spark):
    from decimal import Decimal as X

    rates = spark.createDataFrame([(1, X("0.02"), X("0.0215"), X("0.03"), X("0.18"), X("0.01"), X("0.001"), False)], RATES)

    def make(rows, credits):
        rows = spark.createDataFrame(rows, ROW)
        credits = spark.createDataFrame([(1, i, a, d, n, u) for i, a, d, n, u in credits], CREDIT)
        return credits, rebuild(rows), rates, rows

    return make


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_reference(made):
    credits, batches, rates, _ = made([pay("s1", 10_000, "UTR000000001"), pay("s2", 20_000, "UTR000000002")], [("c", 5, D, "NEFT CR UTR000000001 X", None)])
    r = one(rungs.exact_reference(credits, batches))
    assert (r.verdict, r.settlement_ids, r.confidence) == ("MATCHED", ["s1"], 1.0)
    credits, batches, rates, _ = made([pay("s1", 10_000, "UTR000000001"), pay("s2", 20_000, "UTR000000001")], [("c", 5, D, "x", "UTR000000001")])
    assert one(rungs.exact_reference(credits, batches)).verdict == "AMBIGUOUS"
    credits, batches, rates, _ = made([pay("s1", 10_000, "UTR000000001")], [("c", 5, D, "NEFT SETTLEMENT", None)])
    assert one(rungs.exact_reference(credits, batches)).verdict == "NO_CANDIDATE"


@pytest.mark.parametrize("days, verdict", [(0, "MATCHED"), (1, "MATCHED"), (-1, "MATCHED"), (2, "NO_CANDIDATE")])
def test_amount_and_date(made, days, verdict):
    credits, batches, rates, _ = made([pay("s1", 10_000)], [("c", net(10_000) + 1, D + dt.timedelta(days), "x", None)])
    r = one(rungs.amount_and_date(credits, batches))
    assert r.verdict == verdict
    if verdict == "MATCHED":
        assert r.confidence == pytest.approx(0.80 - 0.10 * 1 / 2)


def test_subset_sum(made):
    a, b, c = 1_000_000, 700_000, 300_000
    credits, batches, rates, _ = made([pay("s1", a), pay("s2", b), pay("s3", 111_111)], [("c", net(a) + net(b), D, "x", None)])
    r = one(rungs.subset_sum(credits, batches))
    assert (r.verdict, r.settlement_ids, r.confidence) == ("MATCHED", ["s1", "s2"], 0.75)
    credits, batches, rates, _ = made([pay("s1", a), pay("s2", b), pay("s3", c)], [("c", net(a), D, "x", None)])
    assert one(rungs.subset_sum(credits, batches)).verdict == "AMBIGUOUS"  # the single and the pair
    credits, batches, rates, _ = made([pay("s1", a)], [("c", net(a), D, "x", None)])
    assert one(rungs.subset_sum(credits, batches)).verdict == "NO_CANDIDATE"  # nothing to combine
    credits, batches, rates, _ = made([pay("s1", 600_000), pay("s2", 400_000), pay("s3", 700_000), pay("s4", 300_000)], [("c", net(a), D, "x", None)])
    assert one(rungs.subset_sum(credits, batches)).verdict == "AMBIGUOUS"
    credits, batches, rates, _ = made([pay("s1", 600_000), pay("s2", 500_007), pay("s3", 900_011)], [("c", net(600_000) + net(500_007) + net(900_011), D, "x", None)])
    r = one(rungs.subset_sum(credits, batches))
    assert (r.verdict, len(r.settlement_ids), r.confidence) == ("MATCHED", 3, pytest.approx(0.70))


def brute_sums(amount, pool, anchors=()):
    """Ids of every fitting combination. pool: (id, net, allowance), largest first."""
    import numpy as np

    net, slack = (np.array([p[k] for p in pool]) for k in (1, 2))
    named = {k for k, p in enumerate(pool) if p[0] in anchors}
    first, second = np.triu_indices(len(pool), 1)
    both = abs(amount - net[first] - net[second]) <= slack[first] + slack[second]
    has = np.array([named <= {a, b} for a, b in zip(first, second)]) if named else np.ones(len(first), bool)
    found = [(k,) for k in range(len(pool)) if abs(amount - net[k]) <= slack[k] and (not named or k in named)]
    found += [(a, b) for a, b in zip(first[both & has].tolist(), second[both & has].tolist())]
    for k in range(len(pool)):
        fit = (second < k) & ~(both & has) & (abs(amount - net[first] - net[second] - net[k]) <= slack[first] + slack[second] + slack[k])
        found += [(a, b, k) for a, b in zip(first[fit].tolist(), second[fit].tolist()) if named <= {a, b, k}]
    return [sorted(pool[k][0] for k in combination) for combination in found]


@pytest.mark.parametrize("size, most", [(70, 10**6), (70, 4000), (500, 10**9)])
def test_large_pools_are_searched(spark, size, most):
    import random

    rng = random.Random(size + most)
    pool = sorted(((f"s{k}", rng.randint(1, most), rng.randint(1, 9)) for k in range(size)), key=lambda p: (-p[1], p[0]))
    batches = spark.createDataFrame([(1, i, D + dt.timedelta(rng.choice([-3, -2, 0, 1])), n, a) for i, n, a in pool] + [(1, "far", D + dt.timedelta(5), 50, 1)], "merchant_id long, settlement_id string, settled_on date, expected_net long, allowance long")
    amounts = {f"c{k}": sum(p[1] for p in rng.sample(pool, k % 4 or 1)) + k % 3 for k in range(12)}
    credits = spark.createDataFrame([(1, i, a, D, "x", None) for i, a in amounts.items()], CREDIT)
    prior = spark.createDataFrame([(1, "c2", ["s1"]), (1, "c3", [pool[0][0], "gone"]), (1, "c6", [])], "merchant_id long, credit_id string, withdrawn_ids array<string>")
    for before, anchors in ((None, {}), (prior, {"c2": ["s1"], "c3": [pool[0][0]]})):
        for r in rungs.subset_sum(credits, batches, prior=before).collect():
            mine = [p for p in pool if p[1] <= amounts[r.credit_id] + p[2]]
            named = anchors.get(r.credit_id, [])
            found = brute_sums(amounts[r.credit_id], mine, named) if len(mine) > 1 and set(named) <= {p[0] for p in mine} else []
            assert r.verdict == ("NO_CANDIDATE", "MATCHED", "AMBIGUOUS")[min(2, len(found))], r
            assert r.candidates == sorted({i for f in found for i in f})
            assert r.settlement_ids == (found[0] if len(found) == 1 else [])


def test_a_withdrawn_reference_settles_two_sums(made, spark):
    rows = [pay("a", 1_000_000), pay("b", 2_500_000), pay("c", 1_500_000), pay("d", 2_000_000)]
    credits, batches, _, _ = made(rows, [("x", net(1_000_000) + net(2_500_000), D, "x", None)])
    said = lambda *ids: spark.createDataFrame([(1, "x", list(ids))], "merchant_id long, credit_id string, withdrawn_ids array<string>")
    assert one(rungs.subset_sum(credits, batches)).verdict == "AMBIGUOUS"
    r = one(rungs.subset_sum(credits, batches, prior=said("a")))
    assert (r.verdict, r.settlement_ids, r.confidence) == ("MATCHED", ["a", "b"], pytest.approx(0.90))
    assert one(rungs.subset_sum(credits, batches.filter("settlement_id <> 'a'"), prior=said("a"))).settlement_ids == ["c", "d"]  # claimed by another credit
    assert one(rungs.subset_sum(credits, batches, prior=said("a", "c"))).verdict == "NO_CANDIDATE"
    early = made([*rows, pay("old", 5, day=D - dt.timedelta(30))], [])[1]
    assert one(rungs.subset_sum(credits, early, prior=said("old"))).verdict == "NO_CANDIDATE"


def test_cascade_with_anchors(made):
    """A credit for two payouts quotes one of them, and two pairs add up alike."""
    rows = [pay("a", 1_000_000, "UTR00000000A"), pay("b", 2_500_000), pay("c", 1_500_000), pay("d", 2_000_000)]
    credits, batches, rates, _ = made(rows, [("x", net(1_000_000) + net(2_500_000), D, "UTR00000000A", None)])
    plain = one(cascade(credits, batches, rates, rungs.PLAIN_RUNGS))
    assert (plain.verdict, plain.withdrawn_ids) == ("AMBIGUOUS", ["a"])
    r = one(cascade(credits, batches, rates, rungs.PLAIN_RUNGS, anchored=True))
    assert (r.verdict, r.strategy, r.settlement_ids) == ("MATCHED", "subset_sum", ["a", "b"])


def joined(df):
    """Rows that come out of the joins of a frame that has been run."""
    found, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            node = node.executedPlan()
            name = node.nodeName()
        if "Join" in name:
            found += node.metrics().get("numOutputRows").get().value()
        stack += [node.children().apply(i) for i in range(node.children().size())] + ([node.plan()] if "QueryStage" in name else [])
    return found


def test_strangers_do_not_meet(spark):
    """Narrations and references without a pair in common make no rows, however many a merchant has."""
    said = spark.createDataFrame([(1, f"c{i}", f"{'ACEGIKMOQS'[i % 10]}{'BDFHJLNPRT'[i // 10 % 10]}" * 8) for i in range(300)], "merchant_id long, credit_id string, said string")
    open_ = spark.createDataFrame([(1, f"s{i}", f"{i:03d}{(i * 7) % 1000:03d}{i:03d}456") for i in range(400)], "merchant_id long, settlement_id string, reference string")
    met = rungs._sharing(said, open_, rungs._bound(rungs.FLOOR), rungs.F.lit(rungs.no_pair_up_to(rungs.FLOOR)))
    assert met.collect() == [] and joined(met) == 0


def test_short_references(made):
    """All-pairs scores of short and odd references, by brute force."""
    import itertools
    import random

    rng = random.Random(4)
    letters = "ABC12"
    refs = ["".join(rng.choices(letters, k=n)) for n in (1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8, 9, 12) for _ in range(3)]
    texts = ["".join(rng.choices(letters, k=n)) for n in (1, 1, 2, 3, 4, 6, 8, 12, 16) for _ in range(4)]
    credits, batches, _, _ = made([pay(f"s{i}", 10_000, u) for i, u in enumerate(refs)], [(f"c{i}", 5, D, t, None) for i, t in enumerate(texts)])
    score = {(i, j): rungs.best_window_ratio(u, t) for (i, t), (j, u) in itertools.product(enumerate(texts), enumerate(refs))}
    got = {r.credit_id: (r.score, r.second) for r in rungs.fuzzy_scores(credits, batches).collect()}
    for i in range(len(texts)):
        best, second = sorted((score[i, j] for j in range(len(refs))), reverse=True)[:2]
        want = (best, second if best - second < rungs.MARGIN else 0.0) if best >= rungs.FLOOR else None
        assert got.get(f"c{i}") == (pytest.approx(want) if want else None)


def test_fuzzy(made):
    credits, batches, rates, _ = made([pay("s1", 10_000, "EIQO7RMB8Q93"), pay("s2", 20_000, "ZZTOP1234567")], [("c", 5, D, "NEFT CR EIQO7RMB8Q", None)])
    r = one(rungs.fuzzy_narration(credits, batches))
    assert r.verdict == "MATCHED" and r.settlement_ids == ["s1"] and r.confidence <= 0.70
    credits, batches, rates, _ = made([pay("s1", 10_000, "EIQO7RMB8Q93"), pay("s2", 20_000, "EIQO7RMB8Q94")], [("c", 5, D, "NEFT CR EIQO7RMB8Q", None)])
    assert one(rungs.fuzzy_narration(credits, batches)).verdict == "AMBIGUOUS"
    credits, batches, rates, _ = made([pay("s1", 10_000, "EIQO7RMB8Q93")], [("c", 5, D, "NEFT ACME TRADERS", None)])
    assert one(rungs.fuzzy_narration(credits, batches)).verdict == "NO_CANDIDATE"
    assert rungs.best_window_ratio("JMSS5NDW4CR", "JMSS5NDW4CR") == 1.0


def test_window_ratio_is_the_plain_one():
    import random
    from difflib import SequenceMatcher

    random.seed(2)
    for _ in range(300):
        a = "".join(random.choices("0123ABCD", k=random.randint(1, 14)))
        b = "".join(random.choices("0123ABCDXYZ", k=random.randint(1, 40)))
        plain = max(SequenceMatcher(None, a, b[i : i + len(a) + 3], autojunk=False).ratio() for i in range(len(b)))
        assert rungs.best_window_ratio(a, b) == plain
        assert rungs.best_window_ratio(a, b, 0.65) == (plain if plain > 0.65 else 0.0)


@pytest.mark.parametrize("share, verdict", [(0.01, "MATCHED"), (0.2, "NO_CANDIDATE"), (-0.01, "NO_CANDIDATE")])
def test_shortfall(made, share, verdict):
    whole = net(1_000_000)
    credits, batches, rates, _ = made([pay("s1", 1_000_000)], [("c", round(whole * (1 - share)), D, "x", None)])
    r = one(rungs.shortfall(credits, batches, rates))
    assert r.verdict == verdict and r.confidence == (0.35 if verdict == "MATCHED" else 0)


def test_two_credits_claim_one_settlement(made):
    credits, batches, rates, _ = made([pay("s1", 10_000)], [("a", net(10_000), D, "x", None), ("b", net(10_000), D, "x", None)])
    attempts = claims.demote_contested(claims.veto(rungs.amount_and_date(credits, batches), credits, batches))
    got = {r.credit_id: (r.verdict, r.contested_by, r.candidates) for r in attempts.collect()}
    assert got == {"a": ("AMBIGUOUS", ["b"], ["s1"]), "b": ("AMBIGUOUS", ["a"], ["s1"])}


def test_withdrawn_claim_survives(made):
    credits, batches, rates, rows = made([pay("s1", 1_000_000, "UTR000000001")], [("c", net(1_000_000) - 5000, D, "UTR000000001", None)])
    r = one(cascade(credits, batches, rates, rungs.PLAIN_RUNGS))
    assert r.verdict == "NO_CANDIDATE" and r.withdrawn_ids == ["s1"]


def test_worked_example_and_drift(made):
    """A card payment of Rs 10,000: fee 200, GST 36, net 9,764."""
    credits, batches, rates, rows = made([pay("s1", 1_000_000, fee=20_000, tax=3600)], [("c", 976_401, D, "x", None)])
    matched = rungs.amount_and_date(credits, batches)
    proof = one(proofs.prove(matched, credits, batches))
    assert proof.proved and proof.drift == 1
    lines = [(r.line_no, r.label, r.amount) for r in proofs.proof_lines(matched, credits, rows, batches, rates).orderBy("line_no").collect()]
    assert [a for _, _, a in lines] == [1_000_000, -20_000, -3600, 1] and lines[2][1] == "GST on platform fee @18%"
    running = proofs.running_balance(proofs.proof_lines(matched, credits, rows, batches, rates)).orderBy("line_no").collect()
    assert running[-1].running == 976_401


def test_empty(made):
    credits, batches, rates, _ = made([], [])
    assert cascade(credits, batches, rates).collect() == []
