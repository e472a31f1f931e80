import numpy as np
import pytest
import xxhash
from reckoner.llm import simhash as S


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, f"{prints[i]:016x}", find(i)) for i in ids}


def test_code_is_perfect():
    offsets, counts, patterns = S._error_lists()[0]
    assert (counts == 1).all() and len(patterns) == 2048


def test_linked_fingerprints_meet_at_an_anchor():
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**63), 2**63, 500).astype(np.int64)
    flips = np.array([1 << a ^ 1 << b for a, b in rng.integers(0, 64, (500, 2)).tolist()], np.uint64).view(np.int64)
    (row, anchor), (row_y, anchor_y) = S.anchors(x), S.anchors(x ^ flips)
    assert len(row) < 50 * len(x)
    assert all(set(anchor[row == i].tolist()) & set(anchor_y[row_y == i].tolist()) for i in range(500))


@pytest.mark.parametrize("size", [5, 40, S.ALL_PAIRS, S.ALL_PAIRS + 1, 900])
def test_links_within_an_anchor(size):
    """All pairs at small anchors, values between at large ones: the same parts."""
    rng = np.random.default_rng(size)
    fps = np.unique(np.bitwise_xor.reduce(np.int64(1) << rng.integers(0, 14, (size * 2, 5)), axis=1))[:size].astype(np.int64)

    def parts(left, right):
        root = list(range(len(fps)))
        for a, b in zip(left.tolist(), right.tolist()):
            assert (int(fps[a]) ^ int(fps[b])).bit_count() <= 2
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        find = lambda i: i if root[i] == i else find(root[i])
        return [find(i) for i in range(len(fps))]

    near = [(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2]
    want = parts(*np.array(near, int).reshape(-1, 2).T)
    assert parts(*S._linked(fps)) == want
    assert parts(*S._links_of(np.zeros(len(fps), np.int64), fps)) == want


@pytest.mark.parametrize("all_pairs", [S.ALL_PAIRS, 2])
def test_components_match_brute_force(spark, monkeypatch, all_pairs):
    monkeypatch.setattr(S, "ALL_PAIRS", all_pairs)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "Ünï one"), (4, "ünï one"), (5, "A B C"), (6, "a b\tc"), (7, "x" * 5000)]
    for i in range(8, 150):
        rows.append((i, " ".join(rng.choice(words, 80))))
    for i in range(150, 400):
        base = rows[8 + i % 5][1].split()
        base[int(rng.integers(0, 80))] = str(rng.choice(words))
        rows.append((i, " ".join(base)))
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, fingerprint string, component_id long")
    got = {tuple(r)[:3] for r in S.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_null_and_repeated_ids(spark, monkeypatch):
    """Each row has its result; one row of each component stays. Common fingerprints meet theirs by broadcast."""
    docs = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (None, "d e f"), (None, "d e f"), (4, "g h i"), (4, "j k l"), (4, None)], "doc_id long, text string")
    for hot in (S.HOT, 2):
        monkeypatch.setattr(S, "HOT", hot)
        rows = S.near_duplicates(docs).collect()
        assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 0), (0, 3), (3, 3), (3, 3), (4, 4), (4, 4), (4, 4)]
        assert len(rows) == 8 and sum(r.kept for r in rows) == 5
        assert len({r.fingerprint for r in rows if r.kept}) == 5


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).collect() == []
