import re

import numpy as np
import pytest
from reckoner.llm import urls as U

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(LOWER)
    fit = [(len(h + p), v == "block", len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fit, default=(0, 0, 0, None, U.OTHERWISE))[3:]


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/1", "http://www.example.com/en/", "http://a.www.example.com/en/x", "http://xwww.example.com/en/x", "http://example.com/en", "http://example.com/en/?q", "http://com/", "http://com",
    "http://x.com", "http://x.com?y", "http://x.com#/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/de/", "http://x.org/es/", "http://.net/es/", "http://x.net./es/", "http://x.net:80/es/", "a://b://c.net/es/", "http://ÜÄ.net/fr/É?x", "http://x.net/es",
    "http://" + "a." * 3000 + "net/es/" + "y" * 100_000, "http://example.com/en/\nz", "http://example.com//en/", "http://exam\nple.com/en/",
]


def judged(spark, urls, rules, **how):
    array = U.build(spark.createDataFrame(rules, "host string, path string, verdict string"), **how)
    rows = spark.createDataFrame([(i, u, 0) for i, u in enumerate(urls)], "page_id long, url string, host int").repartition(4)
    return array, {r.page_id: (r.judged.host, r.judged.path, r.judged.rule, r.judged.verdict) for r in U.judged(rows, array).collect()}


@pytest.mark.parametrize("bits,entries", [(64, U.FILE_ENTRIES), (3, 2), (64, 3)])
def test_matches_brute_force(spark, bits, entries):
    """Also with digests of three bits, which nearly all collide, and over several files."""
    array, got = judged(spark, URLS, U.RULES, bits=bits, file_entries=entries)
    assert got == {i: brute(u, U.RULES) for i, u in enumerate(URLS)}
    assert (len(array.files) > 1) == (entries < 9)


def test_many_rules(spark):
    rng = np.random.default_rng(0)
    hosts = ["com", "net", "a.com", "b.a.com", "a.b", "b", "ab.net"]
    paths = ["", "/", "/a", "/a/", "/ab", "/a/b/", "/é"]
    rules = list({(h, p): (h, p, str(rng.choice(["allow", "block"]))) for h, p in zip(rng.choice(hosts, 60), rng.choice(paths, 60))}.values())
    urls = [f"http://{rng.choice(['', 'x.', 'a.', 'b.a.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'a', '/b/', '?a'])}" for _ in range(600)]
    for bits in (64, 4):
        assert judged(spark, urls, rules, bits=bits, file_entries=10)[1] == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_cases(spark):
    rules = [(None, "/", "block"), ("", "/", "block"), ("x.com", None, "block"), ("Y.com", "/a", "allow"), ("y.com", "/a", "block"), ("com", "y", "block")]
    _, got = judged(spark, ["http://x.com", "http://y.com/ab", "http://y.com/b"], rules)
    assert [got[i][2:] for i in range(3)] == [("x.com", "block"), ("y.com/a", "block"), (None, "allow")]
    _, got = judged(spark, ["http://x.com/", None], [])
    assert [got[i][2:] for i in range(2)] == [(None, "allow")] * 2
    assert judged(spark, [], U.RULES)[1] == {}


def test_keys_are_unsigned_and_sorted(spark):
    array = U.build(spark.createDataFrame([(f"h{i}.org", "/", "block") for i in range(500)], "host string, path string, verdict string"), file_entries=300)
    ranges = [(first, last) for _, first, last in array.files]
    assert all(a <= b for a, b in ranges) and len(ranges) == 4 and max(b for _, b in ranges) > 2**63
    assert sorted(ranges) == sorted(ranges, key=lambda x: x[1])
    for name, *_ in array.files:
        assert (np.diff(U._mapped(name).keys.astype(object)) >= 0).all()
