from reckoner.llm import lines as L


def brute(rows, least):
    sites = {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(" ") and site is not None:
                sites.setdefault(line.strip(" "), set()).add(site)
    out = []
    for i, text, _ in rows:
        whole = (text or "").split("\n")
        kept = [x for x in whole if len(sites.get(x.strip(" "), ())) < least]
        out.append((i, "\n".join(kept), len(whole), len(whole) - len(kept)))
    return sorted(out)


def test_matches_brute_force(spark):
    rows = [(0, None, "s1"), (1, "", "s1"), (2, "only\nhere\n\n", None), (3, "x" * 200_000, "s2")]
    for i in range(4, 200):
        parts = [f"line {i}", " everywhere ", f"on {i % 12} of them", "", "only few" if i % 97 == 0 else "one"]
        rows.append((i, "\n".join(parts), f"s{i % (3 + i % 20)}"))
    rows.append((500, "everywhere\neverywhere", "s1"))
    docs = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "doc_id long, text string, source string, n_lines long")
    for least in (1, 2, 3, 10, 15):
        got = L.remove_spread_lines(docs, "source", min_sites=least)
        assert sorted(map(tuple, got.collect())) == brute(rows, least)
    assert L.remove_spread_lines(docs.limit(0), "source").collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
