import re

import numpy as np
from pyspark.sql import functions as F

from amalgam.llm import queries, urls

from .helpers import frame

URLS = ["https://Example.COM/en/7x", "http://a.example.com/en/6", "https://a.net/de/1", "https://www.example.net/de/81", "http://x.org/es/", "http://org/es/?q#f", "https://xorg/es/1", "http://a.com/EN/1", "x.com/en/", "http://h", "://only/path", "http://h?x=/en/", "http://a.com#/en/", "", None, "a://b://c/d"]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for r in queries.URL_RULES:
        h, p = r.text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(r)
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best


def test_rules(spark):
    df = frame(spark, list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    model = urls.Boosted(prior=-1.0)
    got = {r.page_id: r for r in urls.judge(df, queries.URL_RULES, model).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule = plain(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule.text if rule else None), u
        assert got[i].verdict == (rule.verdict if rule else "allow")


def test_trees_learn_lexical_signs():
    rng = np.random.default_rng(0)
    good = [f"https://news{rng.integers(9)}.example.org/story/{w}" for w in ["alpha", "beta", "gamma", "delta"] * 100]
    bad = [f"http://x{rng.integers(10**9)}-{rng.integers(10**6)}.example.org/a/b/c/d?{'&'.join(f'k{i}={rng.integers(99)}' for i in range(6))}" for _ in range(400)]
    model = urls.train(good[:300] + bad[:300], np.array([0.0] * 300 + [1.0] * 300))
    assert (model.probability(good[300:]) < 0.5).mean() > 0.98 and (model.probability(bad[300:]) > 0.5).mean() > 0.98


def test_degenerate_training():
    assert urls.train([], np.zeros(0)).probability(["http://x"])[0] < 0.5
    assert urls.train(["http://x"] * 9, np.ones(9)).probability(["http://y"])[0] > 0.5
    assert urls.train([None, "", "http://a"], np.array([0.0, 1.0, 0.0])).probability([None]).shape == (1,)


def test_empty_tables(spark):
    df = frame(spark, [], "page_id long, url string")
    assert urls.judge(df, queries.URL_RULES, urls.fit(df.withColumn("verdict", F.lit("block")))).count() == 0


def plain_split(x_bin, edges, rows, grad, hess, l2):
    """(gain, feature, bin) of the best split of some rows, by trying all."""
    best = (1e-6, None, None)
    for f, edge in enumerate(edges):
        for k in range(len(edge)):
            left = [r for r in rows if x_bin[r, f] <= k]
            right = [r for r in rows if x_bin[r, f] > k]
            score = lambda part: sum(grad[r] for r in part) ** 2 / (sum(hess[r] for r in part) + l2)
            gain = score(left) + score(right) - score(rows)
            if gain > best[0] + 1e-12:
                best = (gain, f, k)
    return best


def test_tree_against_brute_force():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 5, (60, 3)).astype(float)
    edges = [np.arange(4, dtype=float)] * 3
    x_bin = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    grad, hess = rng.normal(size=60), rng.random(60) + 0.1
    tree = urls.grow(x_bin, edges, grad, hess, 2, 1.0)

    def leaf(rows, depth):
        gain, f, k = plain_split(x_bin, edges, rows, grad, hess, 1.0) if depth else (0, None, None)
        if f is None:
            value = -sum(grad[r] for r in rows) / (sum(hess[r] for r in rows) + 1.0)
            return dict.fromkeys(rows, value)
        return leaf([r for r in rows if x_bin[r, f] <= k], depth - 1) | leaf([r for r in rows if x_bin[r, f] > k], depth - 1)

    want = leaf(list(range(60)), 2)
    assert np.allclose(tree(x), [want[i] for i in range(60)])


def test_query_and_held_out_urls(spark, tmp_path):
    rng = np.random.default_rng(7)
    hosts = ["shop.example.com", "www.example.net", "a.org", "news.net", "x.com", "b.example.org"]
    rows = [(i, f"https://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es'])}/{rng.integers(1, 100)}?q={i}") for i in range(600)] + [(1000 + i, u) for i, u in enumerate(URLS)] + [(None, None), (5, None)]
    df = frame(spark, rows, "page_id long, url string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op2_urls(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    # the model again, from the labelled URLs by hand
    labelled = {u: rule.verdict for _, u in rows if u is not None for rule in [plain(u)[2]] if rule}
    model = urls.train(list(labelled), np.array([v == "block" for v in labelled.values()], float))
    key = lambda i, *x: (i is None, i or 0, *x)
    want = []
    for i, u in rows:
        host, path, rule = plain(u)
        p = model.probability([u])[0]
        want.append(key(i, host, path, rule.text if rule else "", rule.verdict if rule else "block" if p >= urls.BLOCK_AT else "allow", round(p, 6)))
    assert sorted(want) == sorted(key(r.page_id, r.host, r.path, r.rule or "", r.verdict, round(r.p_block, 6)) for r in got)
    found = urls.held_out(urls.apply_rules(df, queries.URL_RULES).withColumnRenamed("rule_verdict", "verdict"))
    assert found["rows"] > 30 and found["accuracy"] > 0.9 and found["area"] > 0.9
