"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest."""

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, smallest, split_batches

#: Most labelled URLs that a fit uses; those with the smallest hash.
TRAIN_ROWS = 20_000
#: Parts of the labelled URLs for out-of-fold rates; a URL's own part does not tell its rates.
FOLDS = 5
#: A host suffix or first path segment has a statistic of its own from so many labelled URLs on.
LEAST_ROWS = 5
BLOCK_AT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host follows the first :// up to /, ? or #, with A-Z lower-cased; the path goes on up to ? or #. Both are empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, where the path starts with the rule's."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2] if "/" in self.text else ""


def apply_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """pages with host, path, rule and rule_verdict: of the rules that fit, the longest; nulls if none does.

    Rules are few and become one expression, so pages are neither shuffled nor joined.
    """
    pages = pages.drop("host", "path", "rule", "rule_verdict")
    host, path = split_url(F.col("url"))
    split = pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path))
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return split.withColumns({"rule": rule, "rule_verdict": verdict})


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def parts(url: str) -> tuple[str, str, str]:
    """(host, path, query) for features; a fragment counts with the query."""
    rest = url.partition("://")[2]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    end = min([i for i in (rest.find("?", cut), rest.find("#", cut)) if i >= 0], default=len(rest))
    return rest[:cut].lower(), rest[cut:end], rest[end:]


def keys(host: str, path: str) -> list[str]:
    """What has statistics of its own: the last label, the last two labels, the first path segment."""
    labels = host.split(".")
    return [f"tld:{labels[-1]}", f"site:{'.'.join(labels[-2:])}", f"segment:{path.strip('/').partition('/')[0]}"]


FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digit_ratio", "host_digits", "entropy", "host_entropy", "parameters", "hyphens", "odd_characters", "longest_run", "tld_rate", "site_rate", "segment_rate")


def lexical(urls: list[str | None], rates: list[dict[str, float]], prior: float) -> np.ndarray:
    """The FEATURES of each URL, with rates of its own; unseen suffixes get the prior rate."""
    out = np.zeros((len(urls), len(FEATURES)))
    for i, (url, known) in enumerate(zip(urls, rates, strict=True)):
        url = url or ""
        host, path, query = parts(url)
        digits = sum(c.isdigit() for c in url)
        run = longest = 0
        for c in url:
            run = run + 1 if c.isalnum() else 0
            longest = max(longest, run)
        out[i] = (
            len(url), len(host), len(path), host.count(".") + 1, path.count("/"), digits / max(1, len(url)), sum(c.isdigit() for c in host),
            _entropy(url), _entropy(host), query.count("=") + query.count("&"), host.count("-"), sum(not (c.isalnum() or c in "/:.-?#=&_") for c in url), longest,
            *(known.get(k, prior) for k in keys(host, path)),
        )
    return out


@dataclass
class Tree:
    """A regression tree in heap order: node i splits on feature[i] at cut[i] (left if not above), leaves hold value."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[node]] > self.cut[node])
        return self.value[node - (2**self.depth - 1)]


@dataclass
class Boosted:
    """Gradient-boosted trees for the log-odds of blocking."""

    prior: float = 0.0
    rate: float = 0.2
    trees: list[Tree] = field(default_factory=list)
    rates: dict[str, float] = field(default_factory=dict)
    base_rate: float = 0.5

    def probability(self, urls: list[str | None]) -> np.ndarray:
        x = lexical(urls, [self.rates] * len(urls), self.base_rate)
        z = np.full(len(x), self.prior)
        for tree in self.trees:
            z += self.rate * tree(x)
        return 1 / (1 + np.exp(-z))


def grow(x_bin: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, l2: float) -> Tree:
    """The tree that lowers the second-order loss most, level by level over binned features."""
    n_inner = 2**depth - 1
    feature, cut = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf)
    node = np.zeros(len(grad), np.int64)
    bins = max(len(e) for e in edges) + 1
    for level in range(depth):
        first, width = 2**level - 1, 2**level
        best = np.full(width, 1e-6)
        side = np.zeros(len(grad), np.int64)
        for f, edge in enumerate(edges):
            if not len(edge):
                continue
            slot = (node - first) * bins + x_bin[:, f]
            g = np.bincount(slot, weights=grad, minlength=width * bins).reshape(width, bins)
            h = np.bincount(slot, weights=hess, minlength=width * bins).reshape(width, bins)
            gl, hl = g.cumsum(axis=1), h.cumsum(axis=1)
            gt, ht = gl[:, -1:], hl[:, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            at = gain[:, : len(edge)].argmax(axis=1)
            top = gain[np.arange(width), at]
            for k in np.flatnonzero(top > best):
                best[k], feature[first + k], cut[first + k] = top[k], f, edge[at[k]]
                rows = node == first + k
                side[rows] = x_bin[rows, f] > at[k]
        node = 2 * node + 1 + side
    leaf = node - n_inner
    g = np.bincount(leaf, weights=grad, minlength=2**depth)
    h = np.bincount(leaf, weights=hess, minlength=2**depth)
    return Tree(depth, feature, cut, -g / (h + l2))


def fold(url: str | None) -> int:
    return zlib.crc32((url or "").encode("utf-8", "surrogatepass")) % FOLDS


def suffix_rates(urls: list[str | None], blocked: np.ndarray, rate: float) -> dict[str, float]:
    """The blocked share of each key that LEAST_ROWS URLs have, drawn towards `rate` by two more of them."""
    seen, hit = Counter(), Counter()
    for url, y in zip(urls, blocked, strict=True):
        host, path, _ = parts(url or "")
        for k in keys(host, path):
            seen[k] += 1
            hit[k] += int(y)
    return {k: (hit[k] + 2 * rate) / (c + 2) for k, c in seen.items() if c >= LEAST_ROWS}


def train(urls: list[str | None], blocked: np.ndarray, rounds: int = 60, depth: int = 3, l2: float = 1.0) -> Boosted:
    """Boosted trees from URLs with 0/1 labels. With one class only, its share is the prediction; without rows it is a half, less a bit: nothing is blocked.

    A URL learns with the suffix rates of the other folds, as its own label would give
    itself away; the model keeps those of all.
    """
    n = len(urls)
    if not n:
        return Boosted(prior=-1.0)
    rate = (blocked.sum() + 0.5) / (n + 1)
    model = Boosted(prior=float(np.log(rate / (1 - rate))), base_rate=float(rate))
    model.rates = suffix_rates(urls, blocked, rate)
    folds = np.array([fold(u) for u in urls])
    others = [suffix_rates([u for u, g in zip(urls, folds, strict=True) if g != f], blocked[folds != f], rate) for f in range(FOLDS)]
    x = lexical(urls, [others[f] for f in folds], model.base_rate)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1], method="lower")) for c in x.T]
    edges = [e[e < c.max()] for e, c in zip(edges, x.T, strict=True)]
    x_bin = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    z = np.full(n, model.prior)
    for _ in range(rounds if 0 < blocked.sum() < n else 0):
        p = 1 / (1 + np.exp(-z))
        tree = grow(x_bin, edges, p - blocked, p * (1 - p), depth, l2)
        model.trees.append(tree)
        z += model.rate * tree(x)
    return model


def sample(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(urls, 1 for block) of at most `rows` distinct URLs of labelled (url, verdict), those with the smallest hash; nulls are left out, and block wins over allow."""
    known = labelled.where("url IS NOT NULL AND verdict IN ('allow', 'block')").groupBy("url").agg(F.max("verdict").alias("verdict"))
    chosen = smallest(known, rows, "url").toArrow()
    return chosen["url"].to_pylist(), np.array([v == "block" for v in chosen["verdict"].to_pylist()], float)


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Boosted:
    """Fit on sample() of labelled."""
    return train(*sample(labelled, rows))


def held_out(labelled: DataFrame, rows: int = TRAIN_ROWS) -> dict[str, float]:
    """How a model of four fifths of sample() judges the other fifth: rows, blocked share, accuracy, and the area under its ROC curve."""
    urls, blocked = sample(labelled, rows)
    # another cut than the folds
    test = np.array([zlib.crc32(u[::-1].encode("utf-8", "surrogatepass")) % 5 == 0 for u in urls], bool)
    p = train([u for u, t in zip(urls, test, strict=True) if not t], blocked[~test]).probability([u for u, t in zip(urls, test, strict=True) if t])
    y = blocked[test]
    _, place, count = np.unique(p, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(count) - (count - 1) / 2)[place]
    n1, n0 = y.sum(), (1 - y).sum()
    area = (ranks[y > 0].sum() - n1 * (n1 + 1) / 2) / max(1, n1 * n0)
    return {"rows": len(y), "blocked": float(y.mean()) if len(y) else 0.0, "accuracy": float(((p >= BLOCK_AT) == (y > 0)).mean()) if len(y) else 0.0, "area": float(area)}


def judge(pages: DataFrame, rules: list[Rule], model: Boosted) -> DataFrame:
    """pages with host, path, rule, p_block and verdict: the rule's where one fits, else block where p_block reaches BLOCK_AT.

    A null url has an empty host and path, fits no rule and is judged like an empty
    one; repeated rows each get a row. Other columns stay, whatever their names; those
    named like the results (and rule_verdict) are replaced. An empty table gives an
    empty result.
    """
    ruled = apply_rules(pages.drop("p_block", "verdict"), rules)
    at = ruled.columns.index("url")

    def score(batches):
        for batch in split_batches(batches, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.probability(batch.column(at).to_pylist()))], names=[*batch.schema.names, "p_block"])

    scored = map_rows(ruled, score, {"p_block": "double"})
    return scored.withColumn("verdict", F.coalesce("rule_verdict", F.when(F.col("p_block") >= BLOCK_AT, "block").otherwise("allow"))).drop("rule_verdict")
