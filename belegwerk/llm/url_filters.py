"""URL verdicts: rules by host and path, and gradient-boosted trees where no rule fits.

Features are lexical, computed by SQL expressions: lengths, depth, digit ratio, entropy,
parameter counts, hyphens, and shares of blocked URLs by host suffix, counted over all labelled
URLs and all suffixes. The trees are trained on the driver from a bounded sample of labelled URLs
and come back as SQL expressions; scoring joins the broadcast table of suffixes inside the scan,
without Python and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, written

#: (verdict, host and path prefix); the longest that fits wins.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Host tokens by which a URL counts as labelled for training: unwanted trade, and neutral ones.
UNWANTED = ("casino", "pills", "bets", "spam", "loan", "viagra", "porn")
#: At most this many labelled URLs of each class train the trees.
SAMPLE = 10_000
#: Shares of suffixes that train the trees are counted without a URL's own fold, and shrunk to the
#: share of all by so many imagined URLs. Up to so many suffixes are broadcast.
FOLDS, SMOOTH, MOST_SUFFIXES = 5, 20, 200_000
FEATURES = ("url_chars", "host_chars", "path_chars", "depth", "labels", "digit_share", "hyphens", "entropy", "parameters", "query_chars", "suffix_block_share", "longest_label")


def _empty() -> Column:
    return F.lit("")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path:
    from there up to ``?``, ``#`` or the end. Both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(_empty())
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, _empty()), F.coalesce(path, _empty())


def _parted(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    out = pages.select("page_id", url.alias("url"))
    host, path = host_and_path(F.col("url"))
    return out.withColumn("host", host).withColumn("path", path)


def matched_rule(rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits (host, path), as struct(verdict, rule); null if none does."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _suffix() -> Column:
    return F.substring_index(F.col("host"), ".", -1)


def features(parted: DataFrame, suffix_share: Column) -> DataFrame:
    """``parted(url, host, path, ...)`` with the columns of FEATURES."""
    url, host = F.coalesce(F.col("url"), _empty()), F.col("host")
    chars = F.filter(F.split(host, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: (F.length(host) - F.length(F.replace(host, c, _empty()))) / n)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    made = {
        "url_chars": F.length(url),
        "host_chars": F.length(host),
        "path_chars": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")),
        "labels": F.size(F.split(host, r"\.")),
        "digit_share": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
        "hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), _empty())),
        "entropy": F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p)),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "query_chars": F.length(query),
        "suffix_block_share": suffix_share,
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))),
    }
    return parted.withColumns({k: v.cast("double") for k, v in made.items()})


@dataclass
class Trees:
    """Boosted regression trees on logits: tree nodes are (feature, cut, left, right) or a value."""

    base: float
    trees: list

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += _apply(t, x)
        return out

    def column(self) -> Column:
        """The margin as one SQL expression over the feature columns."""
        return sum((_as_column(t) for t in self.trees), F.lit(float(self.base)))


def _apply(node, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    f, cut, low, high = node
    left = x[:, f] <= cut
    out = np.empty(len(x))
    out[left], out[~left] = _apply(low, x[left]), _apply(high, x[~left])
    return out


def _as_column(node) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    f, cut, low, high = node
    return F.when(F.col(FEATURES[f]) <= float(cut), _as_column(low)).otherwise(_as_column(high))


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float):
    """A tree by exact search over binned cuts: second-order gain, then Newton leaves."""
    leaf = float(-rate * g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 8:
        return leaf
    best, score = None, g.sum() ** 2 / (h.sum() + ridge) + 1e-6
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        gs = np.cumsum(np.bincount(bins[:, f], g, len(c) + 1))
        hs = np.cumsum(np.bincount(bins[:, f], h, len(c) + 1))
        gain = gs[:-1] ** 2 / (hs[:-1] + ridge) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + ridge)
        gain[(hs[:-1] < 0.5) | (hs[-1] - hs[:-1] < 0.5)] = -1
        i = int(gain.argmax())
        if gain[i] > score:
            best, score = (f, i), gain[i]
    if best is None:
        return leaf
    f, i = best
    left = bins[:, f] <= i
    grow = lambda m: _grow(x[m], bins[m], cuts, g[m], h[m], depth - 1, rate, ridge)
    return (f, float(cuts[f][i]), grow(left), grow(~left))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 25, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    if not len(y) or y.min() == y.max():
        return Trees(-4.0 if not len(y) or y.max() == 0 else 4.0, [])
    share = y.mean()
    model = Trees(float(np.log(share / (1 - share))), [])
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        middle = (values[1:] + values[:-1]) / 2
        cuts.append(middle if len(middle) <= 63 else np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])))
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, bins, cuts, p - y, p * (1 - p), depth, rate, ridge)
        model.trees.append(tree)
        margin += _apply(tree, x)
    return model


def seed_labels(pages: DataFrame) -> DataFrame:
    """Labelled URLs from the hosts themselves: 1 where a host token is an unwanted trade, else 0."""
    parted = _parted(pages).where("host <> ''")
    tokens = F.split(F.col("host"), "[.-]")
    return parted.select("url", F.arrays_overlap(tokens, F.array(*map(F.lit, UNWANTED))).cast("int").alias("label"))


def url_verdicts(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """``pages(page_id, url, ...)`` -> page_id, host, path, rule, verdict, score.

    rule is the longest rule that fits the host or a parent domain of it and the start of the
    path, else null. verdict is the rule's; without one it is the trees': block where their
    probability is 0.5 or more. score is that probability for every URL. ``labelled(url, label)``
    trains the trees, by default ``seed_labels``; of each class the ``sample`` URLs of least
    hash are used. The shares of suffixes are of all labels, each (url, label) once, so a URL with
    both labels counts for either; a suffix without any has the share of all. Labels other than 0
    and 1 are none. Null urls, and urls without ``://``, have an
    empty host and path and are judged by the trees. Repeated rows are judged each; other columns
    are ignored; an empty table gives an empty result.
    """
    labelled = seed_labels(pages) if labelled is None else labelled
    labelled = labelled.where("url is not null and label in (0, 1)").select("url", F.col("label").cast("int").alias("label")).distinct()
    host, path = host_and_path(F.col("url"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS))
    known = labelled.withColumn("host", host).withColumn("path", path).withColumn("suffix", _suffix()).withColumn("fold", fold)
    each = written(known.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("blocked")), "url-suffixes")
    counts = each.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    whole = each.agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).first()
    prior = whole["blocked"] / whole["n"] if whole["n"] else 0.0
    smoothed = lambda blocked, n: (blocked + SMOOTH * prior) / (n + SMOOTH)
    shares = counts.select("suffix", smoothed(F.col("blocked"), F.col("n")).alias("share"))
    shares = F.broadcast(shares) if counts.limit(MOST_SUFFIXES + 1).count() <= MOST_SUFFIXES else shares
    drawn = None
    for label in (0, 1):
        part = least_hashed(known.where(F.col("label") == label).withColumn("h", F.xxhash64("url")), sample, "url")
        drawn = part if drawn is None else drawn.union(part)
    # a URL that trains the trees does not see its own label in its suffix's share
    own = each.select("suffix", "fold", F.col("n").alias("own_n"), F.col("blocked").alias("own_blocked"))
    drawn = drawn.join(counts, "suffix").join(own, ["suffix", "fold"]).withColumn("page_id", F.lit(None).cast("long"))
    apart = smoothed(F.col("blocked") - F.col("own_blocked"), F.col("n") - F.col("own_n"))
    rows = features(drawn, apart).select("label", *FEATURES).collect()  # at most the sample of either class
    share = F.coalesce("share", F.lit(prior))
    y = np.array([r["label"] for r in rows], dtype=float)
    x = np.array([[r[f] for f in FEATURES] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    model = train(x, y)
    parted = _parted(pages).withColumn("suffix", _suffix()).join(shares, "suffix", "left")
    out = features(parted, share).withColumn("r", matched_rule(rules)).withColumn("margin", model.column())
    score = 1 / (1 + F.exp(-F.col("margin")))
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("margin") >= 0, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"),
    )
