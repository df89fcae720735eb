"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

DataFrame expressions only. The trees see how a URL is written (lengths, depth, digits, entropy,
parameters, how its path ends), not whose it is: host names and their suffixes are left to the rules.
Trees are grown on histograms: features are binned, each level of a
tree is one aggregation of gradient sums by (node, feature, bin), and the finished trees become one
SQL expression over the bins, so scoring is a projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: (verdict, host, path): a rule fits its host and all subdomains, and paths that start with its path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: At most so many labelled URLs are learned from: those with the smallest hash of the URL.
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, RIDGE = 12, 3, 0.4, 16, 1.0
#: Rows that the prior counts for in the block rate of a path's suffix.
PRIOR_ROWS = 20.0
FEATURES = ["url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "n_parameters", "has_fragment", "secure", "n_hyphens", "suffix_rate"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _matching(rules: list, host: Column, path: Column) -> Column:
    """The longest fitting rule as a struct (size, rule, verdict), or null."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def parsed(pages: DataFrame, rules: list = RULES) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    at = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    return at.withColumn("fit", _matching(rules, F.col("host"), F.col("path")))


def lexical(urls: DataFrame) -> DataFrame:
    """Add the lexical features of url, host and path, and the path's suffix: its extension, ``/``, or what kind its end is.

    Entropy is over lower-cased letters, digits, URL signs, and all other characters together.
    """
    u = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    lowered = F.lower(u)
    many = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    share = [many(lowered, c) / n for c in "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&#:%"]
    share.append(F.greatest(F.lit(0.0), 1 - sum(share, F.lit(0.0))) * F.when(F.length(u) > 0, 1.0).otherwise(0.0))
    entropy = sum((F.when(p > 1e-12, -p * F.log2(p)).otherwise(0.0) for p in share), F.lit(0.0))
    digits = n - F.length(F.translate(u, "0123456789", ""))
    d = lambda c: c.cast("double")
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1))
    return urls.select(
        "*", d(F.length(u)).alias("url_length"), d(F.length("host")).alias("host_length"), d(F.length("path")).alias("path_length"), d(many(F.col("path"), "/")).alias("depth"),
        d(many(F.col("host"), ".")).alias("host_labels"), (F.when(F.length(u) == 0, 0.0).otherwise(digits / n)).alias("digit_ratio"), entropy.alias("entropy"),
        d(many(u, "&") + F.when(F.contains(u, F.lit("?")), 1).otherwise(0)).alias("n_parameters"), d(F.contains(u, F.lit("#"))).alias("has_fragment"), d(u.startswith("https:")).alias("secure"), d(many(u, "-")).alias("n_hyphens"),
        F.when(F.col("path").endswith("/"), "/").when(extension != "", extension).when(F.col("path").rlike("[0-9]$"), "digit").otherwise("other").alias("suffix"),
    )


@dataclass
class UrlModel:
    """A fitted filter: suffix block rates (at most TRAIN_ROWS rows), bin edges, and the trees as one SQL expression."""

    suffixes: DataFrame | None
    prior: float
    edges: list[list[float]]
    margin: str

    def score(self, urls: DataFrame) -> DataFrame:
        """Add ``score``: the probability of label 1. ``urls``: url, host, path and any other columns."""
        if self.suffixes is None:
            return urls.withColumn("score", F.lit(self.prior))
        x = _rated(lexical(urls), self.suffixes, self.prior)
        return _binned(x, self.edges).withColumn("score", F.expr(f"1 / (1 + exp(-({self.margin})))"))


def _rated(x: DataFrame, suffixes: DataFrame, prior: float) -> DataFrame:
    # at most one row for each of TRAIN_ROWS labelled URLs
    rated = x.join(F.broadcast(suffixes.withColumnRenamed("suffix", "_suffix")), F.col("suffix") == F.col("_suffix"), "left")
    return rated.withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(prior)))


def _binned(x: DataFrame, edges: list[list[float]]) -> DataFrame:
    at = [sum((F.when(F.col(f) > e, 1).otherwise(0) for e in es), F.lit(0)) for f, es in zip(FEATURES, edges)]
    return x.withColumn("b", F.array(*at))


def _rates(x: DataFrame, prior: float) -> DataFrame:
    return x.groupBy("suffix").agg(((F.sum("y") + PRIOR_ROWS * prior) / (F.count(F.lit(1)) + PRIOR_ROWS)).alias("suffix_rate"))


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, rows: int = TRAIN_ROWS) -> UrlModel:
    """Fit on ``labelled`` (url, label 0 or 1), or on the ``rows`` distinct ones of them whose URL has the smallest hash.

    Without rows, or with one label only, the model is that label's share (0 without rows).
    """
    host, path = host_and_path(F.col("url"))
    some = labelled.select("url", F.col("label").cast("double").alias("y")).where("y IS NOT NULL").distinct().orderBy(F.xxhash64("url"), "url", "y").limit(rows)
    some = cut(lexical(some.select("url", "y", host.alias("host"), path.alias("path"))))
    n, ones = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    prior = ones / n if n else 0.0
    if ones in (0, n):
        return UrlModel(None, prior, [], "0D")
    suffixes = cut(_rates(some, prior))
    x = _rated(some, suffixes, prior)
    cuts = [i / bins for i in range(1, bins)]
    found = x.agg(*[F.percentile_approx(f, cuts, 1000).alias(f) for f in FEATURES]).first()
    edges = [sorted(set(found[f])) for f in FEATURES]
    x = cut(_binned(x, edges).select("y", "b"))
    margin = f"{math.log(prior / (1 - prior))!r}D"
    for _ in range(trees):
        margin = f"{margin} + {_tree(x, margin, depth, rate)}"
    return UrlModel(suffixes, prior, edges, margin)


def _tree(x: DataFrame, margin: str, depth: int, rate: float) -> str:
    """One regression tree on the logistic loss, as SQL over the bins ``b``. A level is one aggregation."""
    x = x.selectExpr("b", "y", f"1 / (1 + exp(-({margin}))) AS p").selectExpr("b", "y - p AS g", "p * (1 - p) AS h")
    split: dict[int, tuple[int, int]] = {}  # node -> (feature, bin); children of n are 2n and 2n + 1

    def walk(node: int, leaf) -> str:
        if node not in split:
            return leaf(node)
        f, b = split[node]
        return f"if(b[{f}] <= {b}, {walk(2 * node, leaf)}, {walk(2 * node + 1, leaf)})"

    sums: dict[int, tuple[float, float]] = {}
    for level in range(depth + 1):
        node = F.expr(walk(1, str))
        cells: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
        for n, f, b, g, h in x.select(node.alias("node"), F.posexplode("b").alias("f", "v"), "g", "h").groupBy("node", "f", "v").agg(F.sum("g"), F.sum("h")).orderBy("node", "f", "v").collect():
            cells.setdefault(n, {}).setdefault(f, {})[b] = (g, h)
        for n, by in cells.items():
            g_all, h_all = (sum(v[i] for v in by[0].values()) for i in (0, 1))
            sums[n] = (g_all, h_all)
            if level == depth or n < 2**level:
                continue
            best = (1e-6, None)
            for f, hist in by.items():
                g = h = 0.0
                for b in sorted(hist)[:-1]:
                    g, h = g + hist[b][0], h + hist[b][1]
                    gain = g * g / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, b))
            if best[1]:
                split[n] = best[1]
    return walk(1, lambda n: f"{rate * sums.get(n, (0.0, 0.0))[0] / (sums.get(n, (0.0, 0.0))[1] + RIDGE)!r}D")


#: Held back from learning by the query: labelled URLs whose hash is divisible by HELD_OUT.
HELD_OUT = 5


def rule_labels(pages: DataFrame, rules: list = RULES) -> DataFrame:
    """The URLs that a rule decides: url, label (1 for block, 0 for allow), held_out."""
    held = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    return parsed(pages, rules).where("fit IS NOT NULL").select("url", (F.col("fit.verdict") == "block").cast("int").alias("label"), held.alias("held_out"))


def agreement(labelled: DataFrame, model: UrlModel) -> tuple[int, float, float]:
    """Of ``labelled`` (url, label): rows, the share that the model decides as labelled, and the share of the commoner label."""
    host, path = host_and_path(F.col("url"))
    got = model.score(labelled.select("url", "label", host.alias("host"), path.alias("path")))
    n, right, ones = got.agg(F.count(F.lit(1)), F.avg(((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double")), F.avg("label")).first()
    return n, right, max(ones, 1 - ones) if n else None


def judge(pages: DataFrame, model: UrlModel, rules: list = RULES) -> DataFrame:
    """Per row: page_id, host, path, rule (null without one), verdict, score.

    The longest fitting rule decides; without one the model blocks from a score of 0.5. Null URLs and
    those without ``://`` have an empty host and path and are judged by the model. Repeated rows give
    repeated results; other columns are not read. Empty input: no rows.
    """
    out = model.score(parsed(pages, rules))
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_model).alias("verdict"), "score")
