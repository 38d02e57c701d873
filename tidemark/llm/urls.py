"""URL filters: dated rules first, else gradient-boosted trees on lexical features (DataFrame functions only).

The trees are grown by histogram aggregation: every level is one ``groupBy(node, feature, bin)``
over the labelled sample, whose few sums choose the splits on the driver; a finished tree is a
CASE expression, so that scoring stays in generated code.  Labelled URLs are those that a rule
decides.  The sample holds about ``max_train`` of them, chosen by a hash.

Null URLs and URLs without ``://`` have empty host and path and no rule; the trees judge them too.
With one kind of label or none, the method's verdict is that label or ``allow``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels", "suffix_rate", "directory_rate")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict."""
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: -len(r[1])):
        cut = text.index("/")
        fits = ((host == text[:cut]) | host.endswith("." + text[:cut])) & path.startswith(text[cut:])
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(said)) if verdict is None else verdict.when(fits, F.lit(said))
    return rule, verdict


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features that need no labels, from ``url``, ``host``, ``path``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(url)
    counts = F.transform(F.array_distinct(F.split(url, "")), lambda c: F.length(url) - F.length(F.replace(url, c, F.lit(""))))
    share = lambda x: x / F.greatest(n, F.lit(1))
    entropy = F.aggregate(counts, F.lit(0.0), lambda s, k: s - F.when(k > 0, share(k) * F.log2(share(k))).otherwise(0.0))
    count = lambda s: (n - F.length(F.replace(url, F.lit(s), F.lit("")))) / len(s)
    return df.withColumns(
        {
            "length": n.cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": F.regexp_count("path", F.lit("/")).cast("double"),
            "digit_ratio": share(F.regexp_count(url, F.lit("[0-9]"))),
            "entropy": entropy,
            "parameters": count("=").cast("double"),
            "hyphens": count("-").cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "suffix": F.regexp_extract("host", r"([^.]*)$", 1),
            "directory": F.regexp_extract("path", r"^/?([^/]*)", 1),
        }
    )


def train(labelled: DataFrame, rounds: int = 6, depth: int = 2, bins: int = 16, rate: float = 0.5, smooth: float = 1.0) -> Column:
    """A score Column (log odds of block) over FEATURES, from rows with FEATURES and ``y`` (0 or 1)."""
    ends = labelled.approxQuantile(list(FEATURES), [i / bins for i in range(1, bins)], 0.01)
    cuts = {f: sorted(set(q)) for f, q in zip(FEATURES, ends, strict=True)}
    mean = labelled.agg(F.avg("y").alias("m")).first()["m"]
    score = F.lit(math.log(mean / (1 - mean)))
    cells = [
        F.struct(F.lit(i).alias("f"), sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias("b"))
        for i, f in enumerate(FEATURES)
        if cuts[f]
    ]
    if not cells:
        return score
    labelled = materialize(labelled.withColumn("_cells", F.array(*cells)).withColumn("_score", score), "url-train")
    for _ in range(rounds):
        node: Column = F.lit(1)
        p = 1 / (1 + F.exp(-F.col("_score")))
        base = labelled.withColumn("g", F.col("y") - p).withColumn("h", p * (1 - p))
        values: dict[int, float] = {}
        live = {1}
        for level in range(depth):
            sums = base.withColumn("node", node).select("node", "g", "h", F.explode("_cells").alias("x")).groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            split: dict[int, tuple[str, float]] = {}
            for k in live:
                mine = [r for r in sums if r["node"] == k]
                if not mine:
                    continue
                least = mine[0]["f"]
                g_all = sum(r["g"] for r in mine if r["f"] == least)
                h_all = sum(r["h"] for r in mine if r["f"] == least)
                values[k] = rate * g_all / (h_all + smooth)
                gain_best = 1e-6
                for i in {r["f"] for r in mine}:
                    g = h = 0.0
                    by = {r["b"]: r for r in mine if r["f"] == i}
                    for b, cut in enumerate(cuts[FEATURES[i]]):
                        if b in by:
                            g, h = g + by[b]["g"], h + by[b]["h"]
                        gain = g * g / (h + smooth) + (g_all - g) ** 2 / (h_all - h + smooth) - g_all**2 / (h_all + smooth)
                        if round(gain, 9) > gain_best:
                            gain_best, split[k] = round(gain, 9), (FEATURES[i], cut)
                if k in split:
                    left = [r for r in mine if FEATURES[r["f"]] == split[k][0] and cuts[split[k][0]][: r["b"]].count(split[k][1]) == 0]
                    gl, hl = sum(r["g"] for r in left), sum(r["h"] for r in left)
                    values[2 * k], values[2 * k + 1] = rate * gl / (hl + smooth), rate * (g_all - gl) / (h_all - hl + smooth)
            was = node
            for k, (f, cut) in split.items():
                node = F.when(was == k, F.when(F.col(f) > cut, 2 * k + 1).otherwise(2 * k)).otherwise(node)
            live = {c for k in split for c in (2 * k, 2 * k + 1)}
        leaf = F.lit(0.0)
        for k, v in values.items():
            leaf = F.when(node == k, F.lit(float(v))).otherwise(leaf)
        score = score + leaf
        labelled = materialize(labelled.withColumn("_score", F.col("_score") + leaf), "url-train")  # short expressions in each round
    return score


def judge(pages: DataFrame, rules=RULES, max_train: int = 20_000, smooth: float = 20.0) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_probability."""
    base = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    base = base.withColumn("host", host).withColumn("path", path)
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    base = lexical(base.withColumn("rule", rule).withColumn("said", said))
    counts = {r["said"]: r["count"] for r in base.groupBy("said").count().collect()}
    known = {k: v for k, v in counts.items() if k}
    if len(known) < 2:
        only = next(iter(known), "allow")
        return base.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit(only)).alias("verdict"), F.lit(1.0 if only == "block" else 0.0).alias("block_probability"))
    share = min(1.0, max_train / sum(known.values()))
    sample = base.where(F.col("said").isNotNull()).where(F.xxhash64("url", F.lit(3)).bitwiseAND((1 << 63) - 1) <= F.lit(min((1 << 63) - 1, int(share * (1 << 63)))))
    sample = materialize(sample.withColumn("y", (F.col("said") == "block").cast("double")), "url-sample")
    stats = sample.agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n")).first()
    if not stats["n"] or stats["m"] in (0.0, 1.0):
        only = max(known, key=lambda k: known[k])
        return base.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit(only)).alias("verdict"), F.lit(1.0 if only == "block" else 0.0).alias("block_probability"))
    mean = stats["m"]

    def with_rate(df: DataFrame, key: str) -> DataFrame:
        # at most max_train keys
        rates = sample.groupBy(F.col(key).alias("_k")).agg(((F.sum("y") + smooth * mean) / (F.count(F.lit(1)) + smooth)).alias(f"{key}_rate"))
        return df.join(F.broadcast(rates), F.col(key) == F.col("_k"), "left").drop("_k").withColumn(f"{key}_rate", F.coalesce(f"{key}_rate", F.lit(mean)))

    score = train(materialize(with_rate(with_rate(sample, "suffix"), "directory"), "url-train"))
    scored = with_rate(with_rate(base, "suffix"), "directory").withColumn("block_probability", 1 / (1 + F.exp(-score)))
    method = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "block_probability")
