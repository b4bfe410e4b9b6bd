"""URL filter: rules first, then gradient-boosted trees on lexical features. DataFrame functions only.

Trees are grown by histograms: per level one aggregation of gradients per node, feature and bin, a
few hundred rows at most whatever the input, from which the driver picks the splits. The fit sees at
most ``FIT_ROWS`` labelled URLs, folded into their different binned feature vectors. Scoring is one
expression per row; only the suffix rates (from the fitted rows, so as many at most) are joined.

Null URLs and such without ``://`` have an empty host and path, no rule, and the method's verdict on
the features of an empty text. Repeated rows give repeated results, other columns are not read, an
empty table gives an empty one. Without labelled URLs of both kinds nothing is blocked but by rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import let, lower_ascii, stored

FIT_ROWS, BINS, ROUNDS, LEVELS, RATE, PENALTY = 50_000, 16, 8, 3, 0.4, 1.0
FEATURES = ("length", "host_length", "labels", "hyphens", "host_digits", "depth", "digit_share", "entropy", "host_entropy", "parameters", "longest_label", "suffix_rate")

# Rules as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# Words of hosts that were labelled as junk by hand.
JUNK_WORDS = ("bets", "casino", "pills", "spam")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def entropy(text: Column) -> Column:
    """Bits per character."""
    def over(chars: Column) -> Column:
        n = F.size(chars)
        share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
        return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return let(F.filter(F.split(text, ""), lambda c: c != ""), over)


def _digits(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "0123456789", ""))


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, suffix and all lexical features but the suffix rate."""
    text = F.coalesce(F.col(url), F.lit(""))
    rows = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    measures = {
        "length": F.length(text), "host_length": F.length("host"), "labels": F.size(labels), "hyphens": F.length("host") - F.length(F.translate("host", "-", "")),
        "host_digits": _digits(F.col("host")), "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")),
        "digit_share": _digits(text) / F.greatest(F.length(text), F.lit(1)), "entropy": entropy(text), "host_entropy": entropy(F.col("host")),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")), "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))),
    }
    return rows.withColumns({"suffix": F.element_at(labels, -1), **{k: v.cast("double") for k, v in measures.items()}})


@dataclass
class Node:
    feature: str = ""
    cut: float = 0.0
    below: Node | None = None
    above: Node | None = None
    value: float = 0.0

    def column(self) -> Column:
        if self.below is None:
            return F.lit(self.value)
        return F.when(F.col(self.feature) <= self.cut, self.below.column()).otherwise(self.above.column())


@dataclass
class Trees:
    rates: DataFrame | None = None
    prior: float = 0.0
    start: float = -4.0
    trees: list[Node] = field(default_factory=list)

    def probability(self) -> Column:
        margin = F.lit(self.start)
        for tree in self.trees:
            margin = margin + tree.column()
        return 1 / (1 + F.exp(-margin))


def _with_rates(rows: DataFrame, rates: DataFrame | None, prior: float) -> DataFrame:
    if rates is None:
        return rows.withColumn("suffix_rate", F.lit(prior))
    known = F.broadcast(rates)  # FIT_ROWS rows at most
    return rows.join(known, "suffix", "left").withColumn("suffix_rate", F.coalesce("rate", F.lit(prior))).drop("rate")


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """``labelled``: url, label (1 junk, 0 not; others are left out)."""
    drawn = labelled.filter("url IS NOT NULL AND label IN (0, 1)").select("url", "label").orderBy(F.xxhash64("url"), "url", "label").limit(rows)
    sample = stored(lexical(drawn))
    totals = sample.agg(F.count("*").alias("n"), F.sum("label").alias("junk")).first()
    if not totals["junk"] or totals["junk"] == totals["n"]:
        return Trees()
    prior = totals["junk"] / totals["n"]
    rates = stored(sample.groupBy("suffix").agg(((F.sum("label") + 10 * prior) / (F.count("*") + 10)).alias("rate")))
    rated = _with_rates(sample, rates, prior)
    edges = rated.agg(*[F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(edges[f])) for f in FEATURES}
    binned = [_bin(F.col(f), cuts[f]).alias(f) for f in FEATURES]
    folded = stored(rated.select("label", *binned).groupBy("label", *FEATURES).agg(F.count("*").alias("times")))

    start = math.log(prior / (1 - prior))
    grown: list[Node] = []  # over bins; raw values below
    for _ in range(ROUNDS):
        margin = F.lit(start)
        for tree in grown:
            margin = margin + tree.column()
        p = 1 / (1 + F.exp(-margin))
        slope = folded.select(*FEATURES, (F.col("times") * (p - F.col("label"))).alias("g"), (F.col("times") * p * (1 - p)).alias("h"))
        root = Node()
        leaves = [root]
        for level in range(LEVELS + 1):
            place = _place(root, leaves)
            if level == LEVELS:
                sums = {r["node"]: r for r in slope.groupBy(place.alias("node")).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}
                for i, leaf in enumerate(leaves):
                    if i in sums:
                        leaf.value = -RATE * sums[i]["g"] / (sums[i]["h"] + PENALTY)
                break
            per = slope.select(place.alias("node"), "g", "h", F.posexplode(F.array(*FEATURES)).alias("feature", "bin"))
            table = per.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            leaves = [x for i, leaf in enumerate(leaves) for x in _split(leaf, [r for r in table if r["node"] == i])]
        grown.append(root)
    return Trees(rates, prior, start, [_raw(t, cuts) for t in grown])


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the value."""
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(value > float(c), 1).otherwise(0)
    return out


def _place(root: Node, leaves: list[Node]) -> Column:
    def walk(node: Node) -> Column:
        if node.below is None:
            return F.lit(next(i for i, leaf in enumerate(leaves) if leaf is node))
        return F.when(F.col(node.feature) <= node.cut, walk(node.below)).otherwise(walk(node.above))

    return walk(root)


def _split(leaf: Node, rows: list) -> list[Node]:
    """The split of the leaf with the largest gain, if any; the first of equal ones."""
    best = (1e-6, 0, 0)
    for number in range(len(FEATURES)):
        own = sorted((r for r in rows if r["feature"] == number), key=lambda r: r["bin"])
        g, h = sum(r["g"] for r in own), sum(r["h"] for r in own)
        a = b = 0.0
        for r in own[:-1]:
            a, b = a + r["g"], b + r["h"]
            gain = a * a / (b + PENALTY) + (g - a) ** 2 / (h - b + PENALTY) - g * g / (h + PENALTY)
            if gain > best[0] + 1e-9:
                best = (gain, number, r["bin"])
    if best[0] <= 1e-6:
        return [leaf]
    leaf.feature, leaf.cut, leaf.below, leaf.above = FEATURES[best[1]], best[2], Node(), Node()
    return [leaf.below, leaf.above]


def _raw(node: Node, cuts: dict[str, list[float]]) -> Node:
    """From bins to values: a bin is at most k where the value is at most the k-th cut (from 0)."""
    if node.below is None:
        return node
    return Node(node.feature, float(cuts[node.feature][int(node.cut)]), _raw(node.below, cuts), _raw(node.above, cuts))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for of, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, of + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def judge(urls: DataFrame, model: Trees, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """One row per URL: page_id, host, path, rule, verdict, junk_score."""
    rows = lexical(urls.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    scored = _with_rates(rows, model.rates, model.prior).withColumn("junk_score", model.probability())
    own = F.when(F.col("junk_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, own).alias("verdict"), "junk_score")


def hand_labels(urls: DataFrame, url: str = "url") -> DataFrame:
    """Labels of URLs by the junk words in their hosts."""
    return urls.select(F.col(url).alias("url"), host_of(F.col(url)).rlike("|".join(JUNK_WORDS)).cast("int").alias("label"))
