"""URL filters: longest-prefix rules, and link-graph propagation for what no rule decides.

Rules name a host, with all its subdomains, and a path prefix; the longest that fits a URL
decides it. Hosts whose pages are allowed by rules are trusted seeds, hosts whose pages are
blocked are distrusted seeds, each in proportion to such pages. Trust follows the host links,
distrust follows them backwards. A host's score is what a personalised PageRank walk that
starts there (against the links for trust, along them for distrust) expects of the seeds it
meets, and at least the host's own seed: a mean over its links, which neither more linkers nor
a larger graph make smaller. A host is blocked if its distrust reaches a threshold and exceeds
its trust.

Defined results: a null url or one without ``://`` has an empty host and path, no rule and
the verdict allow; null html has no links; a null page_id is kept; rows repeated exactly get
the same verdict; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mediacat.llm.frames import ascii_lower
from mediacat.runtime import materialize, release

# Production parameters: share of the score that follows links, distance from the limit within
# which rounds end, distrust at which a host is blocked, and the fewest labels of a host that
# counts as the site of its subdomains.
DAMPING = 0.85
TOLERANCE = 1e-6
BLOCK_AT = 0.5
SITE_LABELS = 3

_HREF = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.when(F.instr(url, F.lit("://")) > 0, ascii_lower(host)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))
    return F.when(F.instr(url, F.lit("://")) > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def suffixes(host: Column) -> Column:
    """The host and the domains it lies in."""
    labels = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def longest_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict) of the distinct urls (host, path) that a rule fits.

    ``rules`` has host, path prefix and verdict. Longest first, then the longer host, then block.
    """
    named = rules.select(
        F.col("host").alias("__rule_host"), F.col("path").alias("__rule_path"), F.col("verdict").alias("__rule_verdict")
    )
    fits = (
        urls.select("host", "path").distinct()
        .withColumn("__rule_host", F.explode(suffixes(F.col("host"))))
        .join(named, "__rule_host")
        .filter(F.startswith("path", F.col("__rule_path")))
    )
    rule = F.concat("__rule_host", "__rule_path")
    rank = F.struct(F.char_length(rule), F.char_length("__rule_host"), F.col("__rule_verdict"), rule.alias("rule"))
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.__rule_verdict").alias("rule_verdict"))


def host_links(pages: DataFrame, site_labels: int = SITE_LABELS) -> DataFrame:
    """(src, dst, weight): pages of one host that link to another, and links between a host and its site."""
    own = host_of(F.col("url"))
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)))
    outside = F.filter(hrefs, lambda h: F.contains(h, F.lit("://")) | F.startswith(h, F.lit("//")))
    links = (
        pages.select(own.alias("src"), F.explode(outside).alias("href"))
        .select("src", host_of(F.when(F.startswith("href", F.lit("//")), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))).alias("dst"))
    )
    hosts = pages.select(own.alias("host")).distinct().filter("host <> ''")
    site = F.regexp_extract("host", r"^[^.]*\.(.*)$", 1)
    up = hosts.select(F.col("host").alias("src"), site.alias("dst")).filter(
        F.size(F.split("dst", r"\.", -1)) >= site_labels
    )
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return (
        links.unionByName(up).unionByName(down)
        .filter("src <> dst AND src <> '' AND dst <> ''")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )


def propagate(
    seeds: DataFrame,
    links: DataFrame,
    damping: float = DAMPING,
    rounds: int | None = None,
    averaged: bool = False,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) over links (src, dst, weight).

    Trust goes along the links, distrust against them. By default a host deals its score out
    and the sum is kept; a host without a way on keeps its score. ``averaged`` is the walk seen
    from its start: a host takes the weighted mean of those its links come from (trust) or lead
    to (distrust), as far as that exceeds its own seed, so scores stay comparable with seeds.
    Each round is one join and one aggregate over the host graph, written to the shared folder.
    A round shrinks what is left by ``damping`` (the greatest change of means, else the summed
    change), so rounds end once damping / (1 - damping) times the last change, which bounds the
    distance from the limit, is within ``tolerance``, or after ``rounds``, if given.
    """
    by = "dst" if averaged else "src"
    kinds = [("trust", "src", "dst"), ("distrust", "dst", "src")]
    ways = None
    for kind, a, b in kinds:
        one = links.select(F.lit(kind).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst"), "weight")
        ways = one if ways is None else ways.unionByName(one)
    total = ways.groupBy("kind", by).agg(F.sum("weight").alias("__all"))
    stack = F.expr("stack(2, 'trust', trust, 'distrust', distrust) AS (kind, score)")
    start = materialize(seeds.select("host", stack), "seeds")
    shares = ways.join(total, ["kind", by]).select("kind", "src", "dst", (F.col("weight") / F.col("__all")).alias("share"))
    if not averaged:
        hosts = start.select("kind", F.col("host").alias("src")).unionByName(
            ways.select("kind", F.col("dst").alias("src"))
        ).distinct()
        ends = hosts.join(total, ["kind", "src"], "left_anti")
        shares = shares.unionByName(ends.select("kind", "src", F.col("src").alias("dst"), F.lit(1.0).alias("share")))
    graph = materialize(shares, "graph")
    score = start.filter("score > 0")
    done, left = 0, float("inf")
    while left > tolerance if rounds is None else done < rounds:
        moved = score.withColumnRenamed("host", "src").join(graph, ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("got"), F.lit(0.0).alias("own"), F.lit(0.0).alias("old")
        )
        own = start.filter("score > 0").select("kind", "host", F.lit(0.0).alias("got"), F.col("score").alias("own"), F.lit(0.0).alias("old"))
        last = score.select("kind", "host", F.lit(0.0).alias("got"), F.lit(0.0).alias("own"), F.col("score").alias("old"))
        both = moved.unionByName(own).unionByName(last).groupBy("kind", "host").agg(*[F.sum(c).alias(c) for c in ("got", "own", "old")])
        more = F.col("got") - F.col("own")
        more = F.greatest(more, F.lit(0.0)) if averaged else more
        fresh = both.select("kind", "host", (F.col("own") + damping * more).alias("score"), "old")
        change = F.abs(F.col("score") - F.col("old"))
        seen = Observation()
        fresh = fresh.observe(seen, (F.max(change) if averaged else F.sum(change)).alias("change"))
        before, score = score, materialize(fresh.drop("old"), "score")
        release(before)
        done, left = done + 1, (seen.get["change"] or 0.0) * damping / (1 - damping)
    release(graph)

    def of(kind):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)

    return score.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: DataFrame, block_at: float = BLOCK_AT, **how) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    rows = materialize(
        pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "urls"
    )
    ruled = materialize(rows.join(longest_rule(rows, rules), ["host", "path"], "left"), "ruled")

    def share(verdict):
        return F.avg(F.when(F.col("rule_verdict") == verdict, 1.0).otherwise(0.0))

    seeds = ruled.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(seeds, host_links(pages.select("url", "html")), averaged=True, **how)
    # sums of doubles differ in their last bits from run to run, and from the limit by TOLERANCE
    trust, distrust = F.round("trust", 5), F.round("distrust", 5)
    blocked = (distrust >= block_at) & (distrust > trust)
    hosts = scores.select("host", trust.alias("trust"), distrust.alias("distrust"), F.when(blocked, "block").otherwise("allow").alias("host_verdict"))
    return ruled.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
