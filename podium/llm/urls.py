"""URL filters: rules, and for urls without a rule the trust of their host.

Rules seed the hosts: a host's trusted (blocked) seed is the share of its pages
that a rule allows (blocks).  Trust runs along the links between hosts, as
personalised PageRank; distrust runs against them, so that a host that links to
blocked ones takes part in their distrust.  A host's margin is its distrust less
its trust, as a share of both where they exceed 1, and it is blocked above a
cut.  The cut is fitted on the pages that rules judge: each is left out of its
host's seeds, and the cut that then tells blocked from allowed pages best is
taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from podium.plans.scratch import Scratch

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING, ROUNDS, SETTLED = 0.85, 20, 1e-4
#: The cut where rules do not judge pages of both kinds, and steps of the margin that the fit looks at.
THRESHOLD, STEPS = 0.5, 1_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*([^"'\s>]+)"""


_UNSEEN = r"(?is)<!--.*?-->|<(script|style|noscript|template|textarea)\b.*?</\1\s*>"


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without."""
    return _lower_ascii(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null.  A rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"), r[1])):
        of_host, slash, of_path = rule.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + of_path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, from anchors with absolute addresses outside comments and scripts."""
    seen = F.when(F.col(html_col).contains("//"), F.regexp_replace(html_col, _UNSEEN, " "))
    found = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(seen, F.lit(_HREF), 1)).alias("href"))
    absolute = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))
    ends = found.where(F.col("href").contains("//")).select("src", host_of(absolute).alias("dst"))
    return ends.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """(host, score): score = seed + damping * sum of neighbours' scores by their share of links.

    ``seeds`` (host, seed) and ``links`` (src, dst, n).  Ends after ``rounds``
    rounds or once scores change by less than ``settled`` in all.
    """
    spark = seeds.sparkSession
    scratch = Scratch(spark, "pagerank")
    seeds = scratch.table(seeds.where("seed > 0"), "seeds")
    score = seeds.withColumnRenamed("seed", "score")
    if links.isEmpty() or seeds.isEmpty():
        return score
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    share = scratch.table(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), "share")
    old = None
    for _ in range(rounds):
        came = share.join(score.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("share") * F.col("score"))).alias("came"))
        both = came.join(seeds, "host", "full").join(score.withColumnRenamed("score", "was"), "host", "left")
        nxt = scratch.table(both.select("host", (F.coalesce("came", F.lit(0.0)) + F.coalesce("seed", F.lit(0.0))).alias("score"), F.coalesce("was", F.lit(0.0)).alias("was")), "score")
        moved = nxt.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0
        scratch.drop(old)
        old, score = nxt, nxt.select("host", "score")
        if moved < settled:
            break
    return score


def margin(trust: Column, distrust: Column) -> Column:
    """Distrust less trust, from -1 to 1."""
    return (distrust - trust) / F.greatest(F.lit(1.0), distrust + trust)


def fitted_cut(hosts: DataFrame, default: float = THRESHOLD) -> float:
    """The cut of best balanced accuracy over rule-judged pages, each left out of its host's seeds.

    ``hosts`` (host, pages, allow, block, trust, distrust) with counts of pages
    and scores.  Half-way between the margins on either side of it.
    """
    n, a, b = F.col("pages"), F.col("allow"), F.col("block")
    others = F.greatest(n - 1, F.lit(1))
    came_t, came_d = F.col("trust") - a / n, F.col("distrust") - b / n  # what neighbours gave
    kinds = F.array(
        F.struct(F.lit(True).alias("blocked"), b.alias("weight"), margin(came_t + a / others, came_d + (b - 1) / others).alias("m")),
        F.struct(F.lit(False).alias("blocked"), a.alias("weight"), margin(came_t + (a - 1) / others, came_d + b / others).alias("m")),
    )
    step = F.floor((F.col("k.m") + 1) * STEPS)
    counts = hosts.select(F.explode(kinds).alias("k")).where("k.weight > 0").groupBy(step.alias("step")).agg(
        F.sum(F.when(F.col("k.blocked"), F.col("k.weight")).otherwise(0)).alias("block"), F.sum(F.when(F.col("k.blocked"), 0).otherwise(F.col("k.weight"))).alias("allow")
    )
    rows = sorted((r["step"], r["block"], r["allow"]) for r in counts.collect())  # one a step at most
    blocked, allowed = (sum(r[i] for r in rows) for i in (1, 2))
    if not blocked or not allowed:
        return default
    best, left_b, left_a = (0.0, default), 0, 0
    for (at, b_, a_), after in zip(rows, [r[0] for r in rows[1:]] + [2 * STEPS + 1]):
        left_b, left_a = left_b + b_, left_a + a_
        right = left_a / allowed + (blocked - left_b) / blocked
        if right >= best[0] - 1e-12:  # of equal ones the one that blocks least
            best = (right, (at + after + 1) / 2 / STEPS - 1)
    return best[1]


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, threshold: float | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every page; without a threshold, the cut is fitted.

    Null urls and urls without :// have an empty host and path, no rule and no
    seeds, hence are allowed.  Null html has no links; null ids and repeated
    rows are kept; an empty table gives no rows.  Other columns are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    url = F.col(url_col)
    found = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    found = found.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    found = scratch.table(found.select("id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("by_rule")), "rules")
    of = lambda v: F.count_if(F.col("by_rule") == v).alias(v)
    hosts = scratch.table(found.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), of("allow"), of("block")), "hosts")
    links = scratch.table(host_links(pages, url_col, html_col), "links")
    trust = propagate(hosts.select("host", (F.col("allow") / F.col("pages")).alias("seed")), links)
    distrust = propagate(hosts.select("host", (F.col("block") / F.col("pages")).alias("seed")), links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    scores = hosts.join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
    scores = scratch.table(scores.fillna(0.0, ["trust", "distrust"]), "scores")
    cut = fitted_cut(scores) if threshold is None else threshold
    judged = found.join(scores.select("host", "trust", "distrust"), "host", "left").fillna(0.0, ["trust", "distrust"])
    by_host = F.when(margin(F.col("trust"), F.col("distrust")) > cut, "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), "trust", "distrust")


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
