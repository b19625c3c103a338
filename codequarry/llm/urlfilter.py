"""URL verdicts: rules by host and path, and trust spread over the link graph.

Rules decide the pages they fit.  For the other pages, trust starts at hosts
with allowed pages and follows links forward (personalised PageRank); distrust
starts at hosts with blocked pages and follows links backward, to the hosts
that link there.  A host with more distrust than trust is blocked.

Links are summed to weighted host edges first (map-side combined), so a host
with very many pages or links is a few rows in the graph.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from codequarry.scratch import Scratch


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str  # host/path-prefix

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


#: The rules of the contract.
RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
#: Share of the mass that may still be on its way when the walk ends.
TOLERANCE = 1e-4
#: Links with a host: ``scheme://host/...`` or ``//host/...``; others stay on their host.
LINK = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest fitting rule, or null.  A rule fits its
    host and all subdomains if the path starts with the rule's."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.pattern).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def spread(edges: DataFrame, seeds: DataFrame, scratch: Scratch, name: str, damping: float = DAMPING) -> DataFrame:
    """(host, score): personalised PageRank over (src, dst, weight) from
    (host, seed).

    The score is the sum over all walks from the seeds: each round moves the
    mass of the last one over the links, ``damping`` of it, until at most
    ``TOLERANCE`` of all mass can still arrive.  Mass at hosts without links out
    returns to the seeds in their shares, which only scales the sum, so scores
    are scaled to sum 1 at the end.  Without seeds, no rows.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    steps = scratch.save(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), f"{name}-steps")
    total = seeds.agg(F.sum("seed").alias("all")).first()["all"]
    front = scratch.save(seeds.where("seed > 0").select("host", (F.col("seed") / F.lit(float(total or 1.0))).alias("part")), f"{name}-walk/0")
    mass, masses = front.agg(F.sum("part")).first()[0], []
    while mass:
        masses.append(mass)
        if mass * damping / (1 - damping) <= TOLERANCE:
            break
        moved = front.join(steps, F.col("host") == F.col("src")).groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("part") * F.col("share")) * damping).alias("part"))
        front = scratch.save(moved, f"{name}-walk/{len(masses)}")
        mass = front.agg(F.sum("part")).first()[0]
    walks = edges.sparkSession.read.schema("host string, part double").parquet(*[f"{scratch.root}/{name}-walk/{k}" for k in range(max(len(masses), 1))])
    return walks.groupBy("host").agg(F.round(F.sum("part") / (sum(masses) or 1.0), 12).alias("score"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts; a link without a scheme
    (``//host/``) counts, one without a host stays on its own."""
    links = pages.where("html like '%//%'").select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("href"))
    return links.select("src", host_of(F.regexp_replace("href", "^//", "http://")).alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def judge(pages: DataFrame, rules=RULES, label: str = "urls") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, trust, distrust.

    Needs ``page_id``, ``url`` and ``html``; other columns are not read.  A null
    url or one without ``://`` has empty host and path.  Without a rule the
    verdict is block if the host's distrust exceeds its trust, else allow; a
    host that neither reaches is allowed.  Seeds are weighted by the number of
    the host's pages that the rules allow or block.  Repeated rows stay.
    """
    scratch = Scratch(pages.sparkSession, label)
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "hit.rule", "hit.verdict")
    hosts = scratch.save(parsed.where("host <> ''").groupBy("host").agg(F.count_if(F.col("verdict") == "allow").cast("double").alias("allowed"), F.count_if(F.col("verdict") == "block").cast("double").alias("blocked")), "hosts")
    edges = scratch.save(host_edges(pages.select("url", "html")), "edges")
    trust = spread(edges, hosts.select("host", F.col("allowed").alias("seed")), scratch, "trust")
    distrust = spread(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), hosts.select("host", F.col("blocked").alias("seed")), scratch, "distrust")
    scores = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full_outer").na.fill(0.0)
    scores = scratch.save(scores, "scores")
    return parsed.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
