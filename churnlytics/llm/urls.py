"""URL filters (operator 5): DataFrame functions only.

Rules on host and path come first. The rest is judged by its host: trust
spreads from hosts with allowed pages along the links between hosts, distrust
from hosts with blocked pages against the links (who links to bad hosts is
bad). Both are personalised PageRanks by power iteration over the weighted
host graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlytics.llm.common import UPPER, store

# Rules of the contract: verdict, host + path.
CONTRACT_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
URL_RE = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK_RE = r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), URL_RE, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_RE, 2)


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """``(verdict, rule)`` pairs as a table ``(r_host, r_path, rule, r_verdict)``."""
    rows = F.array(*[F.struct(F.lit(r.split("/", 1)[0]).alias("r_host"),
                              F.lit("/" + r.split("/", 1)[1]).alias("r_path"),
                              F.lit(r).alias("rule"), F.lit(v).alias("r_verdict")) for v, r in rules])
    return spark.range(1).select(F.inline(rows))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, rules)``: all rules of a host and of the domains above it."""
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)),
                        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return (hosts.select("host", F.explode(above).alias("r_host")).join(rules, "r_host")
            .groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("n"), "rule", "r_path",
                                                         "r_verdict")).alias("rules")))


def host_links(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: links between different hosts in ``pages(host, html)``."""
    to = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK_RE), F.lit(1)))
    return (pages.where("host <> ''").select(F.col("host").alias("src"), to.alias("to"))
            .select("src", lower_ascii(F.col("to")).alias("dst")).where("src <> dst")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))


def propagate(links: DataFrame, seeds: DataFrame, sizes: DataFrame | None = None, damping: float = 0.85,
              tolerance: float = 1e-6, max_rounds: int = 60) -> DataFrame:
    """Personalised PageRank of several kinds at once, in units of the seeds:
    ``links(kind, src, dst, n)`` and ``seeds(kind, host, weight)`` give ``(kind,
    host, mass)`` with mass = weight + damping x (shares of the masses of the
    hosts that link here).

    That is the usual PageRank with its teleport kept apart (not scaled to a
    sum of 1), so a host's mass depends on its own seeds and on the hosts from
    which links lead to it, and on nothing else in the graph. Rounds stop when
    no host's mass, divided by its ``sizes(host, pages)``, grew by
    ``tolerance`` or more, whatever the number of hosts; after ``max_rounds``
    at most damping^max_rounds of the mass is missing.
    """
    out = links.groupBy("kind", "src").agg(F.sum("n").alias("all_n"))
    share = store(links.join(out, ["kind", "src"])
                  .select("kind", "src", "dst", (F.col("n") / F.col("all_n") * damping).alias("share")))
    base = store(seeds.select("kind", "host", F.col("weight").cast("double").alias("mass"), F.lit(0.0).alias("old")))
    state = base.select("kind", "host", "mass")
    for _ in range(max_rounds):
        moved = (state.withColumnRenamed("host", "src").join(share, ["kind", "src"])
                 .select("kind", F.col("dst").alias("host"), (F.col("mass") * F.col("share")).alias("mass"), F.lit(0.0).alias("old")))
        former = state.select("kind", "host", F.lit(0.0).alias("mass"), F.col("mass").alias("old"))
        new = store(base.unionByName(moved).unionByName(former).groupBy("kind", "host")
                    .agg(F.sum("mass").alias("mass"), F.sum("old").alias("old")))
        grew = new.join(sizes, "host", "left") if sizes is not None else new.withColumn("pages", F.lit(1))
        most = grew.agg(F.max((F.col("mass") - F.col("old")) / F.coalesce("pages", F.lit(1)))).first()[0]
        state = new.select("kind", "host", "mass")
        if most is None or most < tolerance:
            break
    return state


def judge_urls(pages: DataFrame, rules=CONTRACT_RULES, threshold: float = 0.5, id_col: str = "page_id",
               url_col: str = "url", html_col: str = "html", damping: float = 0.85,
               tolerance: float = 1e-6) -> DataFrame:
    """One row per page: the id, host, path, rule, verdict, trust, distrust.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest wins. Without a rule, a page is blocked if its host's distrust
    exceeds its trust by ``threshold`` or more. Trust is the host's mass of the
    PageRank from allowed pages, in units of allowed pages, divided by the
    host's pages; distrust likewise from blocked pages against the links. A
    host that no link reaches has the share of its allowed, or blocked, pages,
    whatever else the table holds; a difference of exactly ``threshold`` blocks.

    Defined cases: a null url, or one without '://', has empty host and path,
    no rule, no links, no seeds and the verdict allow; a null html has no
    links; links to the own host count nothing; null ids and repeated rows are
    kept; very long pages are read whole; an empty table gives an empty result. Columns other than the three
    named are not read.
    """
    spark = pages.sparkSession
    p = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"),
                     url_path(F.col(url_col)).alias("path"))
    rules = rule_table(spark, rules) if not isinstance(rules, DataFrame) else rules
    # Written tables, so that the joins with pages below can split a hot host.
    found = store(host_rules(p.where("host <> ''").select("host").distinct(), rules))
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["r_path"])))
    judged = store(p.join(found, "host", "left").withColumn("best", best)
                   .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                           F.col("best.r_verdict").alias("r_verdict")))
    per_host = store(judged.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count(F.when(F.col("r_verdict") == "allow", 1)).alias("good"),
        F.count(F.when(F.col("r_verdict") == "block", 1)).alias("bad")))
    links = store(host_links(pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))))
    both = (links.select(F.lit("trust").alias("kind"), "src", "dst", "n")
            .unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"),
                                      F.col("src").alias("dst"), "n")))
    seeds = (per_host.where("good > 0").select(F.lit("trust").alias("kind"), "host", F.col("good").alias("weight"))
             .unionByName(per_host.where("bad > 0").select(F.lit("distrust").alias("kind"), "host",
                                                           F.col("bad").alias("weight"))))
    mass = propagate(both, seeds, per_host.select("host", "pages"), damping, tolerance).groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("mass"))).alias("t"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("mass"))).alias("d"))
    scores = store(per_host.join(mass, "host", "left").select(
        "host", (F.coalesce("t", F.lit(0.0)) / F.col("pages")).alias("trust"),
        (F.coalesce("d", F.lit(0.0)) / F.col("pages")).alias("distrust")))
    own = F.when(F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)) >= threshold, "block") \
           .otherwise("allow")
    return judged.join(scores, "host", "left").select(
        F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("r_verdict", own).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def urls_sql(rounds: int = 60, damping: float = 0.85, threshold: float = 0.5) -> str:
    """DuckDB SQL of the contract's query: the same rules and graph, the rounds
    of the power iteration unrolled."""
    rules = ", ".join(f"('{v}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}')" for v, r in CONTRACT_RULES)
    steps = "".join(f"""
x{k} AS MATERIALIZED (SELECT kind, host, sum(mass) AS mass FROM (
  SELECT kind, host, weight AS mass FROM seeds UNION ALL
  SELECT x{k - 1}.kind, dst, mass * share FROM x{k - 1} JOIN share ON share.kind = x{k - 1}.kind AND src = host)
  GROUP BY ALL),""" for k in range(1, rounds + 1))
    return rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(verdict, r_host, r_path, rule) AS (VALUES {rules}),
j AS (
  SELECT p.r, p.page_id, p.host, p.path, b.rule, b.verdict FROM p LEFT JOIN (
    SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
    FROM p JOIN rules ON (p.host = r_host OR ends_with(p.host, '.' || r_host)) AND starts_with(p.path, r_path)
    GROUP BY r) b USING (r)),
per_host AS (
  SELECT host, count(*) AS pages, count(*) FILTER (verdict = 'allow') AS good, count(*) FILTER (verdict = 'block') AS bad
  FROM j WHERE host <> '' GROUP BY host),
links AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, translate(unnest(regexp_extract_all(html,
      '(?i)\shref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM p WHERE host <> '')
  WHERE src <> dst GROUP BY ALL),
edges AS (SELECT 'trust' AS kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
share AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) * {damping!r} AS share FROM edges),
seeds AS (
  SELECT 'trust' AS kind, host, good::DOUBLE AS weight FROM per_host WHERE good > 0
  UNION ALL SELECT 'distrust', host, bad::DOUBLE FROM per_host WHERE bad > 0),
x0 AS (SELECT kind, host, weight AS mass FROM seeds),{steps}
mass AS (SELECT * FROM x{rounds}),
score AS (
  SELECT host, coalesce(t.mass, 0) / pages AS trust, coalesce(d.mass, 0) / pages AS distrust
  FROM per_host LEFT JOIN (SELECT * FROM mass WHERE kind = 'trust') t USING (host)
  LEFT JOIN (SELECT * FROM mass WHERE kind = 'distrust') d USING (host))
SELECT page_id, j.host, path, rule,
  coalesce(verdict, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) >= {threshold!r} THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN score ON score.host = j.host
"""
