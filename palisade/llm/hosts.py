"""URL filters by link-graph propagation over hosts.

Rules of a policy (allow or block; a host and a path prefix) judge the URLs they fit. All others are judged by their
host: personalised PageRank spreads trust from the hosts whose URLs the policy allows along the links, and distrust
from the hosts whose URLs it blocks against them (a page that links to bad hosts is suspect). A host is blocked when
its distrust is more than ``ratio`` times its trust; with neither of the two it is allowed.

Host edges come from absolute links in the pages; besides, every host and its parent domain are linked both ways, as
the hosts of one site belong together (a parent must have two labels more than none: ``b.example.com`` has the parent
``example.com``; ``example.com`` has none, so that sites are not joined by their top domain). Edges are counted before
they are spread, ranks are summed with partial sums, and every few rounds are written to the shared folder.

A NULL url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Repeated rows count as
often as they occur. Extra columns stay; result names that clash get a trailing underscore. Empty tables give an
empty result.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm.common import free_name, query, stored, table

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# verdict, host, path
POLICY = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
LINK = r"""(?i)href\s*=\s*["']?([a-z]+://[^"'\s>]+)"""
ROUNDS, DAMPING, RATIO, SAVE_EVERY = 8, 0.85, 1.0, 4


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, policy=POLICY) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else NULL; of equally long ones the first."""
    def fits(rule_host, rule_path):
        return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)

    ordered = sorted(policy, key=lambda p: -len(p[1] + p[2]))
    cases = [(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered]
    first, *rest = cases
    return reduce(lambda made, case: made.when(*case), rest, F.when(*first))


def parent_of(host: Column) -> Column:
    """The domain above, NULL where that would have fewer than two labels."""
    above = F.regexp_extract(host, r"^[^.]+\.(.+\..+)$", 1)
    return F.nullif(above, F.lit(""))


def host_edges(pages: DataFrame, hosts: DataFrame, host: str, html: str) -> DataFrame:
    """src, dst, n: links between different hosts, and each host with its parent both ways."""
    links = pages.select(
        F.col(host).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1))).alias("u"))
    web = links.select("src", host_of(F.col("u")).alias("dst")).where("src <> dst AND src <> '' AND dst <> ''")
    web = web.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("n"))
    up = hosts.select(F.col("host").alias("src"), parent_of(F.col("host")).alias("dst")).where("dst IS NOT NULL")
    both = up.select("src", "dst").unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = both.distinct().withColumn("n", F.lit(1.0))
    return web.unionByName(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagated(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust after ``rounds`` of personalised PageRank.

    ``seeds``: host, good and bad (number of allowed and blocked URLs). Trust starts as the host's share of all good
    URLs, distrust as its share of all bad ones. Trust follows the edges, distrust runs against them; both are rows of
    one table told apart by ``kind``, so a round is one join and one aggregation.
    """
    spark = seeds.sparkSession
    ways = edges.select(F.lit("t").alias("kind"), "src", "dst", "n").unionByName(
        edges.select(F.lit("d").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = ways.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    steps = stored(ways.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("out")).alias("w")), "steps")
    totals = seeds.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    start = seeds.select("host", F.explode(F.array(
        F.struct(F.lit("t").alias("kind"), (F.col("good") / F.lit(float(totals.g or 1))).alias("r")),
        F.struct(F.lit("d").alias("kind"), (F.col("bad") / F.lit(float(totals.b or 1))).alias("r")))).alias("k"))
    start = stored(start.select("host", "k.kind", "k.r").where("r > 0"), "seeds")
    rank = start
    for step in range(1, rounds + 1):
        moved = rank.withColumnRenamed("host", "src").join(steps, ["src", "kind"]).select(
            F.col("dst").alias("host"), "kind", (F.lit(damping) * F.col("r") * F.col("w")).alias("r"))
        again = start.select("host", "kind", (F.lit(1 - damping) * F.col("r")).alias("r"))
        rank = moved.unionByName(again).groupBy("host", "kind").agg(F.sum("r").alias("r"))
        if step % SAVE_EVERY == 0 and step < rounds:
            rank = stored(rank, "ranks")
    side = lambda k: F.sum(F.when(F.col("kind") == k, F.col("r")).otherwise(0.0))
    return rank.groupBy("host").agg(side("t").alias("trust"), side("d").alias("distrust"))


def judged(pages: DataFrame, policy=POLICY, url: str = "url", html: str = "html", rounds: int = ROUNDS,
           damping: float = DAMPING, ratio: float = RATIO) -> DataFrame:
    """``pages`` with host, path, rule, verdict, trust and distrust."""
    name = {c: free_name(pages, c) for c in ("host", "path", "rule", "verdict", "trust", "distrust")}
    fit = free_name(pages, "_fit")
    h, p = name["host"], name["path"]
    read = pages.withColumns({h: host_of(F.col(f"`{url}`")), p: path_of(F.col(f"`{url}`"))})
    read = read.withColumn(fit, fitting_rule(F.col(h), F.col(p), policy))
    verdict = F.col(f"{fit}.verdict")
    found = stored(read.where(F.col(h) != "").groupBy(F.col(h).alias("host")).agg(
        F.sum((verdict == "allow").cast("long")).alias("good"), F.sum((verdict == "block").cast("long")).alias("bad")), "hosts")
    seeds = found.fillna(0, ["good", "bad"])
    # stored, so that its size is known: sent to the tasks if small, else a join whose large partitions can be split
    ranks = stored(propagated(seeds, host_edges(read, found, h, html), rounds, damping), "ranks")
    # hosts of the graph that have no page need no verdict
    own = free_name(read, "_host")
    known = ranks.withColumnsRenamed({"host": own, "trust": name["trust"], "distrust": name["distrust"]})
    done = read.join(known, F.col(h) == F.col(own), "left").drop(own)
    trust, distrust = (F.coalesce(F.col(name[c]), F.lit(0.0)) for c in ("trust", "distrust"))
    by_host = F.when(distrust > F.lit(ratio) * trust, "block").otherwise("allow")
    return done.withColumns({
        name["rule"]: F.col(f"{fit}.rule"), name["verdict"]: F.coalesce(verdict, by_host),
        name["trust"]: trust, name["distrust"]: distrust}).drop(fit)


def oracle(rounds: int = ROUNDS) -> str:
    """The same in SQL, one pair of views for each round."""
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'r': '{h + p}', 'v': '{v}'}}"
        for v, h, p in sorted(POLICY, key=lambda p: -len(p[1] + p[2])))
    steps = "".join(f""",
r{k} AS (SELECT host, kind, sum(r) AS r FROM (
  SELECT s.dst AS host, s.kind, {DAMPING} * r * w AS r FROM r{k - 1} JOIN steps s ON r{k - 1}.host = s.src AND r{k - 1}.kind = s.kind
  UNION ALL SELECT host, kind, (1 - {DAMPING}) * r FROM r0) GROUP BY host, kind)""" for k in range(1, rounds + 1))
    return f"""
WITH parsed AS (
  SELECT page_id, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{ASCII_UPPER}', '{ASCII_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fitted AS (SELECT *, CASE {fits} END AS fit FROM parsed),
found AS (SELECT host, count(*) FILTER (fit.v = 'allow') AS good, count(*) FILTER (fit.v = 'block') AS bad FROM fitted WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)) AS u FROM fitted),
web AS (SELECT src, translate(regexp_extract(u, '^.*?://([^/?#]*)', 1), '{ASCII_UPPER}', '{ASCII_LOWER}') AS dst FROM links),
up AS (SELECT host AS src, regexp_extract(host, '^[^.]+\\.(.+\\..+)$', 1) AS dst FROM found WHERE regexp_matches(host, '^[^.]+\\.(.+\\..+)$')),
edges AS (SELECT src, dst, sum(n) AS n FROM (
  SELECT src, dst, 1.0 AS n FROM web WHERE src <> dst AND src <> '' AND dst <> ''
  UNION ALL SELECT *, 1.0 FROM (SELECT src, dst FROM up UNION SELECT dst, src FROM up)) GROUP BY src, dst),
ways AS (SELECT 't' AS kind, src, dst, n FROM edges UNION ALL SELECT 'd', dst, src, n FROM edges),
steps AS (SELECT kind, src, dst, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY kind, src) AS w FROM ways),
r0 AS (
  SELECT host, 't' AS kind, CAST(good AS DOUBLE) / (SELECT sum(good) FROM found) AS r FROM found WHERE good > 0
  UNION ALL SELECT host, 'd', CAST(bad AS DOUBLE) / (SELECT sum(bad) FROM found) FROM found WHERE bad > 0){steps},
ranks AS (SELECT host, coalesce(sum(r) FILTER (kind = 't'), 0) AS trust, coalesce(sum(r) FILTER (kind = 'd'), 0) AS distrust FROM r{rounds} GROUP BY host)
SELECT page_id, f.host, path, fit.r AS rule,
  coalesce(fit.v, CASE WHEN coalesce(distrust, 0) > {RATIO} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust
FROM fitted f LEFT JOIN ranks ON f.host = ranks.host
"""


@query("op4_url_filter", oracle())
def op4(spark, sf_dir):
    """Host, path, rule and verdict of every page URL, with the trust and distrust of its host."""
    done = judged(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "host", "path", "rule", "verdict", F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))
