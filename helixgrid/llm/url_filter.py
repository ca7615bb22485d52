"""URL filters: rules first, and for the rest a verdict of the link graph over hosts.

Rules name a host with its subdomains and a path prefix; the longest that fits judges the url. The host graph has an
edge for the links from pages of one host to another, weighted by their number. Trust is a personalised PageRank from
the hosts that rules mostly allow, along the links; distrust one from the hosts that rules mostly block, along the
reversed links. A host is blocked where distrust is more than `threshold` parts of trust and distrust together,
however small they are; a host that no seed reaches is allowed. Ranks are iterated until all changes of five steps
together are below one seed's mass divided by `TOLERANCE`.

Both ranks run in one loop over (direction, host) and in whole numbers, so results don't depend on the order of sums.
Per step there is one join of ranks to edges and one sum per host; all links between two hosts are one edge, summed
before the shuffle, and the graph is read from the shared checkpoint folder. No Python runs on the executors.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed; a null html
has no links; repeated rows and page ids are judged each; other columns are dropped; empty tables give empty tables.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixgrid.llm.session import cut

#: (verdict, host and path prefix): fixed values of the query's contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MASS = 10**12
DAMPING = 85  # of a hundred
#: Parts of a part of MASS that ranks are counted in; steps go on until five move less than a seed's mass / TOLERANCE.
FINE = 10**12
TOLERANCE = 10**6
PARTS = "decimal(26,0)"
THRESHOLD = 50  # of a hundred
#: Steps after which the SQL text ends; enough for 100 million seeds, since each step moves 85 % of the last one's mass at most.
STEPS = 200
HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*([^"'\s>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; empty without one."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null. The list is a parameter that the plan holds."""
    fits = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        here = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        fits.append(F.when(here, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def host_edges(pages: DataFrame, host: Column, html_col: str) -> DataFrame:
    """src, dst, links: links to other hosts, summed."""
    found = pages.select(host.alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(HREF), F.lit(1)))).alias("to"))
    absolute = found.filter(F.col("to").rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"))
    dst = url_host(F.when(F.startswith("to", F.lit("//")), F.concat(F.lit("x:"), "to")).otherwise(F.col("to")))
    pairs = absolute.select("src", dst.alias("dst")).filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: int = DAMPING) -> DataFrame:
    """edges: src, dst, links; seeds: host, trusted (boolean). Returns host, trust, distrust (parts of MASS * FINE, as decimals)."""
    spread = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.lit(1).alias("way"), F.col("dst").alias("a"), F.col("src").alias("b"))))
    both = edges.select(spread.alias("e"), "links").select("e.way", "e.a", "e.b", "links")
    out = both.groupBy("way", "a").agg(F.sum("links").alias("all_links"))
    graph = cut(both.join(out, ["way", "a"]))
    start = seeds.select(F.when(F.col("trusted"), 0).otherwise(1).alias("way"), "host")
    counts = start.groupBy("way").agg(F.count(F.lit(1)).alias("n"))
    base = cut(start.join(F.broadcast(counts), "way").select("way", "host", F.expr(f"{MASS} div n").alias("seed")))  # two rows
    fine = F.lit(FINE).cast("decimal(13,0)")
    kept = base.select("way", "host", (F.expr(f"{100 - damping} * seed div 100").cast("decimal(13,0)") * fine).cast(PARTS).alias("mass"))
    rank = base.select("way", "host", (F.col("seed").cast("decimal(13,0)") * fine).cast(PARTS).alias("mass"))
    least = base.agg(F.min("seed")).first()[0]
    done = least is None
    while not done:
        last = rank
        for _ in range(5):
            share = F.floor(F.col("mass") * damping / 100).cast("decimal(26,0)") * F.col("links").cast("decimal(11,0)")
            sent = graph.alias("g").join(rank.alias("r"), F.expr("g.way = r.way and g.a = r.host")).select("g.way", F.col("g.b").alias("host"), F.floor(share / F.col("all_links").cast("decimal(11,0)")).cast(PARTS).alias("mass"))
            rank = sent.unionByName(kept).groupBy("way", "host").agg(F.sum("mass").cast(PARTS).alias("mass"))
        rank = cut(rank)
        moved = last.select("way", "host", (-F.col("mass")).alias("mass")).unionByName(rank).groupBy("way", "host").agg(F.abs(F.sum("mass")).alias("moved"))
        done = (moved.agg(F.sum("moved")).first()[0] or 0) * TOLERANCE < least * FINE
    part = lambda way: F.sum(F.when(F.col("way") == way, F.col("mass")).otherwise(F.lit(0).cast(PARTS)))
    return rank.groupBy("host").agg(part(0).alias("trust"), part(1).alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, damping: int = DAMPING, threshold: int = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns: id_col, host, path, rule, verdict, trust, distrust."""
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules)).select("id", "host", "path", "fit.rule", F.col("fit.verdict").alias("ruled"))
    votes = judged.filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    seeds = votes.filter("2 * blocked > n or 2 * allowed > n").select("host", F.expr("2 * allowed > n").alias("trusted"))
    ranks = propagate(host_edges(pages, host, html_col), seeds, damping)
    by_method = F.when(F.col("distrust") * 100 > (F.col("trust") + F.col("distrust")) * threshold, "block").otherwise("allow")
    out = judged.join(ranks, "host", "left").select("id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), *[F.coalesce(F.floor(F.col(c) / FINE).cast("long"), F.lit(0)).alias(c) for c in ("trust", "distrust")])
    return out.withColumnRenamed("id", id_col)


def oracle(rules: Sequence[tuple[str, str]] = RULES, steps: int = STEPS, damping: int = DAMPING, threshold: int = THRESHOLD) -> str:
    """DuckDB over the view `pages`. Every fifth step's ranks are compared with those five steps before; the first that moved little enough count."""
    low = lambda x: f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    values = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in rules)
    quoted = HREF.replace("'", "''")
    ctes = [
        f"rules(verdict, rule, rhost, rpath) AS (VALUES {values})",
        f"p AS MATERIALIZED (SELECT row_number() OVER () AS rid, page_id, coalesce({low("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(html, '') AS html FROM pages)",
        "fit AS (SELECT rid, arg_max(rule, (length(rule), rule)) AS rule, arg_max(verdict, (length(rule), rule)) AS ruled FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid)",
        "judged AS MATERIALIZED (SELECT p.rid, page_id, host, path, rule, ruled FROM p LEFT JOIN fit USING (rid))",
        "votes AS (SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM judged WHERE host <> '' GROUP BY host)",
        "start AS (SELECT CASE WHEN 2 * a > n THEN 0 ELSE 1 END AS way, host FROM votes WHERE 2 * a > n OR 2 * b > n)",
        f"base AS MATERIALIZED (SELECT way, host, {MASS} // count(*) OVER (PARTITION BY way) AS seed FROM start)",
        f"links AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '{quoted}', 1))) AS dst FROM p)",
        f"edges AS (SELECT src, dst, count(*) AS links FROM (SELECT src, {low("regexp_extract(CASE WHEN starts_with(dst, '//') THEN 'x:' || dst ELSE dst END, '(?s)^.*?://([^/?#]*)', 1)")} AS dst FROM links WHERE regexp_matches(dst, '^([A-Za-z][A-Za-z0-9+.-]*:)?//')) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst)",
        "both_ways AS (SELECT 0 AS way, src AS a, dst AS b, links FROM edges UNION ALL SELECT 1, dst, src, links FROM edges)",
        "graph AS MATERIALIZED (SELECT *, CAST(sum(links) OVER (PARTITION BY way, a) AS HUGEINT) AS all_links FROM both_ways)",
        f"kept AS MATERIALIZED (SELECT way, host, CAST({100 - damping} * seed // 100 AS HUGEINT) * {FINE} AS mass FROM base)",
        f"r0 AS MATERIALIZED (SELECT way, host, CAST(seed AS HUGEINT) * {FINE} AS mass FROM base)",
    ]
    stops = []
    for k in range(1, steps + 1):
        ctes.append(f"r{k} AS MATERIALIZED (SELECT way, host, CAST(sum(mass) AS HUGEINT) AS mass FROM (SELECT g.way, g.b AS host, ({damping} * mass // 100) * links // all_links AS mass FROM graph g JOIN r{k - 1} r ON g.way = r.way AND g.a = r.host UNION ALL SELECT way, host, mass FROM kept) GROUP BY way, host)")
        if k % 5 == 0:
            stops.append(f"SELECT {k} AS k, sum(moved) AS moved FROM (SELECT abs(sum(mass)) AS moved FROM (SELECT way, host, -mass AS mass FROM r{k - 5} UNION ALL SELECT way, host, mass FROM r{k}) GROUP BY way, host)")
    ctes.append(f"stop AS MATERIALIZED (SELECT min(k) AS k FROM ({' UNION ALL '.join(stops)}) WHERE moved * {TOLERANCE} < (SELECT CAST(min(seed) AS HUGEINT) * {FINE} FROM base))")
    ctes.append("last AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT way, host, mass FROM r{k}, stop WHERE stop.k = {k}" for k in range(5, steps + 1, 5)) + ")")
    ctes.append("ranks AS (SELECT host, CAST(sum(CASE WHEN way = 0 THEN mass ELSE 0 END) AS HUGEINT) AS trust, CAST(sum(CASE WHEN way = 1 THEN mass ELSE 0 END) AS HUGEINT) AS distrust FROM last GROUP BY host)")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN distrust * 100 > (trust + distrust) * {threshold} THEN 'block' ELSE 'allow' END) AS verdict, CAST(coalesce(trust // {FINE}, 0) AS BIGINT) AS trust, CAST(coalesce(distrust // {FINE}, 0) AS BIGINT) AS distrust FROM judged j LEFT JOIN ranks r ON j.host = r.host"
