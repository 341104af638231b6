"""URL filters: fixed rules first, then link-graph propagation.

Rules name a host and the beginning of a path; a rule fits its host and all subdomains; the longest wins.
For pages that no rule judges, hosts are judged by their links: personalised PageRank spreads trust along
host edges from hosts with allowed pages, and distrust against the edges from hosts with blocked
pages (who links to blocked hosts is suspect). A host is blocked when its distrust is over THRESHOLD of both.

All steps are DataFrame operations. Edges are counted per (from, to) before ranks move, so a hot host is
a row for each neighbour; ranks are tables in the shared folder every CUT rounds. Rounds go on until, over CUT of
them, no rank of a host moved by more than SETTLED of itself: hosts far from any seed are reached however many hops that
takes. What hosts without edges out hold is lost; giving it back to the seeds would raise all ranks of a kind alike.
A host is judged by its distrust as a part of its trust and distrust, so neither the number of pages nor
small ranks change verdicts.

Defined results: a null URL or one without `://` has empty host and path, fits no rule and is allowed;
without seeds or links trust and distrust are 0 and the host is allowed; repeated page ids are
judged one by one; null html has no links; html of any length is read whole; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import removed, written

DAMPING, CUT, THRESHOLD = 0.85, 4, 0.5
#: Ranks that move by no more than this part of themselves in CUT rounds are settled; verdicts look at so many places.
SETTLED, PLACES = 1e-6, 4
#: Rounds of the SQL, which cannot tell when to end: 0.85 ** 64 of the weight, 3e-5, has not settled.
SQL_ROUNDS = 64


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From behind the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule) -> Column:
    return ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)


def ruled(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, by_rule (verdict of the longest rule that fits, else null) and html."""
    chosen, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        chosen, verdict = F.when(fits(r), r.name).otherwise(chosen), F.when(fits(r), r.verdict).otherwise(verdict)
    parted = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    return parted.select("page_id", "host", "path", chosen.alias("rule"), verdict.alias("by_rule"), "html")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, links: links of the pages of a host to each host, its own included. pages: host, html."""
    href = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(href).alias("to"))
    far = F.when(F.col("to").startswith("//"), host_of(F.concat(F.lit("http:"), F.col("to")))).when(F.col("to").rlike(r"(?i)^https?://"), host_of(F.col("to")))
    near = F.when(~F.col("to").rlike(r"(?i)^[a-z][a-z0-9+.-]*:") & ~F.col("to").startswith("#"), F.col("src"))
    return links.select("src", F.coalesce(far, near).alias("dst")).where("dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagated(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, host, rank: personalised PageRank of each kind, from seeds (kind, host, weight) along
    edges (kind, src, dst, share), until it has settled."""
    begin = seeds.select("kind", "host", (F.col("weight") * (1 - DAMPING)).alias("rank"))
    old = seeds.select("kind", "host", F.col("weight").alias("rank"))
    while True:
        ranks = old
        for _ in range(CUT):
            moved = edges.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * DAMPING).alias("rank"))
            ranks = moved.union(begin).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        ranks = written(ranks, "ranks")
        both = ranks.join(old.withColumnRenamed("rank", "was"), ["kind", "host"], "left")
        if both.where(F.abs(F.col("rank") - F.coalesce("was", F.lit(0.0))) > F.col("rank") * SETTLED).isEmpty():
            return ranks
        if hasattr(old, "_written"):
            removed(old)
        old = ranks


def _shares(edges: DataFrame, kind: str, begin: str, end: str) -> DataFrame:
    """kind, src, dst, share: edges from `begin` to `end`, with their part of all links of `begin`."""
    total = edges.groupBy(begin).agg(F.sum("links").alias("all_links"))
    return edges.join(total, begin).select(F.lit(kind).alias("kind"), F.col(begin).alias("src"), F.col(end).alias("dst"), (F.col("links") / F.col("all_links")).alias("share"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust (of the host), a row for each row."""
    known = ruled(pages, rules)
    hosts = written(known.where("host <> ''").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked")), "hosts")
    edges = written(host_edges(known), "edges")

    # Weights of both kinds have one scale, so that trust and distrust can be held against each other.
    total = float(hosts.agg(F.sum(F.col("allowed") + F.col("blocked"))).first()[0] or 1)
    seeds = [hosts.where(F.col(c) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(c) / F.lit(total)).alias("weight")) for kind, c in (("trust", "allowed"), ("distrust", "blocked"))]
    shares = written(_shares(edges, "trust", "src", "dst").union(_shares(edges, "distrust", "dst", "src")), "shares")
    ranks = propagated(seeds[0].union(seeds[1]), shares)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    scored = written(ranks.groupBy("host").agg(of("trust"), of("distrust")), "scored")
    # Rounded, so that equal sums added up in another order stay equal. Null, without ranks, is not bad.
    bad = F.round(F.col("distrust") / F.nullif(F.col("trust") + F.col("distrust"), F.lit(0.0)), PLACES) > THRESHOLD
    return known.drop("html").join(scored, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the result without trust and distrust: the same where ranks settle within SQL_ROUNDS rounds."""
    ordered = sorted(rules, key=lambda r: -len(r.name))
    fit = lambda r: f"((host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}'))"
    case = lambda f: "CASE " + " ".join(f"WHEN {fit(r)} THEN '{f(r)}'" for r in ordered) + " END"
    host = lambda x: f"coalesce(translate(regexp_extract({x}, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}'), '')"
    rounds = "".join(
        f""", r{k} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (SELECT e.kind, e.dst AS host, r.rank * e.share * {DAMPING} AS rank FROM edges e JOIN r{k - 1} r ON e.kind = r.kind AND e.src = r.host
        UNION ALL SELECT kind, host, weight * (1 - {DAMPING}) FROM seeds) GROUP BY kind, host)"""
        for k in range(1, SQL_ROUNDS + 1)
    )
    return f"""
    WITH parted AS (SELECT page_id, {host("url")} AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, html FROM pages),
    known AS (SELECT *, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS by_rule FROM parted),
    hosts AS (SELECT host, count(*) FILTER (by_rule = 'allow') AS allowed, count(*) FILTER (by_rule = 'block') AS blocked FROM known WHERE host <> '' GROUP BY host),
    total AS (SELECT greatest(sum(allowed + blocked), 1)::DOUBLE AS n FROM hosts),
    seeds AS MATERIALIZED (SELECT 'trust' AS kind, host, allowed / n AS weight FROM hosts, total WHERE allowed > 0 UNION ALL SELECT 'distrust', host, blocked / n FROM hosts, total WHERE blocked > 0),
    refs AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '<a\\s[^>]*?href\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'i')) AS dest FROM known WHERE host <> ''),
    links AS (SELECT src, CASE WHEN starts_with(dest, '//') THEN {host("'http:' || dest")} WHEN regexp_matches(dest, '^https?://', 'i') THEN {host("dest")}
        WHEN NOT regexp_matches(dest, '^[a-z][a-z0-9+.-]*:', 'i') AND NOT starts_with(dest, '#') THEN src END AS dst FROM refs),
    counted AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM links WHERE dst <> '' GROUP BY src, dst),
    edges AS MATERIALIZED (SELECT 'trust' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM counted UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM counted),
    r0 AS (SELECT kind, host, weight AS rank FROM seeds){rounds},
    scored AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust FROM r{SQL_ROUNDS} GROUP BY host)
    SELECT page_id, k.host AS host, path, rule, coalesce(by_rule, CASE WHEN round(distrust / nullif(trust + distrust, 0), {PLACES}) > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
    FROM known k LEFT JOIN scored s ON k.host = s.host"""
