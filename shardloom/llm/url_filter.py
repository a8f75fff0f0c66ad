"""URL filter: rules by host and path; trust and distrust propagated over host links.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, table, written


@dataclass(frozen=True)
class Rule:
    """Holds for a host and all its subdomains, where the path starts with path."""

    host: str
    path: str
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a url; both empty without a scheme mark."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    has = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, F.translate(host, upper, lower)).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does; of equals the first."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.text), -rules.index(r))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, w: the links with a host (scheme://host or //host) between different hosts, each page's link to a host once."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)\bhref\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), F.lit(1))
    links = F.transform(links, lambda u: F.when(u.startswith("//"), F.concat(F.lit("x:"), u)).otherwise(u))
    each = pages.where("instr(html, '//') > 0").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(links, lambda u: host_and_path(u)[0]))).alias("dst"))
    return each.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def propagate(links: DataFrame, seeds: DataFrame, *, damping: float = 0.85, rounds: int = 12, tolerance: float = 1e-9) -> DataFrame:
    """host, trust, distrust: personalised PageRank from seeds (host, trusted, blocked masses).

    Trust flows along the links, distrust against them; both walks are one join a round, their
    lineage is cut by a table every fourth round. They go on, for `rounds` rounds at least, until
    four rounds reach no new host and change the masses (of one in all, each walk) by less than
    the tolerance in sum; with damping below one that comes for any graph. The mass that dangling
    hosts lose stays lost (scores compare hosts, they need not sum to one).
    """
    if not 0 <= damping < 1:
        raise ValueError("damping must be at least 0 and below 1")
    s = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()
    kind = lambda name, total: seeds.where(f"{name} > 0").select("host", F.lit(name).alias("kind"), (F.col(name) / F.lit(total or 1.0)).alias("mass"))
    start = written(kind("trusted", s["t"]).union(kind("blocked", s["b"])), "seeds")
    both = links.select(F.lit("trusted").alias("kind"), "src", "dst", "w").union(links.select(F.lit("blocked"), F.col("dst"), F.col("src"), "w"))
    out = both.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    edge = written(both.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("w") / F.col("all")).alias("share")), "edges")
    rank = start
    if not edge.isEmpty():
        done, settled = 0, False
        while not settled or done < rounds:
            last = rank
            for _ in range(4):
                flow = edge.join(rank, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg((damping * F.sum(F.col("share") * F.col("mass"))).alias("mass"))
                seed = start.select("kind", "host", ((1 - damping) * F.col("mass")).alias("mass"))
                rank = flow.union(seed).groupBy("kind", "host").agg(F.sum("mass").alias("mass")).select("host", "kind", "mass")
            done += 4
            rank = written(rank, "rank")
            change = rank.select("host", "kind", "mass", F.lit(1).alias("new")).union(last.select("host", "kind", -F.col("mass"), F.lit(-1)))
            moved = change.groupBy("host", "kind").agg(F.abs(F.sum("mass")).alias("mass"), F.sum("new").alias("new")).agg(F.sum("mass").alias("mass"), F.max("new").alias("new")).first()
            settled = moved["mass"] is None or (moved["mass"] < tolerance and moved["new"] <= 0)
            if last is not start:
                drop_written(last)
    of = lambda name: F.sum(F.when(F.col("kind") == name, F.col("mass")).otherwise(0.0))
    return rank.groupBy("host").agg(of("trusted").alias("trust"), of("blocked").alias("distrust"))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, damping: float = 0.85, rounds: int = 12, margin: float = 1.0, tolerance: float = 1e-9) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each page.

    The longest fitting rule decides. Pages without a rule get their host's verdict: a host
    whose pages the rules allow is a trusted seed, one whose pages they block a blocked seed
    (masses: the shares of its pages); trust is the personalised PageRank of a host over the
    link graph, distrust that over the reversed graph. Each is scaled by its mean over the
    hosts; a host is blocked if distrust exceeds margin times trust. Hosts that neither walk
    reaches, and urls without a host, are allowed.

    pages needs page_id, url, html; other columns are ignored. Null html has no links, a null url
    no host. Urls and pages of any length are read whole. Repeated rows are judged alike, their
    links count once each. An empty table gives no rows. Hosts, links and scores stay distributed.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    base = base.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.when(F.col("r.verdict") == v, 1.0).otherwise(0.0))
    seeds = written(base.where("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked")), "hosts")
    links = written(host_links(pages.select("html", host.alias("host"))), "links")
    score = written(propagate(links, seeds, damping=damping, rounds=rounds, tolerance=tolerance), "scores")
    mean = score.agg(F.avg("trust").alias("t"), F.avg("distrust").alias("d")).first()
    scaled = score.select("host", (F.col("trust") / F.lit(mean["t"] or 1.0)).alias("trust"), (F.col("distrust") / F.lit(mean["d"] or 1.0)).alias("distrust"))
    scaled = written(scaled, "scaled")
    drop_written(score)
    by_host = F.when(F.col("distrust") > margin * F.col("trust"), "block").otherwise("allow")
    verdict = F.coalesce("r.verdict", by_host)
    return base.join(scaled, "host", "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "pages"))
    return out.withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 9) for c in ("trust", "distrust")})


# Ranks as sums of the walk's powers: rounds of one join each, cut where 0.85 ** 150 of the mass is left.
OP1_SQL = r"""
with recursive p as (
  select page_id, html, case when contains(url, '://') then regexp_replace(url, '^.*?://', '', 's') end as rest from pages),
h as (
  select page_id, html, translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') as path from p),
rules(rh, rp, rv) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best as (
  select page_id, host, path, rh || rp as rule, rv,
    row_number() over (partition by page_id, host, path order by length(rh || rp) desc nulls last) as k
  from h left join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)),
seed as (
  select host, avg(case when rv = 'allow' then 1.0 else 0.0 end) as t, avg(case when rv = 'block' then 1.0 else 0.0 end) as b
  from best where k = 1 and host <> '' group by host),
start as (
  select 't' as kind, host, cast(t as double) / (select sum(t) from seed) as mass from seed where t > 0
  union all select 'b', host, cast(b as double) / (select sum(b) from seed) from seed where b > 0),
page_link as (
  select host as src, unnest(list_distinct(list_transform(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1),
    lambda u: translate(regexp_extract(regexp_replace(u, '^[^/]*//', ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) as dst
  from h where html is not null),
link as (select src, dst, cast(count(*) as double) as w from page_link where src <> '' and dst <> '' and src <> dst group by src, dst),
step as (
  select 't' as kind, src as s, dst as d, w / sum(w) over (partition by src) as share from link
  union all select 'b', dst, src, w / sum(w) over (partition by dst) from link),
walk(i, kind, host, mass) as (
  select 0, kind, host, mass from start
  union all select i + 1, walk.kind, d, sum(share * mass) from walk join step on walk.kind = step.kind and walk.host = step.s where i < 150 group by i, walk.kind, d),
ranked as (
  select host, sum(case when kind = 't' then part else 0 end) as t, sum(case when kind = 'b' then part else 0 end) as b
  from (select kind, host, case when i < 150 then 0.15 else 1 end * power(0.85, i) * mass as part from walk) group by host),
scaled as (select host, t / coalesce(nullif((select avg(t) from ranked), 0), 1) as t, b / coalesce(nullif((select avg(b) from ranked), 0), 1) as b from ranked)
select page_id, best.host, path, rule, coalesce(rv, case when b > t then 'block' else 'allow' end) as verdict,
  round(coalesce(t, 0), 9) as trust, round(coalesce(b, 0), 9) as distrust
from best left join scaled using (host) where k = 1
"""
