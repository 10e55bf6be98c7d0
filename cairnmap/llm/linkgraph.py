"""URL filter: rules on host and path, then trust and distrust spread over host edges.

Pages that a rule allows or blocks seed their hosts. Trust runs along the links as a
personalised PageRank from allowed pages' hosts; distrust runs against the links from
blocked pages' hosts, for who links to bad hosts is suspect. Where no rule fits, the
host's two scores decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: The least rank of a host that seeds reach: a long way from them it would run under to zero.
LEAST = 2.0**-1022
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links of a page that name a host: absolute, or with the scheme left out.
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty when it is null or holds no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.coalesce(_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def with_rule(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rule and its verdict for columns host and path; the longest rule wins, null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return pages.withColumn("rule", text).withColumn("by_rule", verdict)


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted before anything else moves."""
    link = F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_HREF), F.lit(1)))
    target = F.regexp_replace(F.col("link"), "^(?i:https?:)?//", "x://")
    return pages.select("host", link.alias("link")).select(F.col("host").alias("src"), host_path(target)[0].alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-10) -> DataFrame:
    """(host, rank): personalised PageRank over edges (src, dst, n) from seeds (host, seed), seeds summing to one.

    Mass that reaches a host without links ends there. Ranks grow from the seeds until no
    new host is reached and none gains more than ``tolerance`` of its own rank in a round;
    a bound on the whole change would miss hosts far from every seed. Each round sums by
    host with map-side partial sums and is cut by a checkpoint, so a lost executor costs
    one round; one number a round goes to the driver.
    """
    if not 0 <= damping < 1:
        raise ValueError("damping must be in [0, 1)")
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    weight = checkpoint(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w")))
    base = seeds.select("host", (F.col("seed") * (1 - damping)).alias("rank"), F.lit(0.0).alias("old"))
    if damping == 0 or weight.isEmpty():
        return base.select("host", "rank")
    rank = base.select("host", "rank")
    while True:
        moved = weight.join(rank, weight["src"] == rank["host"]).groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("w") * F.col("rank")) * damping).alias("rank"), F.lit(0.0).alias("old"))
        held = rank.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("old"))
        both = base.unionByName(moved).unionByName(held).groupBy("host").agg(F.greatest(F.sum("rank"), F.lit(LEAST)).alias("rank"), F.sum("old").alias("old"))
        both = checkpoint(both)
        rank = both.select("host", "rank")
        gain = both.agg(F.max(F.abs(F.col("rank") - F.col("old")) / F.col("rank"))).first()[0]
        if gain is None or gain <= tolerance:
            return rank


def host_scores(judged: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-10) -> DataFrame:
    """(host, trust, distrust) from the rule verdicts of each host's pages and the links between hosts."""
    by_host = judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked"))
    by_host = checkpoint(by_host)
    total = by_host.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()

    def seeds(column: str, n: int | None) -> DataFrame:
        return by_host.where(F.col(column) > 0).select("host", (F.col(column) / F.lit(float(n or 1))).alias("seed"))

    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust = propagate(seeds("allowed", total["a"]), edges, damping, tolerance).withColumnRenamed("rank", "trust")
    distrust = propagate(seeds("blocked", total["b"]), back, damping, tolerance).withColumnRenamed("rank", "distrust")
    return trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = 0.85, tolerance: float = 1e-10, ratio: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: one row for each row of pages.

    Without a fitting rule a page is blocked when its host's distrust exceeds ``ratio``
    times its trust, else allowed; so is a url without host. Null html has no links,
    links to the own host are none. Repeated rows are judged each and seed each.
    """
    host, path = host_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    judged = with_rule(base, rules)
    edges = checkpoint(host_edges(base))
    scores = host_scores(judged.drop("html"), edges, damping, tolerance)
    by_method = F.when(F.col("distrust") > F.col("trust") * ratio * (1 + 1e-9), "block").otherwise("allow")
    out = judged.drop("html").join(scores, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method, F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("page_id", "host", "path", "rule", "verdict")


def oracle(rounds: int = 10, damping: float = 0.85) -> str:
    """DuckDB SQL for digest(judge(pages)), the rounds written out."""
    case_rule, case_verdict = "", ""
    for r in sorted(RULES, key=lambda r: (-len(r.text), -len(r.host))):
        cond = f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
        case_rule += f" when {cond} then '{r.text}'"
        case_verdict += f" when {cond} then '{r.verdict}'"
    href = r"""<a\s[^>]*?href\s*=\s*["'']?((?:https?:)?//[^"''\s>]+)"""
    low = f"translate(%s, '{_UPPER}', '{_LOWER}')"
    steps = []
    for name, src, dst, seed in (("t", "src", "dst", "allowed"), ("d", "dst", "src", "blocked")):
        steps.append(f"{name}w as (select {src} as s, {dst} as d, n / sum(n) over (partition by {src}) as w from e)")
        steps.append(f"{name}s as (select host, {seed} / (select greatest(sum({seed}), 1) from h)::double as seed from h where {seed} > 0)")
        steps.append(f"{name}0 as (select host, seed as rank from {name}s)")
        for k in range(rounds):
            steps.append(f"{name}{k + 1} as (select host, sum(rank) as rank from (select host, seed * {1 - damping} as rank from {name}s union all select d as host, w * rank * {damping} as rank from {name}w join {name}{k} on s = host) group by host)")
    return f"""
    with u as (select page_id, html, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    p as (select page_id, html, {low % "regexp_extract(rest, '^([^/?#]*)', 1)"} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
    j as (select page_id, host, path, case {case_rule} end as rule, case {case_verdict} end as by_rule from p),
    l as (select host as src, unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1, 'i')) as link from p),
    e0 as (select src, {low % "regexp_extract(link, '^(?:[a-zA-Z]+:)?//([^/?#]*)', 1)"} as dst from l),
    e as (select src, dst, count(*) as n from e0 where src <> dst and src <> '' and dst <> '' group by src, dst),
    h as (select host, count(*) filter (by_rule = 'allow') as allowed, count(*) filter (by_rule = 'block') as blocked from j where host <> '' group by host),
    {", ".join(steps)},
    s as (select host, coalesce(t.rank, 0) as trust, coalesce(d.rank, 0) as distrust from t{rounds} t full join d{rounds} d using (host))
    select page_id, j.host, path, rule, coalesce(by_rule, case when distrust > trust * (1 + 1e-9) then 'block' else 'allow' end) as verdict
    from j left join s on j.host = s.host"""
