"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidates; the value of each is hashed; hashes are aggregated over the
corpus by distinct repositories and owners. A value that many owners share is a copied
example, one that stays with few owners looks like a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh

# The kinds in their order, with the pattern, the group that holds the
# value and the least length of that group. Only ASCII letters fold under (?i).
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("provider", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
]
#: The first three are the base spans; what follows is added to them.
N_BASE = 3
#: Matches that are gathered at a time within one text.
GROUP = 500


def _longest(pattern: str, least: int) -> str:
    """The pattern with its last + asking for the least length: a match of it exists wherever a long enough one does."""
    return pattern if least <= 1 else pattern[: pattern.rindex("+")] + f"{{{least - 4 if 'AKIA' in pattern else least},}}" + pattern[pattern.rindex("+") + 1 :]


def _spans(text: Column, k: int) -> Column:
    """The spans of one kind: matches, and the pieces between them, give the offsets in code points."""
    name, pattern, group, least = KINDS[k]
    quick = _longest(pattern, least)
    if name in ("access", "hex"):  # a maximal run: asking for the length while matching gives the same runs
        pattern = quick
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<kind:int,start:int,end:int,value:string>>)")
    zipped = F.arrays_zip(whole.alias("m"), value.alias("v"), F.slice(pieces, 1, F.size(whole)).alias("p"))
    zipped = zipped.cast("array<struct<m:string,v:string,p:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.length(x["m"])
        span = F.struct(F.lit(k).alias("kind"), begin.alias("start"), end.alias("end"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def move(acc: Column, part: Column) -> Column:
        spans = F.transform(part["out"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(spans)).alias("out"))

    # Appending copies the array, so matches are gathered by groups, for texts with very many.
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / GROUP).cast("int")), lambda g: F.aggregate(F.slice(zipped, g * GROUP + 1, GROUP), start, step))
    nested = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<kind:int,start:int,end:int,value:string>>>)").alias("out"))
    found = F.flatten(F.aggregate(groups, nested, move, lambda acc: acc["out"]))
    return F.when(text.rlike(quick), found).otherwise(empty)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """One row per row of docs: row, doc_id, owner, repo and its spans by start, then kind.

    Null text is empty; without repo_col the document itself counts as the repository.
    ``copy`` is a digest of the text where there are spans.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        (F.col(owner_col) if owner_col in docs.columns else F.lit(None)).cast("string").alias("owner"),
        F.col(repo_col or id_col).cast("string").alias("repo"),
        F.concat(*[_spans(text, k) for k in range(len(KINDS))]).alias("found"),
        text.alias("text"),
    )
    order = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.when(F.length(s["value"]) > 0, F.sha2(s["value"], 256)).alias("hash"))))
    return found.select("row", "doc_id", "owner", "repo", order.alias("spans"), F.when(F.size("found") > 0, F.sha2("text", 256)).alias("copy"))


def ownership(found: DataFrame, example_owners: int = 3, example_repos: int = 10) -> DataFrame:
    """(hash, n_spans, n_repos, n_owners, live) over all spans.

    A value is live-looking while fewer than ``example_owners`` owners and fewer than
    ``example_repos`` repositories hold it; where owners are unknown, repositories decide.

    Distinct counts go through (hash, owner, repo), then (hash, owner): a value that a
    third of all rows holds is pre-aggregated by each task and never meets in one task.
    """
    spans = found.select("owner", "repo", F.explode("spans.hash").alias("hash"))
    pairs = spans.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    total = owners.groupBy("hash").agg(F.sum("n").alias("n_spans"), F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))
    return total.withColumn("live", (F.col("n_owners") < example_owners) & (F.col("n_repos") < example_repos))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, example_owners: int = 3, example_repos: int = 10) -> DataFrame:
    """Secret spans of each document and what the corpus says of their values.

    Returns one row per row of docs: row, doc_id, spans (array of start, kind, end, hash;
    kind is an index into KINDS), copy, n_live, n_example and live (the spans whose value
    few owners and few repositories hold, see ownership()). Null or empty text: no spans.
    Repeated rows count as one repository. A null owner counts as one owner, a null
    repository or id as one repository; no owner column means one owner for all.
    """
    found = checkpoint(find(docs, id_col, text_col, owner_col, repo_col))
    total = ownership(found, example_owners, example_repos).select("hash", "live")
    each = found.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s"))
    judged = each.withColumn("hash", F.col("s.hash")).join(total, "hash", "left")
    per = judged.groupBy("row").agg(
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_example"),
        F.array_sort(F.collect_list(F.when(F.col("live"), F.struct("s.start", "s.kind", "s.end")))).alias("live"),
    )
    return found.join(per, "row", "left").select(
        "row", "doc_id", "spans", "copy", F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"), F.coalesce("live", F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")).alias("live")
    )


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from scan()."""
    base = F.filter("spans", lambda s: s["kind"] < N_BASE)

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_live", "n_example")


#: Shares that equal texts are dealt over where verdicts meet them.
SALTS = 16


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with each live-looking span replaced by <secret>; copied examples stay, no row goes.

    What is live in a text follows from the text and the corpus alone, so verdicts meet
    the rows by a digest of the text: repeated and null ids are judged like any other. A
    null text stays null. Columns of any name pass through.
    """
    key, salt, live = fresh(docs, "copy", "salt", "live")
    of_text = scan(docs, id_col, text_col, **options).where("n_live > 0").groupBy("copy").agg(F.first("live").alias(live))  # equal texts have equal spans
    of_text = of_text.select(F.col("copy").alias(key), live, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    text = F.col(text_col).cast("string")
    acc = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        covered = s["end"] <= a["at"]
        kept = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        joined = F.when(s["start"] >= a["at"], F.concat(a["out"], kept, F.lit("<secret>"))).otherwise(a["out"])
        return F.struct(F.when(covered, a["at"]).otherwise(s["end"]).alias("at"), F.when(covered, a["out"]).otherwise(joined).alias("out"))

    clean = F.aggregate(F.array_sort(F.col(live)), acc, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    dealt = docs.withColumn(key, F.sha2(text, 256)).withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
    out = dealt.join(of_text, [key, salt], "left").withColumn(text_col, F.when(F.col(live).isNull() | text.isNull(), F.col(text_col)).otherwise(clean))
    return out.select(*docs.columns)


def oracle(n_kinds: int = N_BASE) -> str:
    """DuckDB SQL for digest(scan(documents)); lists stand in for arrays."""
    names = [k[0] for k in KINDS]
    parts = []
    for k, (name, pattern, group, least) in enumerate(KINDS):
        q = pattern.replace("'", "''")
        parts.append(f"""
        select doc_id, source, {k} as kind, '{name}' as name, unnest(w) as m, unnest(v) as v, unnest(p[1:len(w)]) as p, generate_subscripts(w, 1) as i from (
          select doc_id, source, regexp_extract_all(text, '{q}') as w, regexp_extract_all(text, '{q}', {group}) as v, string_split_regex(text, '{q}') as p from t)""")
    least = " ".join(f"when {k} then {x[3]}" for k, x in enumerate(KINDS))
    return f"""
    with t as (select doc_id, source, coalesce(text, '') as text from documents),
    m as ({" union all ".join(parts)}),
    s as (select *, sum(length(p) + length(m)) over (partition by doc_id, kind order by i) as stop from m),
    k as (select doc_id, source, kind, name, (stop - length(m))::bigint as start, stop::bigint as stop, sha256(v) as h, name || ':' || (stop - length(m))::bigint || ':' || stop::bigint as txt
          from s where length(v) >= case kind {least} end),
    o as (select h, count(distinct coalesce(source, '')) < 3 and count(distinct coalesce(doc_id, -1)) < 10 as live from k group by h),
    d as (select doc_id,
            count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
            string_agg(txt, ',' order by start, kind) filter (kind < {N_BASE}) as base, string_agg(txt, ',' order by start, kind) as spans,
            count(*) filter (live) as n_live, count(*) filter (not live) as n_example
          from k join o using (h) group by doc_id)
    select t.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
           sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0)::bigint as n_live, coalesce(n_example, 0)::bigint as n_example
    from t left join d on t.doc_id = d.doc_id"""  # names keeps the order of KINDS: {names}
