"""URL filter: allow and block rules, and link-graph propagation where no rule fits.

Rules fit a host and its subdomains by path prefix; the longest wins (of equal
ones a block rule, then the smaller string).  Hosts get two seeds from them,
the shares of their pages that rules allow and block.  Over the host graph of
the pages' links, trust flows from allowed hosts along links and distrust from
blocked hosts against them - a host that links to blocked hosts is suspect -
as personalised PageRank (seed + damping * what neighbours pass on, each split
over its links).  A page without a rule is blocked if its host's distrust
reaches the threshold and exceeds its trust, else allowed.

Links are the href of a elements outside comments, scripts and styles, with
character references for letters of the address decoded; relative ones
belong to the host of the page's base element, or of the page itself.  A page
counts once for each host it links to; links inside a host are no endorsement
and are left out.  Edges and ranks are aggregated before every shuffle and
joined by shuffle joins that Spark can split, so a host may hold any share of
pages or links.  Ranks are written to the shared folder every few rounds; the
iteration ends when none changes by more than TOLERANCE, and raises an error
if that takes more than ROUNDS.

Defined cases: null urls and urls without :// have an empty host and path, no
rule, no links and the verdict allow; null html has no links; repeated rows
are pages of their own; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm.tables import bounded, saved

DAMPING, THRESHOLD, TOLERANCE, ROUNDS, STEP = 0.85, 0.5, 1e-4, 120, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*([^"'\s>]+)"""
_BASE = r"""(?i)<base\s(?:[^>]*?\s)?href\s*=\s*["']?\s*([^"'\s>]+)"""
#: Parts of a page whose links are none.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
#: Character references of the characters that part an address: pattern and character.
_REFERENCES = ((r"(?i)&(?:sol|#0*47|#x0*2f);", "/"), (r"(?i)&(?:colon|#0*58|#x0*3a);", ":"), (r"(?i)&(?:period|#0*46|#x0*2e);", "."), (r"(?i)&(?:quest|#0*63|#x0*3f);", "?"), (r"(?i)&(?:num|#0*35|#x0*23);", "#"), (r"(?i)&(?:amp|#0*38|#x0*26);", "&"))
#: An absolute address, or one that may be absolute once decoded: only pages that have one are decoded.
_MAYBE = r"""(?i)href\s*=\s*["']?\s*(?://|[a-z][a-z0-9+.-]*://|[a-z0-9+./:-]*&(?:sol|colon|period|#))"""


def host_of(url: Column) -> Column:
    """The host, A-Z lower-cased; empty without ://."""
    found = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1))
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """The path up to a query or fragment; empty without ://."""
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null. rules: ("allow" or "block", "host/path")."""
    order = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(order):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _decoded(html: Column) -> Column:
    out = html
    for pattern, char in _REFERENCES:
        out = F.regexp_replace(out, pattern, char)
    return F.when(F.contains(html, F.lit("&")), out).otherwise(html)


def _absolute(link: Column) -> Column:
    return link.startswith("//") | link.rlike(r"(?i)^[a-z][a-z0-9+.-]*://")


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, pages): how many pages of src link to the other host dst."""
    full = lambda x: F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x)
    # most links stay inside their host and name none: pages without others are dropped before their links are listed
    some = pages.where(F.col(html).rlike(_MAYBE))
    seen = some.select(host_of(F.col(url)).alias("src"), _decoded(F.col(html)).alias("_seen")).where("src <> ''").where(F.col("_seen").rlike("""(?i)href\\s*=\\s*["']?\\s*(//|[a-z][a-z0-9+.-]*://)"""))
    seen = seen.withColumn("_seen", F.regexp_replace("_seen", _HIDDEN, " "))
    base = F.regexp_extract("_seen", _BASE, 1)
    home = F.when(_absolute(base), host_of(full(base))).otherwise(F.col("src"))
    links = F.regexp_extract_all(F.col("_seen"), F.lit(_HREF), F.lit(1))
    # an address of another scheme without a host (mailto:) leads nowhere
    to = F.transform(links, lambda x: F.when(_absolute(x), host_of(full(x))).when(x.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit("")).otherwise(home))
    each = seen.select("src", F.explode(F.array_distinct(to)).alias("dst")).where("dst <> '' and dst <> src")
    return each.groupBy("src", "dst").agg(F.count("*").alias("pages"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of all seeds and hosts that rank reaches. seeds: (host, trust, distrust)."""
    start = saved(seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "rank")).where("rank > 0"))
    edges = saved(edges)
    if edges.limit(1).count():
        outs = edges.groupBy("src").agg(F.sum("pages").alias("total"))
        ins = edges.groupBy("dst").agg(F.sum("pages").alias("total"))
        ahead = edges.join(outs, "src").select(F.col("src").alias("host"), F.lit("trust").alias("kind"), F.col("dst").alias("to"), (F.col("pages") / F.col("total") * damping).alias("share"))
        back = edges.join(ins, "dst").select(F.col("dst").alias("host"), F.lit("distrust").alias("kind"), F.col("src").alias("to"), (F.col("pages") / F.col("total") * damping).alias("share"))
        flow = saved(ahead.union(back))
        rank = start
        for k in range(0, ROUNDS, STEP):
            new = rank
            for _ in range(STEP):
                passed = flow.join(new, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (F.col("share") * F.col("rank")).alias("rank"))
                new = start.union(passed).groupBy("host", "kind").agg(F.sum("rank").alias("rank"))
            new = saved(new)
            moved = new.union(rank.select("host", "kind", -F.col("rank"))).groupBy("host", "kind").agg(F.sum("rank").alias("d")).agg(F.max(F.abs("d"))).first()[0]
            rank = new
            if moved is None or moved <= TOLERANCE:
                break
        else:
            raise RuntimeError(f"ranks still change by {moved} after {ROUNDS} rounds")
    else:
        rank = start
    return rank.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))), F.lit(0.0)).alias("trust"), F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))), F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, trust and distrust."""
    parsed = pages.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parsed = parsed.withColumn("_r", ruled(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg((F.coalesce(F.col("_r.verdict"), F.lit("")) == v).cast("double"))
    seeds = parsed.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = saved(propagated(host_edges(pages, url, html), seeds))
    out = parsed.join(bounded(scores), "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce(F.col("_r.verdict"), F.when((distrust >= threshold) & (distrust > trust), "block").otherwise("allow"))
    return out.select(F.col("_key").alias(key), "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
