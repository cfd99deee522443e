"""URL filter: rules first, for all other pages trust and distrust that spread over host links.

Hosts are linked by the addresses in their pages and to the domains above them. Personalised
PageRank starts from hosts with pages that rules allow and follows the links; distrust starts from
hosts with pages that rules block and follows them backwards. A host whose distrust exceeds its
trust is blocked. Ranks, links and hosts are tables; a round is one join and one sum. Rounds end when
no further host is reached and what is still to move can change no verdict, or the ranks have settled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import lower_ascii
from factloom.session import cut_lineage, drop_scratch

#: Rounds that the SQL states, after which a rank lacks 3e-5; the operator goes on as it must.
ROUNDS, DAMPING = 64, 0.85
#: Ranks have settled if their summed change is no more than this; rounds between written tables.
TOLERANCE, STEP = 1e-9, 4
#: What a step leaves to move, as a share of what it moved.
AHEAD = DAMPING**STEP / (1 - DAMPING**STEP)
#: A host is blocked if its distrust is more than this many times its trust.
RATIO = 1.000001
#: A host's link to the domain above it weighs as much as one address in a page.
DOMAIN_WEIGHT = 1.0
KINDS = ("trust", "distrust")
ADDRESS = r"(?i)\b(?:href|src|action)\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``rule, verdict`` of the longest rule that fits, the first of equally long ones; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        made = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        out = F.when(fits, made).otherwise(out)
    return out


def judged_by_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page; the last two null without a rule."""
    parts = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    parts = parts.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules))
    return parts.select("page_id", "host", "path", "found.rule", "found.verdict")


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: addresses in pages and the domain above each host, without loops."""
    src = host_of(F.col("url"))
    addresses = F.regexp_extract_all("html", F.lit(ADDRESS), 1)
    found = pages.select(src.alias("src"), addresses.alias("to"))
    linked = (
        found.filter("src != ''")
        .select("src", F.explode("to").alias("to"))
        .select("src", lower_ascii(F.col("to")).alias("dst"))
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )
    hosts = linked.select(F.col("dst").alias("host")).union(
        pages.select(src.alias("host")).distinct()
    )
    # Both ways, for as long as the domain above has a dot itself.
    above = F.regexp_extract("host", r"^[^.]*\.([^.]+\..+)$", 1)
    steps = hosts.distinct().select("host", above.alias("up")).filter("up != ''")
    domain = steps.select(
        F.inline(
            F.array(
                F.struct(F.col("host").alias("src"), F.col("up").alias("dst")),
                F.struct(F.col("up").alias("src"), F.col("host").alias("dst")),
            )
        )
    ).withColumn("weight", F.lit(DOMAIN_WEIGHT))
    return (
        linked.union(domain)
        .filter("src != dst")
        .groupBy("src", "dst")
        .agg(F.sum("weight").alias("weight"))
    )


def host_ranks(ranks: DataFrame) -> DataFrame:
    """``host, trust, distrust``; zero where a host has no rank of a kind."""
    own = {kind: F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0) for kind in KINDS}
    return ranks.groupBy("host").agg(*[F.sum(rank).alias(kind) for kind, rank in own.items()])


def _settled(before: DataFrame, after: DataFrame, ratio: float | None) -> bool:
    """Whether no host was reached for the first time and the rest of the way does not matter.

    With ``ratio`` that is so once no host's distrust can cross that many times its trust any more;
    in any case once ranks move by no more than ``TOLERANCE`` in all.
    """
    turned = before.select("kind", "host", -F.col("rank"), F.lit(1).alias("old"))
    both = after.select("kind", "host", "rank", F.lit(0).alias("old")).union(turned)
    moved = both.groupBy("kind", "host").agg(F.sum("rank").alias("d"), F.max("old").alias("old"))
    told = moved.agg(
        *[F.sum(F.when(F.col("kind") == k, F.abs("d"))).alias(k) for k in KINDS],
        F.count_if(F.col("old") == 0).alias("fresh"),
    )
    told = told.first()
    if told["fresh"]:
        return False
    left = {k: (told[k] or 0.0) for k in KINDS}
    if sum(left.values()) <= TOLERANCE:
        return True
    if ratio is None:
        return False
    reach = AHEAD * (left["distrust"] + ratio * left["trust"])
    apart = F.abs(F.col("distrust") - F.col("trust") * ratio)
    return host_ranks(after).filter(apart <= reach).isEmpty()


def propagated(
    links: DataFrame, seeds: DataFrame, rounds: int | None = None, ratio: float | None = None
) -> DataFrame:
    """``kind, host, rank`` of personalised PageRank for each kind at once.

    Rounds go on for as long as hosts are reached that had no rank, and until the ranks have settled
    or, with ``ratio``, no verdict can change; ``rounds`` asks for a fixed number instead.

    ``seeds`` holds ``kind, host, mass``. Kind ``trust`` follows ``links``, ``distrust`` follows
    them backwards. What a host passes on is dealt by weight; a host without links keeps nothing of
    it. A few rounds at a time are written to the shared folder, so the plan stays short, and the
    table before goes. Links are dealt once, by their source, and kept so; a lost part is read again
    from the written table.
    """
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(
        links.select(F.lit("distrust"), "dst", "src", "weight")
    )
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    edges = both.join(out, ["kind", "src"]).select(
        "kind", "src", "dst", (F.col("weight") / F.col("total") * DAMPING).alias("share")
    )
    edges = cut_lineage(edges, "edges").repartition("kind", "src").persist(StorageLevel.DISK_ONLY)
    whole = seeds.groupBy("kind").agg(F.sum("mass").alias("all"))
    base = cut_lineage(
        seeds.join(F.broadcast(whole), "kind").select(
            "kind", "host", (F.col("mass") / F.col("all")).alias("rank")
        ),
        "seeds",
    )
    ranks = base
    restart = base.select("kind", "host", (F.col("rank") * (1 - DAMPING)).alias("rank"))
    done = 0
    while rounds is None or done < rounds:
        before, step = ranks, STEP if rounds is None else min(STEP, rounds - done)
        for _ in range(step):
            passed = (F.col("rank") * F.col("share")).alias("rank")
            moved = edges.join(
                ranks.select("kind", F.col("host").alias("src"), "rank"), ["kind", "src"]
            ).select("kind", F.col("dst").alias("host"), passed)
            ranks = moved.union(restart).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        ranks, done = cut_lineage(ranks, "ranks"), done + step
        over = rounds is None and _settled(before, ranks, ratio)
        if before is not base:
            drop_scratch(before)
        if over:
            break
    edges.unpersist()
    return ranks


def judged_pages(
    pages: DataFrame,
    rules: list[Rule] | None = None,
    rounds: int | None = None,
    ratio: float = RATIO,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for each row of ``pages``.

    A page without a fitting rule takes its host's verdict: block if distrust exceeds ``ratio`` times
    trust, else allow. Hosts that no seed reaches have neither and are allowed, and so are null
    addresses and those without ``://``, whose host and path are empty. Null pages (``html``) have
    no links, repeated rows are judged each, an empty table gives no rows, other columns are left
    out.
    """
    rules = RULES if rules is None else rules
    judged = judged_by_rules(pages, rules)
    kind = F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind")
    seeds = (
        judged.filter("verdict is not null and host != ''")
        .groupBy(kind, "host")
        .agg(F.count("*").cast("double").alias("mass"))
    )
    links = cut_lineage(host_links(pages), "host-links")
    ranks = propagated(links, cut_lineage(seeds, "seed-counts"), rounds, ratio)
    hosts, none = host_ranks(ranks), F.lit(0.0)
    own = judged.join(hosts, "host", "left")
    trust, distrust = F.coalesce("trust", none), F.coalesce("distrust", none)
    method = F.when(distrust > trust * ratio, "block").otherwise("allow")
    return own.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", method).alias("verdict"),
        trust.alias("trust"),
        distrust.alias("distrust"),
    )
