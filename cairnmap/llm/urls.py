"""URL filters: rules by host and path, and trust and distrust that spread over the links between hosts.

Personalised PageRank from trusted hosts along links gives trust; from blocked hosts against the links
(who links to them) gives distrust. Links are counted per pair of hosts before anything is joined, so the
graph has at most one row per pair; a round is a join and a sum with partial sums in the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cairnmap.session import written

# Fixed values: (verdict, rule host, rule path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# Words that make a host a blocked seed where they stand alone in its name, between dots and hyphens.
BLOCKED_WORDS = ("casino", "pills", "bets", "adult", "spam", "porn", "warez", "phish", "malware", "ads-track")
ROUNDS, DAMPING = 10, 0.85
# A host without a rule is blocked when its share of distrust exceeds this and its share of trust.
MIN_DISTRUST = 1e-6
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, on, under in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(under)
        out = F.when(fits, F.struct(F.lit(on + under).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): pages of src that link to another host dst."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_LINK), F.lit(1)),
                                         lambda h: F.translate(h, UPPER, LOWER)))
    links = pages.select(host_of(F.col(url)).alias("src"), F.explode(found).alias("dst"))
    return links.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(hosts: DataFrame, links: DataFrame, seed: str, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, rank): personalised PageRank over links (src, dst, n), restarting at hosts where ``seed`` holds.

    Rank of hosts without outgoing links returns to the seeds. Ranks sum to 1; without seeds all are 0.
    """
    seeds = hosts.filter(seed).count()
    start = F.when(F.col(seed), F.lit(1.0 / max(seeds, 1))).otherwise(F.lit(0.0))
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    shares = written(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    ranks = hosts.select("host", start.alias("start"), start.alias("rank"))
    if not seeds or shares.isEmpty():
        return ranks.select("host", "rank")
    for _ in range(rounds):
        sent = shares.join(ranks, shares["src"] == ranks["host"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        moved = written(ranks.join(sent, ranks["host"] == sent["dst"], "left").select("host", "start", F.coalesce("got", F.lit(0.0)).alias("got")))
        lost = 1.0 - damping * moved.agg(F.sum("got")).first()[0]
        ranks = moved.select("host", "start", (damping * F.col("got") + lost * F.col("start")).alias("rank"))
    return written(ranks.select("host", "rank"))


def _word_pattern(words: Sequence[str]) -> str:
    return f"(^|[.-])({'|'.join(re.escape(w) for w in words)})([.-]|$)"


def _ruled(host: Column, rules, verdict: str) -> Column:
    """Whether a rule of that verdict for all paths fits the host."""
    fits = [(host == on) | host.endswith("." + on) for v, on, under in rules if v == verdict and under == "/"]
    return reduce(lambda a, b: a | b, fits, F.lit(False))


def score_hosts(pages: DataFrame, url: str = "url", html: str = "html", rules=RULES, blocked_words: Sequence[str] = BLOCKED_WORDS,
                seeds: DataFrame | None = None) -> DataFrame:
    """(host, trust, distrust, blocked): every host of a page or a link.

    Blocked seeds are hosts that a block rule for all paths fits, hosts with a blocked word standing alone in their name, and hosts that ``seeds``
    (host, bad) marks as bad; trusted seeds are the other hosts that an allow rule for all paths fits or that ``seeds`` marks as not bad. ``blocked`` is true for blocked seeds and for hosts whose distrust exceeds
    ``MIN_DISTRUST`` and their trust, unless they are trusted seeds.
    """
    links = written(host_links(pages, url, html))
    named = pages.select(host_of(F.col(url)).alias("host")).filter("host <> ''").distinct()
    hosts = named.union(links.select("src")).union(links.select("dst")).distinct()
    bad, allowed = _ruled(F.col("host"), rules, "block"), _ruled(F.col("host"), rules, "allow")
    if blocked_words:
        bad = bad | F.col("host").rlike(_word_pattern(blocked_words))
    if seeds is not None:
        listed = seeds.groupBy(F.translate("host", UPPER, LOWER).alias("host")).agg(F.max("bad").alias("_listed"))
        hosts = hosts.join(listed, "host", "left")
        bad, allowed = bad | F.coalesce("_listed", F.lit(False)), allowed | F.coalesce(~F.col("_listed"), F.lit(False))
    seeded = written(hosts.select("host", bad.alias("bad"), (allowed & ~bad).alias("good")))
    trust = spread(seeded, links, "good").withColumnRenamed("rank", "trust")
    distrust = spread(seeded, links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), "bad").withColumnRenamed("rank", "distrust")
    judged = seeded.join(trust, "host").join(distrust, "host")
    blocked = F.col("bad") | (~F.col("good") & (F.col("distrust") > MIN_DISTRUST) & (F.col("distrust") > F.col("trust")))
    return judged.select("host", "trust", "distrust", blocked.alias("blocked"))


def judge_urls(pages: DataFrame, keep: Sequence[str] = ("page_id",), url: str = "url", html: str = "html", rules=RULES,
               blocked_words: Sequence[str] = BLOCKED_WORDS, seeds: DataFrame | None = None) -> DataFrame:
    """The columns ``keep`` with ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust`` of every row.

    The longest fitting rule decides; without one, the host's ``blocked`` does. A null url and one without
    ``://`` have empty host and path, no rule, trust and distrust 0, and are allowed; null html has no links. Rows are judged one by
    one, repeated rows alike; an empty table gives an empty table. Columns in ``keep`` must not bear the added names.
    """
    hosts = score_hosts(pages, url, html, rules, blocked_words, seeds).withColumnRenamed("host", "_host")
    named = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = named.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    judged = ruled.join(hosts, ruled["host"] == hosts["_host"], "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.select(*keep, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"),
                         F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))




def oracle(rounds: int = ROUNDS, damping: float = DAMPING) -> str:
    """DuckDB SQL of the query's rows, the rounds of both propagations written out."""
    fits = "(host = '{0}' OR ends_with(host, '.{0}'))"
    words = " OR ".join([f"regexp_matches(host, '{_word_pattern(BLOCKED_WORDS)}')", *[fits.format(h) for v, h, p in RULES if v == "block" and p == "/"]])
    allowed = " OR ".join(fits.format(h) for v, h, p in RULES if v == "allow" and p == "/") or "false"
    rules = " ".join(f"WHEN {fits.format(h)} AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    parts = [f"""WITH p AS MATERIALIZED (SELECT *, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)""",
             f"""l AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, unnest(list_distinct(list_transform(
            regexp_extract_all(coalesce(html, ''), '{_LINK.replace("'", "''")}', 1), lambda h: translate(h, '{UPPER}', '{LOWER}')))) AS dst FROM p)
            WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2)""",
             f"""h AS MATERIALIZED (SELECT host, {words} AS bad, ({allowed}) AND NOT ({words}) AS good FROM (
            SELECT host FROM p WHERE host <> '' UNION SELECT src FROM l UNION SELECT dst FROM l))"""]
    for name, seed, a, b in (("t", "good", "src", "dst"), ("d", "bad", "dst", "src")):
        parts.append(f"{name}s AS (SELECT {a} AS src, {b} AS dst, n / sum(n) OVER (PARTITION BY {a}) AS share FROM l)")
        parts.append(f"{name}0 AS (SELECT host, s, s AS r FROM (SELECT host, CASE WHEN {seed} THEN 1.0 / greatest((SELECT count(*) FROM h WHERE {seed}), 1) ELSE 0.0 END AS s FROM h))")
        for i in range(rounds):
            parts.append(f"""{name}g{i} AS MATERIALIZED (SELECT host, s, coalesce((SELECT sum(x.r * e.share) FROM {name}s e JOIN {name}{i} x ON x.host = e.src
                WHERE e.dst = o.host), 0) AS g FROM {name}{i} o)""")
            parts.append(f"{name}{i + 1} AS MATERIALIZED (SELECT host, s, {damping} * g + (1 - {damping} * (SELECT sum(g) FROM {name}g{i})) * s AS r FROM {name}g{i})")
    return ", ".join(parts) + f"""
        SELECT page_id, p.host, path, nullif(split_part(rule, ' ', 2), '') AS rule, CASE WHEN rule <> '' THEN split_part(rule, ' ', 1)
            WHEN bad OR (NOT good AND d.r > {MIN_DISTRUST} AND d.r > t.r) THEN 'block' ELSE 'allow' END AS verdict
        FROM (SELECT *, CASE {rules} ELSE '' END AS rule FROM p) p LEFT JOIN h USING (host) LEFT JOIN t{rounds} t USING (host) LEFT JOIN d{rounds} d USING (host)"""
