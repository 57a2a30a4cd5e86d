"""URL filter: rules by host and path, and trust and distrust spread over links between hosts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import stage

#: Rounds of spreading in the SQL, share that follows links, rounds between written tables.
ROUNDS, DAMPING, WRITE_EVERY = 10, 0.85, 5

#: Spreading ends when no score has changed by a larger share of itself between two written tables.
TOLERANCE = 1e-9

#: A host is blocked when its distrust exceeds its trust this many times.
RATIO = 1.0

#: Share by which distrust has to be over that, so that the order of sums does not decide a verdict at any size of scores.
MARGIN = 1e-9

#: Digits that the SQL keeps; too few where scores are small, as on large host graphs.
DIGITS = 9


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; '' for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ? # or the end; '' for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does. Of equally long ones the first listed."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst and n of links between different hosts, from the href attributes of the pages.

    Absolute (http, https) and protocol-relative targets count; others stay on
    their own host. A page counts a target host once.
    """
    targets = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^/?#\s"'>]+)"""), F.lit(1))
    hosts = F.array_distinct(F.transform(targets, lambda t: F.translate(F.regexp_replace(t, r"^(?i:https?:)?//", ""), UPPER, LOWER)))
    own = pages.select(host_of(F.col(url_col)).alias("src"), hosts.alias("hosts")).filter((F.col("src") != "") & (F.size("hosts") > 0))
    return own.select("src", F.explode("hosts").alias("dst")).filter("dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_scores(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url", html_col: str = "html", rounds: int | None = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, trust and distrust of every host with a page or a link.

    Trust is personalised PageRank that restarts at hosts with pages that rules
    allow, distrust the same over reversed links from hosts with pages that
    rules block; a host restarts in proportion to its allowed or blocked pages.
    Hosts without links out keep nothing. Both are spread in one chain of
    rounds: a weighted link table keyed by (kind, from), whose sums are
    combined before each shuffle, and a table written every few rounds.
    Without a number of ``rounds`` they go on until every host that seeds reach
    has a score and none changes by more than TOLERANCE of itself.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    ruled = pages.select(host.alias("host"), rule_of(host, path, rules)[1].alias("verdict")).filter("host <> ''").groupBy("host")
    seeds = stage(ruled.agg(F.count(F.when(F.col("verdict") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked")))
    links = stage(host_links(pages, url_col, html_col))
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").union(links.select(F.lit("distrust"), F.col("dst"), F.col("src"), F.col("n")))
    total = both.groupBy("kind", "a").agg(F.sum("n").alias("total"))
    edges = stage(both.join(total, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("total")).alias("share")))
    start = seeds.select(F.lit("trust").alias("kind"), "host", F.col("allowed").alias("w")).union(seeds.select(F.lit("distrust"), F.col("host"), F.col("blocked"))).filter("w > 0")
    sums = start.groupBy("kind").agg(F.sum("w").alias("s"))
    start = stage(start.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("w") / F.col("s")).alias("seed")))  # two rows are broadcast
    rank = start.withColumnRenamed("seed", "score")
    if rounds is None:  # sums that only grow, so that the change shows what is still on the way
        rank = stage(rank.withColumn("score", F.col("score") * (1 - damping)))
    before, k, moving = rank, 0, rounds is not None or not edges.isEmpty()
    while moving and (rounds is None or k < rounds):
        moved = rank.withColumnRenamed("host", "a").join(edges, ["kind", "a"]).select("kind", F.col("b").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        rank = moved.union(start.select("kind", "host", F.col("seed") * (1 - damping))).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        k += 1
        if k % WRITE_EVERY == 0:
            rank = stage(rank)
            if rounds is None:
                was = before.select("kind", "host", F.col("score").alias("was"))
                changed = F.col("score") - F.coalesce("was", F.lit(0.0)) > F.col("score") * TOLERANCE
                moving = not rank.join(was, ["kind", "host"], "left").filter(changed).isEmpty()
                before = rank
    by_kind = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    every = rank.select("host", "kind", "score").union(seeds.select("host", F.lit("none"), F.lit(0.0)))
    return every.groupBy("host").agg(by_kind("trust").alias("trust"), by_kind("distrust").alias("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rounds: int | None = None, ratio: float = RATIO) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, trust, distrust.

    The longest rule that fits decides; without one, the host does: block if
    its distrust is over ``ratio`` times its trust (by more than a share of
    MARGIN), else allow; no score is rounded. Null urls and
    urls without :// have empty host and path and are allowed. Null html has no
    links. Repeated rows are judged alike. Other columns do not matter.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    text, verdict = rule_of(host, path, rules)
    own = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), text.alias("rule"), verdict.alias("ruled"))
    scores = stage(host_scores(pages, rules, url_col, html_col, rounds))
    got = own.join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    other = F.when(F.col("distrust") > F.col("trust") * (ratio * (1 + MARGIN)), F.lit("block")).otherwise(F.lit("allow"))
    return got.select("page_id", "host", "path", "rule", F.coalesce("ruled", other).alias("verdict"), "trust", "distrust")
