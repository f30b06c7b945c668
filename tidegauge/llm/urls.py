"""URL filters: rules indexed by their rarest literal token.

Thousands of regular expressions cannot be run on every url.  A rule can only
fit a url that holds all of the rule's literal tokens, so each rule is filed
under one of them: the one that fewest urls of this corpus hold.  The tokens of
a url fetch the rules filed under them, by an equi-join, and only those run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.llm.text import ascii_lower

#: Rules up to this number are broadcast (each is one short row); beyond it Spark plans a shuffled join.
BROADCAST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` (Java syntax) is searched in ``host + path`` of a site rule, else in the lower-cased url.

    Every url that the pattern fits must hold all ``tokens``; ``rank`` decides
    between rules of the same sort, the largest first.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool
    rank: int


def site_rule(verdict: str, site: str) -> Rule:
    """A host with all its subdomains, and a prefix of the path: ``example.org/es/``."""
    host, _, rest = site.partition("/")
    path = "/" + rest
    whole = [s for s in path.split("/")[1:-1] if s]  # the last segment may go on in the url
    tokens = tuple(dict.fromkeys([f"h:{x}" for x in host.split(".")] + [f"p:{x}" for x in whole]))
    return Rule(site, verdict, rf"^(?:[^/]*\.)?{re.escape(host + path)}", tokens, True, len(site))


def word_rule(verdict: str, *words: str) -> Rule:
    """Words that stand in a row anywhere in the url, with one other character between them."""
    body = "[^a-z0-9]".join(map(re.escape, words))
    return Rule("-".join(words), verdict, rf"(?:^|[^a-z0-9]){body}(?:[^a-z0-9]|$)", tuple(f"u:{w}" for w in words), False, len(body))


# The site rules.
SITES = (
    site_rule("allow", "org/"),
    site_rule("block", "example.org/es/"),
    site_rule("block", "example.org/en/1"),
    site_rule("allow", "com/fr/"),
    site_rule("block", "com/de/"),
)
#: For urls that no site rule fits: names that stand for spam, betting, adult and download farms.
WORDS = tuple(
    word_rule("block", *w.split())
    for w in ("spam farm", "spam", "casino", "poker", "betting", "porn", "xxx", "viagra", "free download", "warez", "torrent", "click here", "ad click", "link farm")
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host, segments of the path, and words of the whole url."""
    tagged = lambda tag, parts: F.transform(F.array_remove(parts, ""), lambda x: F.concat(F.lit(tag), x))
    words = F.split(ascii_lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+", -1)
    return F.array_distinct(F.concat(tagged("h:", F.split(host, r"\.", -1)), tagged("p:", F.split(path, "/", -1)), tagged("u:", words)))


def rule_index(parsed: DataFrame, rules: list[Rule]) -> DataFrame:
    """Every rule once, under the token of its own that fewest urls hold (ties: the smaller token)."""
    spark = parsed.sparkSession
    table = spark.createDataFrame([(r.name, r.verdict, r.pattern, r.site, r.rank, list(r.tokens)) for r in rules], "name string, verdict string, pattern string, site boolean, rank int, tokens array<string>")
    tokens = table.select("name", "site", F.explode("tokens").alias("token"))
    small = len(rules) <= BROADCAST_RULES
    known = tokens.select("token").distinct()
    seen = parsed.select(F.explode("tokens").alias("token")).join(F.broadcast(known) if small else known, "token").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = Window.partitionBy("name", "site").orderBy("urls", "token")
    chosen = tokens.join(seen, "token", "left").withColumn("urls", F.coalesce("urls", F.lit(0))).withColumn("nth", F.row_number().over(rarest)).filter("nth = 1")
    index = table.drop("tokens").join(chosen.select("name", "site", "token", "urls"), ["name", "site"])
    return F.broadcast(index) if small else index


def judge(pages: DataFrame, *, url: str = "url", keep: list[str], sites=SITES, words=WORDS, otherwise: str = "allow") -> DataFrame:
    """One row per row of ``pages``: ``keep``, host, path, rule and verdict.

    The longest site rule that fits decides and is named; without one, a word
    rule decides, else ``otherwise``.

    Edge cases: a null url and one without ``://`` have an empty host and path,
    fit no site rule, and may fit a word rule; of several site rules of one
    length the greatest name wins; repeated rows come back as often as they
    came; an empty table gives an empty result; other columns are not read.
    """
    names = [f"keep_{c}" for c in keep]
    base = pages.select(*[F.col(c).alias(f"keep_{c}") for c in keep], F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parsed = base.withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    index = rule_index(parsed, [*sites, *words])
    # the empty token fetches nothing: it keeps a row for each url and counts the copies
    asked = parsed.select(*names, "url", "host", "path", F.explode(F.concat(F.array(F.lit("")), F.col("tokens"))).alias("token"))
    fetched = asked.join(index, "token", "left").filter((F.col("token") == "") | F.col("pattern").isNotNull())
    fits = F.expr("CASE WHEN site THEN concat(host, path) ELSE translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END RLIKE pattern")
    best = lambda site: F.max(F.when(fits & (F.col("site") == site), F.struct("rank", "name", "verdict")))
    judged = fetched.groupBy(*names, "url", "host", "path").agg(
        F.sum((F.col("token") == "").cast("int")).alias("copies"), best(True).alias("by_site"), best(False).alias("by_word"), F.count("pattern").alias("n_tried")
    )
    out = judged.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(
        *[F.col(f"keep_{c}").alias(c) for c in keep],
        "host",
        "path",
        F.col("by_site.name").alias("rule"),
        F.coalesce("by_site.verdict", "by_word.verdict", F.lit(otherwise)).alias("verdict"),
        F.col("by_word.name").alias("word_rule"),
    )
