"""URL filters in DataFrame functions only: host and path rules, then a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, table

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The filter: 16 bits for each listed URL in blocks of 512, and never more than MOST_BLOCKS blocks, so that a broadcast stays under
#: 20 MB whatever the list; a fuller filter passes more on to the exact join, and the verdicts stay the same.
BITS_PER_URL, BLOCK_BITS, LANES, MOST_BLOCKS = 16, 512, 8, 1 << 18
#: Rules become one expression; longer lists belong in the table of listed URLs.
MOST_RULES = 500
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_QUERY = r"(?s)^[^?#]*\?([^#]*)"
_TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; empty for null or without `://`."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or end; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without `www.` and port, path without a closing slash, sorted parameters without those of trackers; no scheme, no fragment. Null: null."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":\d+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(url, _QUERY, 1), "&"), lambda p: (p != "") & ~p.rlike(_TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(url.isNotNull(), F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), query))


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as struct(verdict, rule), or null. A rule fits its host and all subdomains if the path starts with the rule's; of equally long ones the first by code point."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; put more than {MOST_RULES} into the list of URLs")
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def _lane(url: Column, i: int) -> Column:
    """The one bit that a URL sets in lane i of its block."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(F.xxhash64(url, F.lit(1)), 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int"))


def blocked_bloom(listed: DataFrame, column: str, blocks: int) -> DataFrame:
    """One row per block that has bits: `block` and its 64-bit lanes `lane0`... A URL falls into one block and sets one bit in each lane."""
    url = F.col(column)
    return (
        listed.select(F.pmod(F.xxhash64(url), F.lit(blocks)).alias("block"), *[_lane(url, i).alias(f"lane{i}") for i in range(LANES)])
        .groupBy("block")
        .agg(*[F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)])
    )


def judge_urls(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url: str = "url", listed_url: str = "url") -> DataFrame:
    """`pages` with `host`, `path`, `rule` and `verdict`: that of the longest rule that fits, else block for a listed URL, else allow.

    The filter of listed canonical URLs is broadcast, its size fixed by MOST_BLOCKS; what it passes goes to an exact join with the
    list, so that a page is blocked only if its canonical URL is listed. Pages that it holds back meet no shuffle.

    Null url: host and path empty, no rule, allow. Nulls and repeats in the list don't count. Columns named like the new ones are
    replaced. Empty tables: no rows, or nothing listed.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    n = {c: free_name(pages, f"of_{c}") for c in ("host", "path", "canonical", "block", "rule", "maybe", "hit", "listed", *[f"lane{i}" for i in range(LANES)])}
    col = lambda c: F.col(n[c])
    names = listed.select(canonical(F.col(f"`{listed_url}`")).alias(n["listed"])).filter(col("listed").isNotNull()).distinct()
    blocks = max(1, min(MOST_BLOCKS, -(-names.count() * BITS_PER_URL // BLOCK_BITS)))
    bloom = blocked_bloom(names, n["listed"], blocks).withColumnsRenamed({c: n[c] for c in ("block", *[f"lane{i}" for i in range(LANES)])})

    u = F.col(f"`{url}`")
    rows = pages.select("*", host_of(u).alias(n["host"]), path_of(u).alias(n["path"]), canonical(u).alias(n["canonical"]))
    rows = rows.withColumn(n["block"], F.pmod(F.xxhash64(n["canonical"]), F.lit(blocks)))
    sets = F.lit(True)
    for i in range(LANES):
        sets = sets & (col(f"lane{i}").bitwiseAND(_lane(col("canonical"), i)) != 0)
    rows = rows.join(F.broadcast(bloom), n["block"], "left").withColumn(n["maybe"], F.coalesce(sets, F.lit(False)) & col("canonical").isNotNull())
    rows = rows.select(*kept, col("host"), col("path"), col("canonical"), matched_rule(col("host"), col("path"), rules).alias(n["rule"]), col("maybe"))

    passed = rows.filter(col("maybe")).join(names.withColumn(n["hit"], F.lit(True)), col("canonical") == col("listed"), "left")
    both = passed.drop(n["listed"]).unionByName(rows.filter(~col("maybe")).withColumn(n["hit"], F.lit(False)))
    verdict = F.coalesce(col("rule")["verdict"], F.when(col("hit"), F.lit("block")).otherwise(F.lit("allow")))
    return both.select(*kept, col("host").alias("host"), col("path").alias("path"), col("rule")["rule"].alias("rule"), verdict.alias("verdict"))


#: In the query a list stands in for one bought or crawled: the URLs of all pages whose host has a label with one of these words.
LISTED_HOSTS = "casino|spam|bets|pills"


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, pages.filter(host_of(F.col("url")).rlike(LISTED_HOSTS)))


OP1_SQL = r"""
WITH p AS (SELECT page_id, url,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
  list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS q FROM pages),
c AS (SELECT *, CASE WHEN url IS NOT NULL THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':\d+$', '') || regexp_replace(path, '/+$', '')
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical FROM p),
listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, 'casino|spam|bets|pills')),
r AS (SELECT *, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM c)
SELECT page_id, url, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
