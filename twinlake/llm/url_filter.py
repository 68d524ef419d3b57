"""URLs judged by rules of host and path and by a list of canonical URLs: a blocked Bloom filter of all that is listed
passes possible hits to an exact hash join, which removes false positives. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.checkpoints import cut
from twinlake.operators.keyfilter import marked_rows

RULES = "host string, path string, verdict string"
ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not tell pages apart.
TRACKING = ["utm_[a-z]+", "ref", "fbclid", "gclid"]
#: Labels in front of a host that lead to the same site.
FRONTS = ["www", "m"]


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.call_function("instr", url, F.lit("://"))
    return F.when(at > 0, F.call_function("substring", url, at + 3))


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """One spelling of the URLs of a page: no scheme, user, standard port, leading ``www.`` or ``m.``, fragment,
    tracking parameters, empty path segments or slash at the end; the host lower-cased. Null without a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^.*@", ""), r":(80|443)?$", "")
    host = F.regexp_replace(host, f"^({'|'.join(FRONTS)})[.]", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), "/+", "/"), "/$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*[?]([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, f"(^|&)({'|'.join(TRACKING)})=[^&]*", ""), "^&+", "")
    return F.when(host != "", F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def _tails(host: Column, labels: list[int]) -> Column:
    """The host's endings of so many labels, and how many."""
    parts = F.split(host, "[.]")
    ends = [F.when(F.size(parts) >= n, F.substring_index(host, ".", -n)) for n in labels]
    return F.array_compact(F.array(*ends)) if ends else F.array().cast("array<string>")


def _heads(path: Column, lengths: list[int]) -> Column:
    """The path's beginnings of so many characters."""
    return F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.char_length(path)), lambda n: F.call_function("substring", path, F.lit(1), n))


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row of ``pages``.

    ``rules`` has ``host, path, verdict``: a rule fits its host and all subdomains, if the path starts with the rule's;
    the longest host and path together win, of equally long ones the longer host; of rules that are given twice, the
    one that blocks. Where no rule fits, a page is blocked if its canonical URL is one of ``listed`` (column ``url``,
    already canonical), else allowed. A null URL, or one without ``://``, has an empty host and path, which only a
    rule with both empty fits. Null and repeated ids are rows like others; no row of ``pages`` gives no row; null rows
    of ``rules`` and ``listed`` fit nothing.

    Each distinct URL (copies are combined before the shuffle) gives out a key for every ending of its host and
    beginning of its path of a length that some rule has, and one for its canonical form. The Bloom filter of all keys
    of rules and list, sized from their number, lets possible hits through, which an exact join by the strings
    confirms. Lengths of rules, of which a list has few whatever its size, are all that the driver sees.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null")
    rules = rules.groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    entries = cut(
        rules.select(F.lit("rule").alias("kind"), F.col("host").alias("a"), F.col("path").alias("b"), "verdict").unionByName(
            listed.where("url is not null").select(F.lit("url").alias("kind"), F.col("url").alias("a"), F.lit("").alias("b"), F.lit(BLOCK).alias("verdict")).distinct()
        )
    )
    of_rules = entries.where("kind = 'rule'")
    labels = sorted(r[0] for r in of_rules.select(F.size(F.split("a", "[.]"))).distinct().collect())
    lengths = sorted(r[0] for r in of_rules.select(F.char_length("b")).distinct().collect())

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical_url(F.col("url")).alias("canonical"))
    key = ["host", "path", "canonical"]
    fits = F.flatten(F.transform(_tails(F.col("host"), labels), lambda a: F.transform(_heads(F.col("path"), lengths), lambda b: F.struct(F.lit("rule").alias("kind"), a.alias("a"), b.alias("b")))))
    own = F.when(F.col("canonical").isNotNull(), F.array(F.struct(F.lit("url").alias("kind"), F.col("canonical").alias("a"), F.lit("").alias("b"))))
    candidates = rows.select(*key).distinct().select(*key, F.explode(F.concat(fits, F.coalesce(own, F.filter(fits, lambda x: F.lit(False))))).alias("x")).select(*key, "x.*")
    possible = marked_rows(candidates, entries, ["kind", "a", "b"])
    hits = possible.join(entries, ["kind", "a", "b"])
    is_rule = F.col("kind") == "rule"
    rank = F.struct((F.char_length("a") + F.char_length("b")).alias("length"), F.char_length("a").alias("of_host"), F.concat("a", "b").alias("rule"), "verdict")
    best = hits.groupBy(*key).agg(F.max(F.when(is_rule, rank)).alias("top"), F.max(~is_rule).alias("is_listed"))
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("canonical").alias("c"), "top", "is_listed")
    same = (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")) & F.col("canonical").eqNullSafe(F.col("c"))
    verdict = F.coalesce("top.verdict", F.when(F.col("is_listed"), BLOCK), F.lit(ALLOW))
    return rows.join(best, same, "left").select("page_id", "host", "path", F.col("top.rule").alias("rule"), verdict.alias("verdict"))


#: The rules that the query is to judge by.
QUERY_RULES = [("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK)]
#: Parts of host names by which the query's list is drawn from the pages, as no list of URLs is given.
JUNK = ["casino", "bets", "pills", "loan", "win"]


def junk_list(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``url``: the canonical URLs of pages on hosts of which a part between dots and hyphens is a word of junk."""
    url = F.col(url_col)
    return pages.where(host_of(url).rlike(f"(^|[.-])({'|'.join(JUNK)})([.-]|$)")).select(canonical_url(url).alias("url")).distinct()


def _oracle() -> str:
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in QUERY_RULES)
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] END AS rest FROM pages),
s AS (SELECT page_id, rest, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
  coalesce(regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '(^|&)({'|'.join(TRACKING)})=[^&]*', '', 'g'), '^&+', ''), '') AS q FROM u),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '^({'|'.join(FRONTS)})[.]', '') AS h FROM s),
k AS (SELECT page_id, host, path, CASE WHEN h <> '' THEN h || regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS canonical FROM c),
junk AS (SELECT DISTINCT canonical FROM k WHERE regexp_matches(host, '(^|[.-])({'|'.join(JUNK)})([.-]|$)') AND canonical IS NOT NULL),
rules(rh, rp, rv) AS (VALUES {listed}),
best AS (SELECT host, path, max(struct_pack(n := length(rh || rp), m := length(rh), rule := rh || rp, verdict := rv)) AS top
  FROM (SELECT DISTINCT host, path FROM k) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT page_id, host, path, top.rule AS rule, coalesce(top.verdict, CASE WHEN canonical IN (SELECT canonical FROM junk) THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN best USING (host, path)
"""


ORACLE = _oracle()
