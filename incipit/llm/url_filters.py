"""URL filters: pattern rules indexed by their rarest literal token.

A rule is `host/path-prefix` (fits the host and its subdomains, and paths that start with the prefix) or a `*` wildcard
pattern over host + path. Each rule is filed under the one of its literal tokens that the fewest urls hold; a url fetches
the rules filed under its own tokens with an equi-join, and only those rules run their regular expression.

Work is done once per distinct url. The rule side is broadcast only if a count proves it small; beyond that both sides
shuffle on the token, and hot tokens carry few rules since every rule sits under its rarest token.

Edge cases: a null url, or one without `://`, has empty host and path (its verdict is the default, unless a pattern
without any literal token fits the empty string); repeated pages each get their row; an empty table gives no rows; extra
columns of the input are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incipit.scale import cut, small

#: The rules every run has: (action, host, path prefix). Longest fitting one wins.
BASE_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Patterns of advertising and tracking endpoints over host + path; a url that fits one, and no rule above, is blocked.
BLOCK_PATTERNS = [
    "*/ads/*", "*/adserver/*", "*/banner/*", "*/tracking/*", "*/pixel.gif", "*/wp-login.php", "*/cgi-bin/*", "*/casino/*",
    "*/porn/*", "*/viagra/*", "ads.*", "adserver.*", "*.doubleclick.*", "*/popunder/*", "*/affiliate/redirect/*",
]
TOKEN = "[A-Za-z0-9]+"


def host_rule_regex(host: str, path: str) -> str:
    return rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"


def pattern_regex(pattern: str) -> str:
    return "^" + ".*".join(re.escape(x) for x in pattern.split("*")) + "$"


def whole_tokens(pattern: str) -> list[str]:
    """Literal tokens that any fitting url holds as a whole token: those that no wildcard (or open end) can lengthen."""
    return [m[0] for m in re.finditer(TOKEN, pattern) if not (m.start() and pattern[m.start() - 1] == "*") and not pattern[m.end() : m.end() + 1] == "*"]


def rules_frame(spark, base=BASE_RULES, patterns=BLOCK_PATTERNS) -> DataFrame:
    """rule_id, kind (base or pattern), action, rule, regex, tokens."""
    rows = [("base", action, host + path, host_rule_regex(host, path), whole_tokens(host + path + "*")) for action, host, path in base]
    rows += [("pattern", "block", p, pattern_regex(p), whole_tokens(p)) for p in patterns]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rule_id int, kind string, action string, rule string, regex string, tokens array<string>")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (the longest fitting base rule or null), pattern (a fitting pattern or null), verdict."""
    pages = pages.select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    urls = cut(pages.select("url").distinct().select("url", host.alias("host"), path.alias("path")), "urls")
    tokens = urls.select("url", F.concat("host", "path").alias("key")).withColumn("tokens", F.array_distinct(F.regexp_extract_all("key", F.lit(f"({TOKEN})"), F.lit(1))))

    # How many urls hold each token that occurs in a rule; then every rule's rarest one ("" where it has none).
    words = rules.select("rule_id", F.explode_outer("tokens").alias("token")).fillna("", ["token"])
    seen = tokens.select(F.explode("tokens").alias("token")).join(small(words.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("rule_id").orderBy(F.coalesce("n", F.lit(0)), "token")
    index = words.join(seen, "token", "left").withColumn("k", F.row_number().over(rarest)).where("k = 1").join(rules.drop("tokens"), "rule_id").select("token", "kind", "action", "rule", "regex")

    fits = (
        tokens.select("url", "key", F.explode(F.concat("tokens", F.array(F.lit("")))).alias("token"))
        .join(small(cut(index, "url-index")), "token")
        .where(F.expr("rlike(key, regex)"))
        .groupBy(F.col("url").alias("_url"))
        .agg(
            F.max(F.when(F.col("kind") == "base", F.struct(F.length("rule").alias("n"), "rule", "action"))).alias("base"),
            F.min(F.when(F.col("kind") == "pattern", F.struct("rule", "action"))).alias("other"),
        )
    )
    # A null url meets its fits too. There is a row a distinct url that fits, so a hot url is only its own rows.
    out = pages.join(fits, pages["url"].eqNullSafe(fits["_url"]), "left")
    return out.select(
        "page_id", host.alias("host"), path.alias("path"), F.col("base.rule").alias("rule"), F.col("other.rule").alias("pattern"), F.coalesce("base.action", "other.action", F.lit(default)).alias("verdict")
    )


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark))


def oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    base = " union all ".join(f"select {quoted(a)} as action, {quoted(h)} as h, {quoted(p)} as p" for a, h, p in BASE_RULES)
    pats = " union all ".join(f"select {quoted(p)} as pattern, {quoted(pattern_regex(p))} as rx" for p in BLOCK_PATTERNS)
    return f"""
    with rest as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
    raw as (select page_id, r, regexp_extract(r, '^[^/?#]*') as h0 from rest),
    parts as (select row_number() over () as rid, page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      regexp_extract(substr(r, length(h0) + 1), '^[^?#]*') as path from raw),
    base as ({base}), pats as ({pats}),
    fits as (select rid, h || p as rule, action, row_number() over (partition by rid order by length(h || p) desc) as k
      from parts join base on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)),
    other as (select rid, min(pattern) as pattern from parts join pats on regexp_matches(host || path, rx) group by rid)
    select page_id, host, path, rule, pattern, coalesce(action, case when pattern is not null then 'block' end, 'allow') as verdict
    from parts left join (select * from fits where k = 1) f using (rid) left join other using (rid)"""
