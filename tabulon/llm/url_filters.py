"""URL filters: rules indexed by their rarest literal token, fetched by the tokens of a URL, and only then matched."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import columns_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host and path rules: (host/path, verdict).
SITE_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Words that block a URL which no host and path rule fits, wherever they stand as a token of it.
BLOCKED_WORDS = ("casino", "porn", "xxx", "viagra", "torrent", "warez", "phishing", "malware")


#: Rules up to this number are literals of the plan; more are a table that URLs' tokens are joined with.
LITERAL_RULES = 1_000
#: Rules of a broadcast table at most; beyond, the join shuffles.
BROADCAST_RULES = 1_000_000
_RULE = "token string, rank int, rule string, verdict string, host string, path string, word string"


def _quoted(text: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else "\\" + c if c.isascii() else c for c in text)


def _words(text: str) -> list[str]:
    return [x for x in re.split("[^0-9a-z]+", "".join(c.lower() if c.isascii() else c for c in text)) if x]


def site_rule(rule: str, verdict: str) -> tuple:
    """(rule, verdict, rank, literal tokens, expressions over host, path and both): a host with its subdomains and a path prefix.

    A URL can go on where the prefix ends, so what follows its last sign that is no letter or digit is no whole token.
    """
    host, slash, path = rule.partition("/")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    whole = re.sub("[0-9A-Za-z]+$", "", path)
    return rule, verdict, 1000 + len(rule), [*_words(host), *_words(whole)], rf"(?s)\A(.*\.)?{_quoted(host)}\z", rf"\A{_quoted(slash + path)}", None


def word_rule(word: str) -> tuple:
    """A rule that blocks URLs with a word as a token; it has no name, and any host and path rule outranks it."""
    return None, "block", 0, [word], None, None, rf"(?i)(^|[^0-9a-z]){_quoted(word)}([^0-9a-z]|$)"


def default_rules() -> list[tuple]:
    return [site_rule(*x) for x in SITE_RULES] + [word_rule(x) for x in BLOCKED_WORDS]


def url_parts(pages: DataFrame) -> DataFrame:
    """page_id, host and path: what follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; then up to '?', '#' or the end."""
    rest = F.regexp_extract(F.coalesce(pages["url"], F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return pages.select("page_id", F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER).alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))


def _fits(rule: Column) -> Column:
    """Whether a rule fits the row's host and path; parts of it that are null fit anything."""
    both = F.concat_ws(" ", "host", "path")
    parts = ((F.col("host"), rule["host"]), (F.col("path"), rule["path"]), (both, rule["word"]))
    host, path, word = (F.coalesce(F.regexp_like(x, y), F.lit(True)) for x, y in parts)
    return host & path & word


def url_filter(pages: DataFrame, rules: Iterable[tuple] | None = None) -> DataFrame:
    """Judge URLs by pattern rules.

    Input: page_id and url; other columns are ignored. rules: tuples as site_rule() and word_rule() make them; every
    rule needs a literal token (ASCII letters and digits) that stands as a whole token in each URL it fits. Returns a
    row for each input row, repeated ones too: page_id, host, path, rule (the host and path rule that decided, longest
    first, else null) and verdict: its verdict, else block where a word rule fits, else allow. A host can hold any sign but
    / ? and #, white space too, and a URL can be of any length. A null url or one without '://' has empty host and path,
    fits nothing and is allowed; so is a url without rules; an empty table gives an empty result.

    The index maps a token to rules: each rule stands under the one of its tokens that the fewest URLs have (ties: the
    first by name); these frequencies are counted over all pages by an aggregation that keeps only tokens of rules. Each
    URL's distinct tokens fetch candidate rules, and regular expressions run on those alone. Up to LITERAL_RULES rules the
    index is a literal of the plan, and the best fit is found inside the row, so URLs don't move. More rules are a table,
    broadcast up to BROADCAST_RULES: distinct hosts and paths are joined with it by token, and the best fit of each is
    joined back.
    """
    spark = pages.sparkSession
    rules = list(default_rules() if rules is None else rules)
    if any(not r[3] for r in rules):
        raise ValueError("a rule needs a literal token")
    parts = url_parts(columns_of(pages, "page_id", "url"))
    if not rules:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    small = len(rules) <= LITERAL_RULES
    own = F.array_distinct(F.split(F.translate(F.concat_ws(" ", "host", "path"), UPPER, LOWER), "[^0-9a-z]+"))
    words = sorted({t for r in rules for t in r[3]})
    if small:
        seen = parts.select(F.explode(F.array_intersect(own, F.array(*[F.lit(w) for w in words]))).alias("token"))
    else:
        wanted = spark.createDataFrame([(w,) for w in words], "token string")
        seen = parts.select(F.explode(own).alias("token")).join(F.broadcast(wanted) if len(words) <= BROADCAST_RULES else wanted, "token")
    # a row for each token of the rules at most, as many as the rules, which are on the driver, have
    often = {r["token"]: r["count"] for r in seen.groupBy("token").count().collect()}
    index = [(min(r[3], key=lambda t: (often.get(t, 0), t)), r[2], r[0], r[1], *r[4:]) for r in rules]
    names = [c.split()[0] for c in _RULE.split(", ")]
    if not small:
        known = spark.createDataFrame(index, _RULE).select("token", F.struct(*names[1:]).alias("r"))
        urls = parts.select("host", "path").distinct().withColumn("token", F.explode(own))
        fits = urls.join(F.broadcast(known) if len(rules) <= BROADCAST_RULES else known, "token").where(_fits(F.col("r")))
        best = fits.groupBy("host", "path").agg(F.max(F.struct("r.rank", "r.rule", "r.verdict")).alias("best"))
        parts = parts.join(best, ["host", "path"], "left")
    else:
        by_token: dict[str, list[tuple]] = {}
        for token, *rest in index:
            by_token.setdefault(token, []).append(rest)
        entry = lambda r: F.struct(*[F.lit(x).cast("int" if c == "rank" else "string").alias(c) for c, x in zip(names[1:], r, strict=True)])
        lit = F.create_map(*[x for t, rs in sorted(by_token.items()) for x in (F.lit(t), F.array(*map(entry, rs)))])
        fetched = F.flatten(F.transform(F.array_intersect("tokens", F.map_keys(lit)), lambda t: lit[t]))
        # the highest rank, then the name, so that ties have one answer
        best = F.array_max(F.transform(F.filter(fetched, _fits), lambda r: F.struct(r["rank"], r["rule"], r["verdict"])))
        parts = parts.withColumn("tokens", own).withColumn("best", best)
    return parts.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def oracle() -> str:
    """The same in DuckDB's SQL, rule by rule."""
    fits = "(p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath)"
    rules = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for r, v in SITE_RULES)
    word = "|".join(BLOCKED_WORDS)
    return f"""
with rules(rhost, rpath, rule, verdict) as (values {rules}),
u as (select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
best as (select p.page_id, p.host, p.path, max_by(r.rule, length(r.rule)) as rule, max_by(r.verdict, length(r.rule)) as verdict
         from p left join rules r on {fits} group by all)
select page_id, host, path, rule,
       coalesce(verdict, case when regexp_matches(host || ' ' || path, '(?i)(^|[^0-9a-z])({word})([^0-9a-z]|$)') then 'block' else 'allow' end) as verdict
from best"""
