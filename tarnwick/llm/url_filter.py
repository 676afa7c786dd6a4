"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern with * for any characters, ^ for a separator, | for either end of the URL, || for
the start of a host name, and @@ in front of an exception.  Letters and digits between separators of a
pattern are tokens that every URL it matches must have; the index keeps a rule under the one of them
that is rarest among all URLs.  The tokens of a URL fetch its candidate rules, and only those run as
regular expressions.  Rules without such a token run on every URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.session import BROADCAST_BYTES

#: Rules about kinds of pages, and names of services, as public lists have them.  Any others can be given instead.
DEFAULT_RULES = (
    "||doubleclick.net^", "||googlesyndication.com^", "||adserver.*^", "||ads.*^", "||casino*^", "||tracker.*^", "||cdn.ads.*^", "||popads.net^", "||login.*^", "||mail.*^",
    "/ads/*", "/banner/*", "/popup^", "/redirect?url=", "/track/*", "/pixel.gif|", "/affiliate/*", "/login^", "/signup^", "/cart^", "/checkout^", "/wp-admin/*", "/cgi-bin/*", "/search?q=", "/tag/*", "/feed/|", "/print/*",
    "?utm_source=feed|", "&utm_campaign=", "?utm_source=", "?sessionid=", "&sid=", "?ref=", "&ref=", "?page=", "?replytocom=", "#top|", "#comment-", ".exe|", ".zip|", ".pdf|", ".jpg|", ".php?id=",
    "porn", "xxx", "*viagra*", "*casino-bonus*", "free-download", "|ftp://", "//www2.", ":8080/",
    "@@||archive.org^", "@@/docs/", "@@/wiki/*", "@@/about|",
)

TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    rule_id: int
    block: bool
    regex: str
    tokens: tuple[str, ...]


def compile_rule(rule_id: int, pattern: str) -> Rule:
    """The regular expression (for the lower-cased URL) and the sure tokens of a pattern.  An empty pattern matches nothing."""
    block = not pattern.startswith("@@")
    p = pattern if block else pattern[2:]
    p = p.lower()
    host, start = p.startswith("||"), p.startswith("|")
    p = p[2:] if host else p[1:] if start else p
    end = p.endswith("|")
    p = p[:-1] if end else p
    body = "".join(".*" if c == "*" else "(?:[^a-z0-9_.%-]|$)" if c == "^" else re.sub(r"([^a-z0-9])", r"\\\1", c) if c.isascii() and not c.isspace() else c for c in p)
    head = r"^[a-z][a-z0-9+.-]*:\/\/(?:[^\/?#]*\.)?" if host else "^" if start else ""
    if not p:
        return Rule(rule_id, block, "[^\\s\\S]" if not (host or start or end) else head + ("$" if end else ""), ())
    tokens = []
    for m in re.finditer(TOKEN, p):
        left = p[m.start() - 1] != "*" if m.start() else host or start
        right = p[m.end()] != "*" if m.end() < len(p) else end
        if left and right:
            tokens.append(m.group())
    return Rule(rule_id, block, head + body + ("$" if end else ""), tuple(dict.fromkeys(tokens)))


def compile_rules(patterns: tuple[str, ...] = DEFAULT_RULES) -> list[Rule]:
    return [compile_rule(k, p) for k, p in enumerate(patterns)]


def rarest_tokens(urls: DataFrame, rules: list[Rule]) -> dict[str | None, list[Rule]]:
    """The rules by their rarest token; by None those that have none.

    The rules' tokens are counted over all URLs (the column u), in each of which a token counts once; ties go
    to the token that comes first in its rule.  Counts are added before they are shuffled, and there is one for each
    token of a rule at most.
    """
    words = sorted({t for r in rules for t in r.tokens})
    count: dict[str, int] = {}
    if words:
        spark = urls.sparkSession
        tokens = urls.select(F.explode(F.array_distinct(F.regexp_extract_all("u", F.lit(TOKEN), F.lit(0)))).alias("word"))
        known = spark.createDataFrame([(w,) for w in words], "known string")
        size = sum(map(len, words)) + 16 * len(words)
        seen = tokens.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, F.col("word") == F.col("known"), "left_semi").groupBy("word").count()
        count = {r["word"]: r["count"] for r in seen.collect()}
    index: dict[str | None, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: count.get(t, 0)) if r.tokens else None, []).append(r)
    return index


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, blocked, rules) of every row: the ids of all rules that match its URL, in order.

    blocked: a blocking rule matches, and no exception does.  The tokens of a URL fetch its candidates from
    the index of rules, which is broadcast (its size is that of the rules), in the task that reads the
    row, so no row is shuffled.

    Defined cases: a null or empty URL has no tokens; a null one matches no rule, an empty one only those
    that match the empty text; a null id is carried as it is; repeated rows are answered each; a very long
    URL is matched whole; rules that are alike match each; an empty table gives an empty result; without
    rules nothing is blocked; other columns, whatever their names, are not read.
    """
    rules = compile_rules() if rules is None else rules
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.lower(F.col(url_col)).alias("u"))
    index = pages.sparkSession.sparkContext.broadcast(rarest_tokens(urls, rules))
    token = re.compile(TOKEN)

    def matched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by = {t: [(r.rule_id, r.block, re.compile(r.regex)) for r in own] for t, own in index.value.items()}
        always = by.get(None, [])
        for b in batches:
            blocked, found = [], []
            for u in b.to_pylist():
                candidates = [] if u is None else [*always, *(r for t in set(token.findall(u)) & by.keys() for r in by[t])]
                hits = [r for r in candidates if r[2].search(u)]
                blocked.append(any(r[1] for r in hits) and all(r[1] for r in hits))
                found.append(sorted(r[0] for r in hits))
            yield pa.StructArray.from_arrays([pa.array(blocked, pa.bool_()), pa.array(found, pa.list_(pa.int32()))], ["blocked", "rules"])

    out = urls.withColumn("m", F.arrow_udf(matched, "struct<blocked boolean, rules array<int>>")("u"))
    return out.select("page_id", "url", "m.blocked", "m.rules")


def oracle(rules: list[Rule]) -> str:
    """The same in SQL, with every rule on every URL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({r.rule_id}, {str(r.block).lower()}, {quote(r.regex)})" for r in rules)
    return f"""
WITH rules(rule_id, block, regex) AS (VALUES {values}),
urls AS (SELECT row_number() OVER () AS k, page_id, url FROM pages),
hits AS (SELECT k, page_id, url, rule_id, block FROM urls LEFT JOIN rules ON regexp_matches(lower(url), regex))
SELECT page_id, url, coalesce(bool_or(block), false) AND coalesce(bool_and(block), true) AS blocked,
  coalesce(list_sort(list(rule_id) FILTER (WHERE rule_id IS NOT NULL)), []) AS rules
FROM hits GROUP BY k, page_id, url
"""
