"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is compiled to a regular expression and filed under the one of its literal tokens that
the fewest URLs hold (counted over all URLs).  A URL's tokens fetch the rules filed under them;
only those run their expressions.

Rules are a list or a table.  Up to ``broadcast_rules`` of them go to the tasks as one index and the
URLs are judged in a single narrow pass.  More of them stay a table that is joined with the tokens
of the distinct URLs; rules without a literal token, which have to be tried on every URL, are then
tried in narrow passes of at most ``broadcast_rules`` of them.

Defined cases: a null URL or one without ``://`` has an empty host and path and is allowed; null ids
are kept; equal rules and rows that repeat a URL get equal verdicts; URLs of any length are judged
whole; ties of length go to the earlier rule; an empty rule list allows everything; other columns
are kept, an older result column of the same name is replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidgraph.plans.storage import materialize

BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``regex`` runs on host + path; ``tokens`` stand in every URL that it matches."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    is_base: bool


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """A host with its subdomains, under a path prefix."""
    name = host + path
    tokens = re.findall(TOKEN, name.lower())
    if tokens and re.search(f"{TOKEN}$", name.lower()):
        tokens.pop()  # the last run may go on in the URL
    return Rule(name, verdict, rf"^(?:[^/?#]*\.)?{re.escape(name)}", tuple(tokens), True)


def pattern_rule(verdict: str, pattern: str) -> Rule:
    """A host pattern: ``^`` is an end of the host or a character that is no letter or digit, ``*`` any characters."""
    regex = "".join({"^": "(?:^|[^a-z0-9/]|(?=/)|$)", "*": "[^/]*"}.get(c, re.escape(c)) for c in pattern)
    return Rule(pattern, verdict, rf"^(?=[^/]*(?:{regex}))", tuple(re.findall(rf"(?<=[^a-z0-9*]){TOKEN}(?=[^a-z0-9*])", pattern)), False)


#: The base rules.
BASE_RULES = (
    prefix_rule("allow", "com", "/"),
    prefix_rule("block", "example.com", "/en/"),
    prefix_rule("allow", "www.example.com", "/en/"),
    prefix_rule("block", "net", "/es/"),
    prefix_rule("block", "net", "/fr/"),
)
#: Host words of betting, adult, pill, spam and tracking sites.
BLOCKED_WORDS = ("casino", "poker", "bets", "betting", "adult", "porn", "xxx", "pills", "viagra", "spam", "warez", "malware", "phishing")
PATTERN_RULES = tuple(pattern_rule("block", f"^{w}^") for w in BLOCKED_WORDS) + (pattern_rule("block", "^ads^track"), pattern_rule("block", "^ad^server^"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(subject, UPPER, LOWER), F.lit(f"({TOKEN})"), 1))


def _filed(rules: Sequence[Rule], subjects: DataFrame) -> list[str | None]:
    """The rarest literal token of each rule, by the URLs that hold it; None if it has none."""
    words = sorted({t for r in rules for t in r.tokens})
    wanted = subjects.sparkSession.createDataFrame([(w,) for w in words], "token string")
    if len(words) <= BROADCAST_RULES:
        wanted = F.broadcast(wanted)
    held = subjects.select(F.explode(_tokens(F.col("subject"))).alias("token")).join(wanted, "token").groupBy("token").count()
    count = {r.token: r["count"] for r in held.toLocalIterator()}
    return [min(r.tokens, key=lambda t: (count.get(t, 0), t)) if r.tokens else None for r in rules]


def _rank(rule: Rule, position: int) -> tuple:
    """Base rules before patterns, then the longest, then the earliest."""
    return (rule.is_base, len(rule.name), -position)


def _judge_batches(index: dict, always: list, rules: Sequence[Rule]):
    token = re.compile(TOKEN)

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled: dict[int, re.Pattern] = {}

        def fits(k: int, subject: str) -> bool:
            if k not in compiled:
                compiled[k] = re.compile(rules[k].regex)
            return compiled[k].search(subject) is not None

        for subjects in batches:
            out = []
            for subject in subjects:
                candidates = {k for t in set(token.findall(subject.translate(_ASCII_LOWER))) for k in index.get(t, ())} | set(always)
                best = max((k for k in candidates if fits(k, subject)), key=lambda k: _rank(rules[k], k), default=None)
                rule = rules[best] if best is not None else None
                out.append((rule.name if rule and rule.is_base else None, rule.name if rule and not rule.is_base else None, rule.verdict if rule else "allow"))
            yield pd.DataFrame(out, columns=["rule", "pattern", "verdict"])

    return judge


_ASCII_LOWER = str.maketrans(UPPER, LOWER)
_RESULT = T.StructType([T.StructField(n, T.StringType()) for n in ("rule", "pattern", "verdict")])


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def _compile(rows: pd.DataFrame) -> list[Rule]:
    return [pattern_rule(r.verdict, r.pattern) if isinstance(r.pattern, str) else prefix_rule(r.verdict, r.host or "", r.path or "") for r in rows.itertuples(index=False)]


_TABLE = "k long, name string, verdict string, regex string, tokens array<string>, is_base boolean, size int"


def _table_rows(positions, rules: Sequence[Rule]) -> list[tuple]:
    return [(int(k), r.name, r.verdict, r.regex, list(dict.fromkeys(r.tokens)), r.is_base, len(r.name)) for k, r in zip(positions, rules)]


def rule_table(rules: DataFrame) -> DataFrame:
    """Compiled rules of (position, verdict, host, path, pattern): a pattern, or else a host and a path prefix."""

    def compiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame(_table_rows(rows["position"], _compile(rows)), columns=[c.split()[0] for c in _TABLE.split(", ")])

    return rules.select("position", "verdict", "host", "path", "pattern").mapInPandas(compiled, _TABLE)


def _listed(table: DataFrame) -> list[Rule]:
    return [Rule(r.name, r.verdict, r.regex, tuple(r.tokens), r.is_base) for r in table.orderBy("k").collect()]


def judge_urls(pages: DataFrame, url_col: str = "url", rules: Sequence[Rule] | DataFrame = BASE_RULES + PATTERN_RULES, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``pages`` with host, path, rule (a base rule's name), pattern and verdict.

    ``rules``: a list, or a table as of ``rule_table``.
    """
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        table = rules
        rules = _listed(table) if table.count() <= broadcast_rules else None
    else:
        rules = list(rules)
        table = spark.createDataFrame(_table_rows(range(len(rules)), rules), _TABLE)
    if rules is None or len(rules) > broadcast_rules:
        return _judge_by_join(pages, url_col, table, broadcast_rules)
    host, path = host_and_path(F.col(url_col))
    filed = _filed(rules, pages.select(F.concat(host, path).alias("subject")))
    index: dict[str, list[int]] = defaultdict(list)
    for k, word in enumerate(filed):
        if word is not None:
            index[word].append(k)
    judge = F.pandas_udf(_judge_batches(dict(index), [k for k, w in enumerate(filed) if w is None], rules), _RESULT)
    name = _free("judged", pages.columns)
    judged = pages.withColumn(name, judge(F.concat(host, path)))
    return judged.select(*_kept(pages), host.alias("host"), path.alias("path"), f"{name}.rule", f"{name}.pattern", f"{name}.verdict")


def _kept(pages: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "pattern", "verdict")]


def _judge_by_join(pages: DataFrame, url_col: str, table: DataFrame, limit: int) -> DataFrame:
    """Rules as a table: every token of a URL is joined with the rules filed under it."""
    host, path = host_and_path(F.col(url_col))
    subjects = materialize(pages.select(F.concat(host, path).alias("subject")).distinct(), "subjects")
    words = table.select("k", F.explode("tokens").alias("token"))
    tokens = subjects.select("subject", F.explode(_tokens(F.col("subject"))).alias("token"))
    held = tokens.join(words.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = words.join(held, "token", "left").groupBy("k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r"))
    filed = materialize(table.join(rarest.select("k", F.col("r.token").alias("token")), "k", "left").drop("tokens"), "rules")
    rank, said = F.struct("is_base", "size", (-F.col("k")).alias("earlier")).alias("rank"), F.struct("name", "verdict", "is_base").alias("best")
    found = tokens.join(filed.where("token IS NOT NULL"), "token").where(F.expr("subject rlike regex")).select("subject", rank, said)
    loose = filed.where("token IS NULL")
    parts = -(-loose.count() // max(1, limit))
    for part in range(parts):
        rules = loose.where(F.pmod(F.col("k"), F.lit(parts)) == part).orderBy("k").collect()  # about ``limit`` rules
        found = found.unionByName(_tried(subjects, rules).select("subject", "hit.rank", "hit.best"))
    best = found.groupBy("subject").agg(F.max_by("best", "rank").alias("best"))
    key, name = _free("subject", pages.columns), _free("best", pages.columns)
    joined = pages.withColumn(key, F.concat(host, path)).join(best.select(F.col("subject").alias(key), F.col("best").alias(name)), key, "left")
    is_base = F.col(f"{name}.is_base")
    return joined.select(*_kept(pages), host.alias("host"), path.alias("path"), F.when(is_base, F.col(f"{name}.name")).alias("rule"), F.when(~is_base, F.col(f"{name}.name")).alias("pattern"), F.coalesce(f"{name}.verdict", F.lit("allow")).alias("verdict"))


def _tried(subjects: DataFrame, rules: list) -> DataFrame:
    """(subject, hit) of the best of a few rules that fits each subject."""
    ordered = sorted(rules, key=lambda r: (r.is_base, r["size"], -r.k), reverse=True)
    hit = "rank struct<is_base boolean, size int, earlier long>, best struct<name string, verdict string, is_base boolean>"

    @F.pandas_udf(hit)
    def first(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled = [re.compile(r.regex) for r in ordered]
        for urls in batches:
            held = [next((r for r, c in zip(ordered, compiled) if c.search(u)), None) for u in urls]
            yield pd.DataFrame(
                {
                    "rank": [r and {"is_base": r.is_base, "size": r["size"], "earlier": -r.k} for r in held],
                    "best": [r and {"name": r.name, "verdict": r.verdict, "is_base": r.is_base} for r in held],
                }
            )

    return subjects.select("subject", first("subject").alias("hit")).where("hit.rank IS NOT NULL")


ORACLE = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts
), rules(host_rule, path_rule, said) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT page_id, host, path, host_rule || path_rule AS rule, said FROM split LEFT JOIN rules
    ON (host = host_rule OR ends_with(host, '.' || host_rule)) AND starts_with(path, path_rule)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS place FROM fits
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN said
            WHEN regexp_matches(host, '(^|[^a-z0-9])({"|".join(BLOCKED_WORDS)})([^a-z0-9]|$)')
              OR regexp_matches(host, '(^|[^a-z0-9])ads[^a-z0-9]track')
              OR regexp_matches(host, '(^|[^a-z0-9])ad[^a-z0-9]server([^a-z0-9]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM best WHERE place = 1
"""
