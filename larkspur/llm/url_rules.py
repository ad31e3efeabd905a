"""URL filters: rules indexed by their rarest literal token.

A rule is a regular expression over `host + path` with the literal tokens (runs of a-z0-9, as whole
tokens) that every URL it fits must contain. The index files each rule under that one of its tokens
that the fewest rules use (ties: the alphabetically first). A URL's own tokens fetch the candidate
rules, and only those run their expression. All of it is SQL functions.

Up to INLINE rules are part of the plan: the index is a map literal, so there is neither a shuffle nor a join, and a hot host costs no more than its
rows. More rules, and rules that come as a DataFrame, are a written table by token: the distinct (host, path) of the URLs meet it token by token, and
the best rule of each comes back to the rows. That is two shuffles of URLs, none of other columns but in the last join; Spark broadcasts
the tables that it finds small and splits skewed partitions of the others (a token or a URL in a third of all rows). Rules without any literal token run on
every URL, either way. Both ways give the same rows.

Defined results: a null URL, or one without "://", has empty host and path, fits no rule and gets the
default verdict. Very long URLs are judged whole. Repeated rows are judged each. An empty rule list gives the default everywhere; an empty table
gives no rows. Columns named host, path, rule, verdict are replaced, those named __url_* dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

INLINE = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str  # "allow" or "block"
    pattern: str  # Java regular expression, found anywhere in host + path
    tokens: tuple[str, ...]  # whole tokens that each fitting URL has
    weight: int  # the heaviest fitting rule wins; ties go to the smaller name, then verdict


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits `host` and its subdomains where the URL's path starts with `path`."""
    closed = path if path.endswith("/") else path[: path.rfind("/") + 1]  # the last piece may go on
    tokens = tuple(dict.fromkeys(re.findall("[a-z0-9]+", f"{host}{closed}")))
    pattern = rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}"
    return Rule(host + path, verdict, pattern, tokens, len(host + path))


def token_rule(verdict: str, *words: str) -> Rule:
    """Fits where a label of the host has the words one after another, hyphenated or as labels."""
    pattern = r"^(?:[^/?#]*[.-])?" + "[.-]".join(map(re.escape, words)) + r"(?:[.:/-]|$)"
    return Rule("-".join(words), verdict, pattern, words, 0)


#: The method's own verdict where no given rule fits: hosts named for what they sell are blocked.
DEFAULT_RULES = [
    token_rule("block", *words)
    for words in (("casino",), ("free", "bets"), ("cheap", "pills"), ("adult",), ("spam",), ("ads",))
]


def index_of(rules: list[Rule]) -> dict[str, list[int]]:
    """Token to the numbers of the rules filed under it; "" for rules without a literal token."""
    used = Counter(t for r in rules for t in r.tokens)
    out: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        out.setdefault(min(r.tokens, key=lambda t: (used[t], t), default=""), []).append(i)
    return out


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _best(rules: list[Rule], host: Column, path: Column) -> Column:
    """Number of the fitting rule that wins, or null. Rules are numbered from the strongest down."""
    index = index_of(rules)
    lookup = F.create_map(*[x for t, ids in index.items() for x in (F.lit(t), F.array(*map(F.lit, ids)))])
    patterns = F.array(*[F.lit(r.pattern) for r in rules])
    text = F.concat(host, path)
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("([a-z0-9]+)"))))
    fetched = F.flatten(F.filter(F.transform(tokens, lambda t: F.try_element_at(lookup, t)), lambda x: x.isNotNull()))
    return F.array_min(F.filter(fetched, lambda i: F.regexp_like(text, F.get(patterns, i))))


def _pick(values: list[str], i: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), i)


def _has_host(url: str) -> Column:
    return F.col(url).isNotNull() & (F.instr(F.col(url), "://") > 0)


def _inline(df: DataFrame, rules: list[Rule], url: str, to: str) -> DataFrame:
    """df with the winning rule as a struct (name, verdict), or null, in column `to`."""
    ranked = sorted(rules, key=lambda r: (-r.weight, r.name, r.verdict))
    if not ranked:
        return df.withColumn(to, F.lit(None).cast("struct<name:string,verdict:string>"))
    df = df.withColumn(to, F.when(_has_host(url), _best(ranked, F.col("host"), F.col("path"))))
    name, verdict = _pick([r.name for r in ranked], F.col(to)), _pick([r.verdict for r in ranked], F.col(to))
    return df.withColumn(to, F.when(F.col(to).isNotNull(), F.struct(name.alias("name"), verdict.alias("verdict"))))


_RULE = "name string, verdict string, pattern string, tokens array<string>, weight int"


def filed(rules: DataFrame) -> DataFrame:
    """rules (columns as in Rule) once each, with the token that they are filed under; "" for rules without one."""
    own = rules.select(*[c.split()[0] for c in _RULE.split(", ")]).distinct()
    used = own.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    each = own.withColumn("token", F.explode_outer("tokens")).join(used, "token", "left")
    least = each.groupBy("name", "verdict", "pattern", "weight", "tokens").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    return least.select("name", "verdict", "pattern", "weight", F.coalesce("token", F.lit("")).alias("token"))


def _looked_up(df: DataFrame, rules: DataFrame, url: str, to: str) -> DataFrame:
    """_inline() through a written table of rules."""
    table = materialize(filed(rules), "url-rules")
    urls = df.filter(_has_host(url)).select(F.col("host").alias("__url_host"), F.col("path").alias("__url_path")).distinct()
    text = F.concat("__url_host", "__url_path")
    tokens = F.concat(F.array(F.lit("")), F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("([a-z0-9]+)")))
    met = urls.withColumn("token", F.explode(F.array_distinct(tokens))).join(table, "token").filter(F.regexp_like(text, F.col("pattern")))
    best = met.groupBy("__url_host", "__url_path").agg(F.min(F.struct((-F.col("weight")).alias("w"), "name", "verdict")).alias(to))
    best = best.withColumn(to, F.struct(F.col(to)["name"].alias("name"), F.col(to)["verdict"].alias("verdict")))
    same = (F.col("host") == F.col("__url_host")) & (F.col("path") == F.col("__url_path")) & _has_host(url)
    return df.join(best, same, "left").drop("__url_host", "__url_path")


def judge(df: DataFrame, rules: list[Rule] | DataFrame, default_rules: list[Rule] = DEFAULT_RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """df with host, path, rule, verdict (columns of these names are replaced). rules: a list, or a DataFrame with the columns of Rule."""
    df = df.drop(*[c for c in df.columns if c.startswith("__url_") and c != url])
    out = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    for some, to in ((rules, "__url_rule"), (default_rules, "__url_own")):
        if isinstance(some, list) and len(some) > INLINE:
            some = df.sparkSession.createDataFrame([(r.name, r.verdict, r.pattern, list(r.tokens), r.weight) for r in some], _RULE)
        out = _inline(out, some, url, to) if isinstance(some, list) else _looked_up(out, some, url, to)
    verdict = F.coalesce(F.col("__url_rule.verdict"), F.col("__url_own.verdict"), F.lit(default))
    return out.withColumns({"rule": F.col("__url_rule.name"), "verdict": verdict}).drop("__url_rule", "__url_own")
