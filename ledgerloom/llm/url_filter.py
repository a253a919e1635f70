"""URL filters: pattern rules, indexed by their rarest literal token.

A URL's tokens are its runs of letters and digits, lower-cased. Each rule is a regular expression and the literal
tokens that every URL it matches must have, whole; the rule is filed under the one of them that the fewest URLs have.
A URL's tokens fetch the rules filed under them, and only these rules' expressions run on it. Rules without a literal
token run on every URL. The rule table is broadcast only if it measures few bytes.

Host: behind the first :// up to /, ? or #, A-Z lower-cased; path: then up to ? or #. A host rule (host, path) fits its
host and all subdomains where the URL's path starts with the rule's path; the longest host rule that fits decides. If
none fits, pattern rules decide: one that allows wins over those that block. Else the URL is allowed.

Pattern rules come from lines of a filter list (filter_rules()): * stands for anything, ^ for a character that separates
or the end, | for the start or end of the URL, || for the start of the host or of a label in it, @@ in front allows;
/.../ is a regular expression. Matching ignores case unless $match-case is behind. Lines that begin with ! are comments.

Cases: null URLs and those without :// have empty host and path and no host rule, and are allowed unless a pattern
matches; repeated rows are judged alike, one row each; extra columns are left out; no rules: all is allowed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a rule table up to which it is broadcast.
BROADCAST_BYTES = 16 << 20
_TOKEN = re.compile(r"[a-z0-9]+")
#: The host rules of the query (host, path, verdict).
HOST_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Words that, alone between separators of a host or path, block a URL that no host rule decides.
BLOCK_WORDS = ["adult", "casino", "gambling", "phishing", "porn", "spam", "viagra", "warez", "xxx"]
#: The filter list of the query.
FILTERS = ["! advertising and tracking", "||ads.", "||tracker.", "/banner/*", "^popup^", "@@||example.org^*/about/"]
#: What ^ and || stand for.
_SEPARATOR, _LABEL = r"(?:[^A-Za-z0-9_.%\-]|$)", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*\.)?"


def _rest(url: Column) -> Column:
    """What stands behind the first ://; empty without it."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def host_rule(host: str, path: str, verdict: str) -> dict:
    """A host rule as a pattern over host, NUL, path: any subdomain of the host, any path that starts so."""
    whole = path if not path or not path[-1].isalnum() else path[: len(path) - len(re.search(r"[A-Za-z0-9]*$", path)[0])]  # the last token may go on
    tokens = sorted(set(_TOKEN.findall(host.lower())) | set(_TOKEN.findall(whole.lower())))
    return {"rule": f"{host}{path}", "verdict": verdict, "kind": "host", "pattern": rf"^(?:[^\x00]*\.)?{re.escape(host)}\x00{re.escape(path)}", "tokens": tokens}


def word_rule(word: str) -> dict:
    """Blocks hosts and paths that hold the word alone."""
    return {"rule": word, "verdict": "block", "kind": "word", "pattern": rf"(?i)(?<![A-Za-z0-9]){re.escape(word)}(?![A-Za-z0-9])", "tokens": [word.lower()]}


def filter_rule(line: str) -> dict | None:
    """The rule of a line of a filter list; None for blank lines and comments. Raises ValueError for options that it doesn't know."""
    rule = line.strip()
    if not rule or rule.startswith("!"):
        return None
    allows, body = rule.startswith("@@"), rule.removeprefix("@@")
    case = ""
    if not (body.startswith("/") and body.endswith("/") and len(body) > 1) and "$" in body:
        body, _, options = body.rpartition("$")
        if set(options.split(",")) - {"match-case"}:
            raise ValueError(f"options of {rule}")
        case = options
    out = {"rule": rule, "verdict": "allow" if allows else "block", "kind": "url"}
    flags = "(?s)" if case else "(?is)"
    if body.startswith("/") and body.endswith("/") and len(body) > 2 and not re.fullmatch(r"/[A-Za-z0-9_\-/]*/", body):
        return out | {"pattern": flags + body[1:-1], "tokens": []}
    head = "||" if body.startswith("||") else "|" if body.startswith("|") else ""
    tail = "|" if body.endswith("|") and len(body) > len(head) else ""
    middle = body[len(head) : len(body) - len(tail)]
    parts = {"*": ".*", "^": _SEPARATOR}
    pattern = {"||": _LABEL, "|": "^", "": ""}[head] + "".join(parts.get(c) or re.escape(c) for c in middle) + ("$" if tail else "")
    # a token is whole in each URL only if what stands beside it is fixed, too
    edges = ("." if head else "*") + middle + ("." if tail else "*")
    tokens = {m[0].lower() for m in re.finditer(r"(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])", edges)}
    return out | {"pattern": flags + pattern, "tokens": sorted(tokens)}


def filter_rules(lines: list[str]) -> list[dict]:
    return [r for r in map(filter_rule, lines) if r]


RULES = "rule string, verdict string, kind string, pattern string, tokens array<string>"


def judge(pages: DataFrame, rules: list[dict] | DataFrame, *, id_col: str = "page_id", url_col: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, host, path, rule (of the host rule that decides, else null), pattern_rule (the pattern rule that decides, else null), verdict."""
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame([tuple(r[k] for k in ("rule", "verdict", "kind", "pattern", "tokens")) for r in rules], RULES)
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    # equal URLs are judged once
    site = urls.where("url is not null").select("url").distinct().withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    # the empty token stands for rules without a literal one
    tokens = F.array_distinct(F.concat(F.split(F.translate("url", UPPER, LOWER), "[^a-z0-9]+"), F.array(F.lit(""))))
    size = table.select(F.sum(F.length(F.to_json(F.struct("*")))).alias("n")).first()["n"] or 0
    small = F.broadcast if size <= broadcast_bytes else (lambda df: df)
    table = table.withColumn("rule_id", F.xxhash64("rule", "kind", "pattern"))
    literal = table.select("rule_id", F.explode("tokens").alias("token"))
    counts = site.select(F.explode(tokens).alias("token")).join(small(literal.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    filed = literal.join(counts, "token", "left").groupBy("rule_id").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token"))["token"].alias("token"))
    index = table.join(filed, "rule_id", "left").select("rule", "verdict", "kind", "pattern", F.coalesce("token", F.lit("")).alias("token"))
    fetched = site.select("url", "host", "path", F.explode(tokens).alias("token")).join(small(index), "token").drop("token")
    subject = F.when(F.col("kind") == "url", F.col("url")).otherwise(F.concat_ws("\0", "host", "path"))
    matched = fetched.where(F.regexp(subject, F.col("pattern")))
    host, allows = F.col("kind") == "host", F.col("verdict") == "allow"
    best = matched.groupBy("url").agg(
        F.max(F.when(host, F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("h"),
        F.min(F.when(~host, F.struct((~allows).alias("after"), "rule", "verdict"))).alias("p"),
    )
    told = urls.where("url is not null").join(best, "url", "left").unionByName(urls.where("url is null"), allowMissingColumns=True)
    verdict = F.coalesce("h.verdict", "p.verdict", F.lit("allow"))
    return told.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("h.rule").alias("rule"), F.when(F.col("h").isNull(), F.col("p.rule")).alias("pattern_rule"), verdict.alias("verdict"))
