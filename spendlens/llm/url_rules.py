"""URL filters (operator 11): pattern rules indexed by their rarest literal token.

Two kinds of rules. A *host rule* is a host and the start of a path (``example.org/es/``) and holds for that host and all
hosts below it. A *pattern* is searched for in the url in lower case: ``*`` stands for any characters, ``^`` for a
separator or the end, ``|`` at an end ties it to that end of the url, ``||`` at the start to the start of a host's label.

Each rule is filed under one of the tokens that a url must hold for the rule to fit, the one that the fewest urls hold.
The tokens of a url fetch candidate rules, and only those run their regular expressions. A rule without such a token is
filed under the empty token, which every url has. Of the rules that fit, host rules go before patterns, patterns that
allow before patterns that block, then the longest rule wins, then the first in order of text. Without any the url is
allowed.

All of it is column expressions. Up to ``inline_rules`` rules go into the plan as a hash table of tokens, so that urls are
judged where they are read, without a shuffle; more rules are joined with the tokens of urls instead, salted, as some
tokens are in every url.

NULL urls, and urls without ``://``, have an empty host and path; a NULL url has no token but the empty one. Repeated rows,
rows without a ``page_id``, empty and very long urls are judged like all others; an empty table gives an empty result.
Rules that are NULL or empty fit nothing, repeated rules count once. Further columns are ignored.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.common import columns

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters between tokens: all of ASCII but digits and small letters.
GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: What ``^`` stands for, besides the end: all of ASCII but letters, digits and ``%-._``.
BORDER = r"(?:[\x00-\x24\x26-\x2C\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]|\z)"
SALTS = 16

#: Host rules (fixed values).
HOST_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
              ("com/de/", "block")]
#: Patterns of pages that are no prose, or not worth reading.
PATTERNS = [
    ("-pills.", "block"), ("||pills.", "block"), ("spam-farm.", "block"), ("||casino*.", "block"), ("-casino.", "block"),
    (".bet^", "block"), ("||ads.", "block"), ("||adserver.", "block"), ("/wp-login.php", "block"), ("/wp-admin^", "block"),
    ("/login^", "block"), ("/logout^", "block"), ("/signup^", "block"), ("/cart^", "block"), ("/checkout^", "block"),
    ("/cgi-bin/", "block"), ("?sessionid=", "block"), ("&sessionid=", "block"), ("?replytocom=", "block"),
    ("/calendar/*/*/", "block"), (".jpg|", "block"), (".png|", "block"), (".zip|", "block"), (".exe|", "block"),
    ("/robots.txt|", "block"), ("||docs.*/login^", "allow"), ("/help/*/login^", "allow"),
]


def default_rules(spark: SparkSession) -> DataFrame:
    """rule, verdict, is_host of the rules above."""
    return spark.createDataFrame([(r, v, True) for r, v in HOST_RULES] + [(r, v, False) for r, v in PATTERNS],
                                 "rule string, verdict string, is_host boolean")


def small(text: Column) -> Column:
    """``text`` with A-Z lower-cased, and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def after_scheme(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://(.*+)", 1)


def host(url: Column) -> Column:
    return small(F.regexp_extract(after_scheme(url), r"\A[^/?#]*+", 0))


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"\A[^/?#]*+([^?#]*+)", 1)


def tokens(url: Column) -> Column:
    """The distinct tokens of a url in lower case, the empty one included."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.coalesce(small(url), F.lit("")), f"[{GAP}]+")))


def located(pages: DataFrame) -> DataFrame:
    """page_id and url with what rules look at: host, path, where (both) and the url in lower case."""
    return columns(pages, "page_id", "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}) \
        .withColumns({"where": F.concat("host", "path"), "lowered": F.coalesce(small(F.col("url")), F.lit(""))})


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.+?$|(){}\[\]*^#&~-])", r"\\$1")


def host_expression(rule: Column) -> Column:
    """Regular expression over host and path."""
    bound = F.when(rule.contains("/"), F.lit("")).otherwise(F.lit(r"(?=/|\z)"))
    name = small(F.regexp_extract(rule, r"(?s)\A[^/]*+", 0))
    rest = F.regexp_extract(rule, r"(?s)\A[^/]*+(.*+)", 1)
    return F.concat(F.lit(r"(?s)\A(?:[^/]*\.)?"), escaped(name), escaped(rest), bound)


def pattern_expression(pattern: Column) -> Column:
    """Regular expression over the url in lower case.

    The parts between stars are looked for one after the other, each at its first place, which is enough for such patterns
    and takes linear time.
    """
    low = small(pattern)
    body = F.regexp_replace(F.regexp_replace(low, r"\A\|\|?", ""), r"\|\z", "")
    parts = F.transform(F.split(body, r"\*+"), lambda p: F.replace(escaped(p), F.lit(r"\^"), F.lit(BORDER)))
    ended, size = low.rlike(r"(?s).\|\z"), F.size(parts)
    start = F.when(low.startswith("||"), F.lit(r"(?:[^:/?#]*+://)(?:[^/?#]*?\.)??")).when(low.startswith("|"), F.lit("")) \
        .otherwise(F.lit(".*?"))

    def part(p: Column, i: Column) -> Column:
        last = ended & (i == size - 1)
        skip = F.when(i > 0, F.when(last, F.lit(".*")).otherwise(F.lit(".*?"))).otherwise(
            F.when(last & (start == ".*?"), F.lit(".*")).otherwise(start))
        return F.concat(F.lit("(?>"), skip, p, F.when(last, F.lit(r"\z")).otherwise(F.lit("")), F.lit(")"))

    return F.concat(F.lit(r"(?s)\A"), F.array_join(F.transform(parts, part), ""))


def literal_tokens(rule: Column, is_host: Column) -> Column:
    """Tokens that any url holds for which the rule fits: those with a border on both sides in the rule itself."""
    low = small(rule)
    whole = F.concat(F.lit("/"), low, F.when(low.contains("/"), F.lit("")).otherwise(F.lit("/")))
    ends = F.regexp_replace(F.regexp_replace(low, r"\A\|\|?", "/"), r"\|\z", "/")
    text = F.when(is_host, whole).otherwise(F.translate(ends, "*^", "Ā/"))  # a star borders like a letter
    return F.array_distinct(F.filter(
        F.regexp_extract_all(text, F.lit(rf"(?<=[{GAP}])[^{GAP}]+(?=[{GAP}])"), F.lit(0)), lambda t: ~t.contains("Ā")))


def compiled(rules: DataFrame) -> DataFrame:
    """rule, verdict, is_host, level (lower ones win), size, expression and literal tokens of each rule."""
    known = columns(rules, "rule", "verdict", "is_host").where("rule <> '' and verdict is not null").distinct()
    flag = F.coalesce(F.col("is_host"), F.lit(False))
    return known.select(
        "rule", "verdict", flag.alias("is_host"),
        F.when(flag, 0).when(F.col("verdict") == "allow", 1).otherwise(2).alias("level"),
        F.length("rule").alias("size"),
        F.when(flag, host_expression(F.col("rule"))).otherwise(pattern_expression(F.col("rule"))).alias("expression"),
        literal_tokens(F.col("rule"), flag).alias("tokens"))


def filed(rules: DataFrame, urls: DataFrame, few: list[str] | None) -> DataFrame:
    """Compiled ``rules`` with ``token``, the rarest in ``urls`` of their tokens; ``few`` are all tokens of the rules, if known."""
    seen = urls.select(F.explode(tokens(F.col("url"))).alias("token"))
    seen = seen.where(F.col("token").isin(few)) if few is not None else seen.join(
        rules.select(F.explode("tokens").alias("token")).distinct(), "token", "left_semi")
    counts = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = rules.select("rule", "verdict", "is_host", F.explode("tokens").alias("token")) \
        .join(counts, "token", "left").groupBy("rule", "verdict", "is_host") \
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    return rules.drop("tokens").join(rarest, ["rule", "verdict", "is_host"], "left").fillna("", ["token"])


FOUND = "level int, size int, rule string, verdict string"


def fits(entry: Column | None = None) -> Column:
    """Whether the regular expression of an index entry (or joined rule) matches a located url."""
    part = (lambda name: F.col(name)) if entry is None else (lambda name: entry[name])
    return F.regexp_like(F.when(part("is_host"), F.col("where")).otherwise(F.col("lowered")), part("expression"))


def ranked(entry: Column | None = None) -> Column:
    """What the smallest of is the rule that decides."""
    part = (lambda name: F.col(name)) if entry is None else (lambda name: entry[name])
    return F.struct(part("level").cast("int").alias("level"), (-part("size")).cast("int").alias("size"), part("rule").alias("rule"),
                    part("verdict").alias("verdict"))


def inline(urls: DataFrame, rows: list) -> DataFrame:
    """``urls`` with the deciding rule, looked up in a hash table of tokens that is part of the plan."""
    entry = "struct<token:string,level:int,size:int,rule:string,verdict:string,is_host:boolean,expression:string>"
    places: list[list] = [[] for _ in range(2 * len(rows) + 1)]
    for r in rows:
        places[crc32(r["token"].encode()) % len(places)].append(F.struct(*[
            F.lit(r[k]).alias(k) for k in ("token", "level", "size", "rule", "verdict", "is_host", "expression")]))
    index = F.array(*[F.array(*p).cast(f"array<{entry}>") for p in places])

    def candidates(token: Column) -> Column:
        place = F.get(index, (F.crc32(token.cast("binary")) % len(places)).cast("int"))
        return F.filter(place, lambda e: (e["token"] == token) & fits(e))

    fetched = F.flatten(F.transform(tokens(F.col("url")), candidates))
    return urls.withColumn("found", F.array_min(F.transform(fetched, ranked)).cast(f"struct<{FOUND.replace(' ', ':').replace(',:', ',')}>"))


def joined(urls: DataFrame, index: DataFrame) -> DataFrame:
    """``urls`` with the deciding rule, by joins on tokens, then on the url; both salted."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    keyed = urls.withColumn("key", F.coalesce("url", F.lit(""))).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    fetched = keyed.select("key", "where", "lowered", "salt", F.explode(tokens(F.col("url"))).alias("token")) \
        .join(index.select("*", salts), ["token", "salt"]).where(fits())
    hits = fetched.groupBy("key").agg(F.min(ranked()).alias("found"))
    spread = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return spread.join(hits.select("*", salts), ["key", "salt"], "left")


def judge(pages: DataFrame, rules: DataFrame | None = None, inline_rules: int = 2000) -> DataFrame:
    """page_id, host, path, rule (a host rule), verdict and pattern (where a pattern decided) of each page's url."""
    urls = located(pages)
    made = compiled(default_rules(pages.sparkSession) if rules is None else rules)
    rows = made.limit(inline_rules + 1).collect()
    if len(rows) <= inline_rules:
        few = sorted({t for r in rows for t in r["tokens"]})
        found = inline(urls, sorted(filed(made, urls, few).collect()) if rows else [])
    else:
        found = joined(urls, filed(made, urls, None))
    decided = F.col("found.level")
    return found.select(
        "page_id", "host", "path", F.when(decided == 0, F.col("found.rule")).alias("rule"),
        F.coalesce("found.verdict", F.lit("allow")).alias("verdict"), F.when(decided > 0, F.col("found.rule")).alias("pattern"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same by trying every rule on every url, in DuckDB's SQL.
SQL = rf"""
WITH rules(rule, verdict, is_host) AS (VALUES {', '.join(
    f"({quoted(r)}, {quoted(v)}, {h})" for rules, h in ((HOST_RULES, True), (PATTERNS, False)) for r, v in rules)}),
parts AS (
  SELECT *, regexp_replace(lower(rule), '^\|\|?|\|$', '', 'g') AS body, translate(coalesce(url, ''), '{UPPER}', '{UPPER.lower()}') AS low,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM (SELECT page_id, url, row_number() OVER () AS nr FROM pages) CROSS JOIN rules),
urls AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, split_part(rule, '/', 1) AS rule_host,
         substr(rule, strpos(rule, '/')) AS rule_path FROM parts),
tried AS (
  SELECT *, CASE WHEN is_host THEN (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    ELSE regexp_matches(low, '(?s)' || CASE WHEN starts_with(rule, '||') THEN '^[^:/?#]*://([^/?#]*\.)?' ELSE '' END
      || replace(replace(regexp_replace(body, '([.?$+-])', '\\\1', 'g'), '*', '.*'), '^', '([\x00-\x24\x26-\x2C\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]|$)')
      || CASE WHEN ends_with(rule, '|') THEN '$' ELSE '' END) END AS fits FROM urls),
best AS (
  SELECT nr, page_id, host, path, min((CASE WHEN is_host THEN 0 WHEN verdict = 'allow' THEN 1 ELSE 2 END, -length(rule), rule, verdict))
    FILTER (fits) AS won FROM tried GROUP BY ALL)
SELECT page_id, host, path, CASE WHEN won[1] = 0 THEN won[3] END AS rule, coalesce(won[4], 'allow') AS verdict,
       CASE WHEN won[1] > 0 THEN won[3] END AS pattern FROM best"""
