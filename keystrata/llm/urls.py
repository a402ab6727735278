"""URL filter: blocked Bloom filter, then an exact hash join.

The list holds rules (host, path prefix, verdict) and canonical URLs, from a table.
All its entries go into one filter of 64-bit blocks. Every distinct URL of the input
makes the few keys an entry could have, keys whose block lacks a bit are gone where
they lie (the filter is broadcast on a bound of its own, 4 bytes an entry), and the survivors meet the list in an exact hash join, which
removes the filter's false positives.

The canonical form of a URL: the host in lower case without user, default port and
trailing dot; the path without dot segments and trailing slashes, its escapes of
unreserved characters resolved, others in upper case; the query's parameters in
order, without tracking ones. Scheme and fragment don't count.

Defined results
    null url or no ``://``: host and path empty; no rule; default verdict.
    repeated rows: each row is judged. Extra columns are not read.
    empty table: empty result. Empty list: default verdict for all.
    rules of the same length that fit: the longer host wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .text import UPPER

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Parameters that don't name a page.
TRACKING = r"^(?:utm_[a-z]+|gclid|fbclid|ref)(?:=|\z)"
BITS_PER_KEY = 16
PROBES = 5
#: The list is broadcast up to this many entries (under 100 bytes each), the filter
#: up to this many blocks of 16 bytes (four entries each).
BROADCAST_ENTRIES = 500_000
BROADCAST_BLOCKS = 2_000_000


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url")))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url")))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The canonical form; null where there is no host."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"^.*?://", ""))
    host = F.regexp_replace(F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/?#]*)", 1), r"\.?(?::(?:80|443)?)?\z", "")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)

    def unescaped(part: Column, i: Column) -> Column:
        char = F.chr(F.conv(F.substring(part, 1, 2), 16, 10).cast("int"))
        escape = F.when(char.rlike("^[A-Za-z0-9._~-]$"), char).otherwise(F.concat(F.lit("%"), F.upper(F.substring(part, 1, 2))))
        return F.when(i == 0, part).when(part.rlike("^[0-9A-Fa-f]{2}"), F.concat(escape, F.substring(part, F.lit(3), F.length(part)))).otherwise(F.concat(F.lit("%"), part))

    path = F.when(F.instr(path, "%") > 0, F.array_join(F.transform(F.split(path, "%"), unescaped), "")).otherwise(path)
    none = F.expr("cast(array() as array<string>)")
    steps = F.aggregate(F.split(path, "/"), none, lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x))))
    path = F.when(F.instr(path, "/.") > 0, F.array_join(steps, "/")).otherwise(path)
    path = F.regexp_replace(path, r"/+\z", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(F.translate(host, UPPER, UPPER.lower()), path, query))


def entries(spark: SparkSession, rules: Iterable[tuple[str, str, str]], listed: DataFrame | None) -> DataFrame:
    """The list as rows kind, key, verdict, name and rank: any rule ranks above any
    listed URL, a longer rule above a shorter one. A host has no slash, so host and
    path of a rule make one key."""
    schema = "kind string, host string, path string, verdict string"
    ruled = spark.createDataFrame([("rule", h, p, v) for h, p, v in rules], schema)
    rank = (F.length("host") + F.length("path") + 1).cast("long") * 1_000_000 + F.length("host")
    out = ruled.select("kind", F.concat("host", "path").alias("key"), "verdict", F.concat("host", "path").alias("name"), rank.alias("rank"))
    if listed is not None:
        urls = listed.select(canonical(F.col(listed.columns[0]).cast("string")).alias("key")).where("key IS NOT NULL").distinct()
        out = out.unionByName(urls.select(F.lit("url").alias("kind"), "key", F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("rank")))
    return out


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("kind", "key"), F.lit(blocks))


def _mask() -> Column:
    """PROBES bits of a 64-bit block, from a second hash of the key."""
    h = F.xxhash64(F.lit("bits"), "key", "kind")
    out = F.lit(0).cast("long")
    for i in range(PROBES):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, listed: DataFrame | None = None, default: str = "allow", url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Columns ``keep`` with host, path, rule (null where none fits), listed
    (boolean) and verdict, one row per input row. ``listed`` is a table whose first
    column has the URLs to block where no rule fits."""
    spark, rules = pages.sparkSession, list(rules)
    base = pages.select(*(F.col(c) for c in keep), F.col(url_col).cast("string").alias("url"))
    base = base.select(*keep, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce(canonical(F.col("url")), F.lit("")).alias("canon"))
    base = base.withColumn("u", F.concat_ws("\u0001", "host", "path", "canon"))
    table = scratch.written(entries(spark, rules, listed), "url-list")
    total = table.count()
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})
    blocks = max(1, -(-total * BITS_PER_KEY // 64))
    bloom = table.select(_block(blocks).alias("block"), _mask().alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))
    bloom = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom

    label_count = F.size(F.split("host", r"\."))
    keys = [
        F.when(
            (label_count >= n) & (F.length("path") >= m),
            F.struct(F.lit("rule").alias("kind"), F.concat(F.substring_index("host", ".", -n), F.expr(f"left(path, {m})")).alias("key")),
        )
        for n, m in shapes
    ]
    keys.append(F.when(F.col("canon") != "", F.struct(F.lit("url").alias("kind"), F.col("canon").alias("key"))))
    # Rows without a host have no entry; the others of one URL are judged once.
    with_host = base.where("host <> ''")
    distinct = with_host.groupBy("u", "host", "path", "canon").agg(F.count(F.lit(1)).alias("n"))
    tried = distinct.select("u", "n", F.explode(F.array_compact(F.array(*keys))).alias("k")).select("u", "n", "k.*")
    possible = tried.withColumns({"block": _block(blocks), "mask": _mask()}).join(bloom, "block").where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).select("u", "n", "kind", "key")
    exact = possible.join(F.broadcast(table) if total <= BROADCAST_ENTRIES else table, ["kind", "key"])
    won = exact.groupBy("u").agg(F.max("n").alias("n"), F.max(F.struct("rank", "kind", "name", "verdict")).alias("w"), F.max((F.col("kind") == "url").cast("int")).alias("is_listed"))
    won = scratch.written(won.select("u", "n", F.col("w.name").alias("rule"), F.col("w.verdict").alias("verdict"), F.col("is_listed").cast("boolean").alias("listed")), "url-verdicts")
    # Few bytes on disk may be many in memory: no broadcast by file size.
    judged = scratch.join_hot(with_host, won.hint("merge"), "u", "n", base.count())
    none = base.where("host = ''").withColumns({"rule": F.lit(None).cast("string"), "listed": F.lit(False), "verdict": F.lit(default)})
    columns = [*keep, "host", "path", "rule", F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("verdict", F.lit(default)).alias("verdict")]
    return judged.select(columns).unionByName(none.select(columns))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is the table's own: pages that came by a feed (with a ``utm_``
    parameter) and all other forms of their URLs."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES, pages.where(F.col("url").rlike(FEED)).select("url"))


FEED = "[?&]utm_source="
ORACLE = r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
q AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|gclid|fbclid|ref)(?:=|\z)'))) AS params FROM p),
k AS (
  SELECT *, host || regexp_replace(path, '/+$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canon FROM q),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
urls AS (SELECT DISTINCT canon FROM k WHERE host <> '' AND regexp_matches(url, '[?&]utm_source=')),
j AS (
  SELECT page_id, host, path,
    (SELECT h || p FROM rules r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1) AS rule,
    (SELECT v FROM rules r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1) AS v,
    canon IN (SELECT canon FROM urls) AS listed
  FROM k)
SELECT page_id, host, path, rule, listed, coalesce(v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""
