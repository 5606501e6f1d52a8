"""The validation funnel between discovered links and the frontier, as one chain of columns.

Each row gets the first reason that rejects it, in a fixed order: invalid,
network_policy, extension, logout, max_depth, quota, duplicate, cycle,
out_of_scope; null if it is accepted. A key is used up by the first row that
reaches the duplicate test, even if cycle or scope reject that row then. Of rows
that share key and ``seq`` exactly one is the first. The quota of a root counts
rows that would be fetched, so repeated keys do not use it up.

URLs are judged by the host that they have once parsed; only those that are not
plainly written go through the parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Crawl
from ..functions import predicates, urls
from ..functions.whatwg import parsed_url
from ..storage import stored
from . import trie

COLUMNS = "seq bigint, method string, url string, body string, depth int, root_hostname string, tag string, attribute string, source string, skip_validation boolean, has_custom boolean"
REASONS = ("invalid", "network_policy", "extension", "logout", "max_depth", "quota", "duplicate", "cycle", "out_of_scope")


def with_defaults(df: DataFrame) -> DataFrame:
    """Adds what is missing of COLUMNS."""
    defaults = {
        "method": F.lit("GET"), "body": F.lit(""), "depth": F.lit(0), "root_hostname": urls.host(F.col("url")), "tag": F.lit(""), "attribute": F.lit(""),
        "source": F.lit(""), "skip_validation": F.lit(False), "has_custom": F.lit(False), "seq": F.xxhash64("url"),
    }
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df


#: URLs whose parts can be read off: no credentials, escapes or numbers in the host, a port of at most four digits, no controls or spaces.
PLAIN = r"^(?i:https?)://([A-Za-z0-9_-]+\.)*[A-Za-z][A-Za-z-]*(:[0-9]{1,4})?([/?#][^\x00-\x20]*)?\z"
#: Parts that the rows of a root are dealt to before the quota is taken from what is left of each.
PARTS = 32


def parsed_host(url: Column) -> Column:
    """The host that a URL has once parsed; null if it is no URL, empty if it has none."""
    plain = F.coalesce(url.rlike(PLAIN) & ~urls.host(url).rlike(r"(^|\.)(xn--[^.]*|0x[0-9a-f]*)(\.|\z)"), F.lit(False))
    u = parsed_url(F.when(~plain, url))
    return F.when(plain, urls.host(url)).when(u.isNotNull(), F.coalesce(u["host"], F.lit("")))


def stateless_reason(cfg: Crawl, host: Column) -> Column:
    url = F.col("url")
    reason = F.when(F.coalesce(host, F.lit("")) == "", "invalid")
    reason = reason.when(~predicates.policy_allows(host, cfg.policy, with_v6=True), "network_policy")
    reason = reason.when(~predicates.extension_allows(urls.path(url), cfg.extensions), "extension")
    if cfg.has_credentials:
        reason = reason.when(predicates.is_logout(url), "logout")
    return reason.when(F.col("depth") > cfg.limits.max_depth, "max_depth")


def key_of(cfg: Crawl, url: Column) -> Column:
    if cfg.ignore_query_params:
        url = urls.blank_query_values(url)
    return urls.fingerprint(url) if cfg.filter_similar else url


def judged(candidates: DataFrame, cfg: Crawl, visited: DataFrame | None = None, fetched: DataFrame | None = None) -> DataFrame:
    """``candidates`` with ``dedup_key`` and ``reject_reason``.

    ``visited``: keys of earlier levels (column dedup_key). ``fetched``: pages
    per root so far (root_hostname, n).
    """
    df = with_defaults(candidates).withColumn("__host", parsed_host(F.col("url")))
    df = df.withColumn("reject_reason", stateless_reason(cfg, F.col("__host")))
    df = df.withColumn("dedup_key", key_of(cfg, urls.dedup_key(F.col("method"), F.col("url"), F.col("body"))))
    if cfg.filter_similar:
        df = trie.with_set_mode(df, "dedup_key", "dedup_key", cfg.limits.trie_threshold)
    # read several times below; written, its rows keep the numbers that tell those alike apart
    df = stored(df.withColumn("__row", F.monotonically_increasing_id()))
    place = F.struct("seq", "__row")

    def first_of(rows: DataFrame) -> DataFrame:
        # min() over partial results instead of a window: a key that a third of all rows have is folded before the shuffle
        firsts = rows.where("reject_reason IS NULL").groupBy("dedup_key").agg(F.min(place).alias("__first")).withColumnRenamed("dedup_key", "__k")
        if visited is not None:
            seen = visited.select(F.col("dedup_key").alias("__v")).distinct()
            firsts = firsts.join(seen, F.col("__k") == F.col("__v"), "left").select("__k", F.when(F.col("__v").isNull(), F.col("__first")).alias("__first"))
        return rows.join(firsts, F.col("dedup_key") == F.col("__k"), "left").drop("__k")

    df = first_of(df)
    fresh = F.col("reject_reason").isNull() & (F.col("has_custom") | F.coalesce(F.col("__first.__row") == F.col("__row"), F.lit(False)))
    if cfg.limits.max_pages_per_root:
        # of each part of a root's rows only as many as the quota can be within it, so the last window has few rows a root
        most, order = cfg.limits.max_pages_per_root, ["depth", "seq", "__row"]
        part = F.pmod(F.xxhash64("__row"), F.lit(PARTS))
        asking = df.where(fresh & (F.col("root_hostname") != "")).select("root_hostname", *order)
        asking = asking.withColumn("__n", F.row_number().over(Window.partitionBy("root_hostname", part).orderBy(*order))).where(F.col("__n") <= most)
        asking = asking.withColumn("__n", F.row_number().over(Window.partitionBy("root_hostname").orderBy(*order)))
        if fetched is not None:
            before = fetched.select(F.col("root_hostname").alias("__r"), F.col("n").alias("__f"))
            asking = asking.join(before, F.col("root_hostname") == F.col("__r"), "left").withColumn("__n", F.col("__n") + F.coalesce("__f", F.lit(0)))
        within = asking.where(F.col("__n") <= most).select(F.col("__row").alias("__w"))
        df = df.join(within, F.col("__row") == F.col("__w"), "left")
        full = fresh & (F.col("root_hostname") != "") & F.col("__w").isNull()
        df = df.withColumn("reject_reason", F.coalesce("reject_reason", F.when(full, "quota"))).drop("__w")
    late = (
        F.when(~fresh, "duplicate")
        .when(predicates.is_cycle(F.col("url")), "cycle")
        .when(~F.col("skip_validation") & ~predicates.in_scope(F.col("url"), F.col("root_hostname"), cfg.scope, F.col("__host")), "out_of_scope")
    )
    return df.withColumn("reject_reason", F.coalesce("reject_reason", late)).drop("__first", "__row", "__host")


def climbed(accepted: DataFrame, cfg: Crawl) -> DataFrame:
    """Parent folders of accepted rows that policy, extension and scope let through, one for each key."""
    rows = accepted.select("seq", "root_hostname", "source", "depth", F.posexplode(urls.parent_paths(F.col("url"))).alias("pos", "url"))
    rows = rows.where(predicates.policy_allows(urls.host(F.col("url")), cfg.policy, with_v6=True) & predicates.extension_allows(urls.path(F.col("url")), cfg.extensions))
    rows = rows.where(predicates.in_scope(F.col("url"), F.col("root_hostname"), cfg.scope))
    key = urls.fingerprint(F.col("url")) if cfg.filter_similar else F.col("url")
    picked = rows.withColumn("dedup_key", key).groupBy("dedup_key").agg(F.min(F.struct("seq", "pos", "url", "root_hostname", "source", "depth")).alias("r"))
    return picked.select("dedup_key", "r.seq", "r.url", "r.root_hostname", "r.source", F.greatest(F.col("r.depth") - 1, F.lit(0)).alias("depth"), F.lit("path-climb").alias("tag"))
