"""Following links to a fixpoint over a closed set of pages, level by level.

``site`` has url, status, content_type, headers (map), html, and optionally
final_url. Fetching is a join with it; a URL that is not in it gives an error
row. Each level is written to the shared folder, so lineage stays short and
lost executors repeat one level's tasks at most. Breadth first: the recorded
depth is the least.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Crawl
from ..functions import classify, predicates, text, urls
from ..functions.html import page_parts
from ..functions.js import js_endpoints
from ..functions.whatwg import absolute_url
from ..operators import funnel
from ..storage import stored

FRONTIER = "url string, method string, body string, depth int, root_hostname string, tag string, attribute string, source string, seq bigint, dedup_key string"


@dataclass
class Crawled:
    responses: DataFrame  # one row for each fetched page
    frontier: DataFrame  # every accepted request, with depth
    rejected: DataFrame  # judged candidates that were not accepted
    visited: DataFrame  # keys used up; with `pending` enough to resume
    pending: DataFrame  # accepted but not fetched (beyond max_levels)
    errors: DataFrame  # a row for each request beyond the depth, and with display_out_scope for each that scope rejected


def seeds(spark: SparkSession, urls_: list[str]) -> DataFrame:
    rows = [(i, u.strip()) for i, u in enumerate(urls_) if u.strip()]
    return spark.createDataFrame(rows, "seq bigint, url string").withColumn("skip_validation", F.lit(True)).withColumn("tag", F.lit("seed"))


def known_files(site: DataFrame, roots: DataFrame, mode: str) -> DataFrame:
    """Candidates from robots.txt and sitemap.xml of each root; mode all, robotstxt or sitemapxml."""
    wanted = {"all": ("robotstxt", "sitemapxml"), "robotstxt": ("robotstxt",), "sitemapxml": ("sitemapxml",)}[mode]
    out = None
    for kind in wanted:
        name = {"robotstxt": "/robots.txt", "sitemapxml": "/sitemap.xml"}[kind]
        values = text.robots_values if kind == "robotstxt" else text.sitemap_values
        at = roots.select(F.concat(F.regexp_replace("url", r"/\z", ""), F.lit(name)).alias("file"), F.col("url").alias("root")).distinct()
        hits = site.where(F.col("status").between(200, 299)).join(at, F.col("file") == site["url"]).select("file", F.posexplode(values(F.col("html"))).alias("pos", "ref"))
        rows = hits.select(absolute_url(F.col("file"), F.col("ref")).alias("url"), F.lit("file").alias("tag"), F.lit(kind).alias("attribute"), F.col("file").alias("source"), F.lit(2).alias("depth"), "pos")
        out = rows if out is None else out.unionByName(rows)
    return out.where("url IS NOT NULL").withColumn("root_hostname", urls.host(F.col("source"))).withColumn("seq", F.xxhash64("source", "url", "attribute"))


def fetched(frontier: DataFrame, site: DataFrame, cfg: Crawl) -> DataFrame:
    s = site.select(
        F.regexp_replace("url", r"#.*\z", "").alias("__u"), "status", "content_type", "headers", F.col("final_url").alias("final_url") if "final_url" in site.columns else F.lit(None).cast("string").alias("final_url"),
        text.capped_body(F.col("html"), cfg.limits.body_bytes).alias("html"),
    )
    joined = frontier.withColumn("__key", F.regexp_replace("url", r"#.*\z", "")).join(s, F.col("__key") == F.col("__u"), "left").drop("__u", "__key")
    return joined.withColumn("final_url", F.coalesce("final_url", "url")).withColumn("error", F.when(F.col("status").isNull(), "not found in the given pages"))


def analysed(responses: DataFrame) -> DataFrame:
    """Responses with their classification columns."""
    body, ctype = F.coalesce("html", F.lit("")), F.coalesce("content_type", F.lit(""))
    return (
        responses.withColumn("api_type", classify.api_type(F.col("final_url"), ctype, body))
        .withColumn("technologies", classify.technologies(F.col("headers"), body))
        .withColumn("secrets", classify.secrets(body, F.col("final_url")))
        .withColumn("captcha", classify.captcha(body, F.col("final_url")))
        .withColumn("is_spa", classify.is_spa(body, ctype))
    )


def extracted(responses: DataFrame, cfg: Crawl) -> DataFrame:
    """Candidates of fetched pages: redirects, Location headers, links, and with js_crawl scripts and body text."""
    ok = responses.where("status IS NOT NULL").withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>")))
    parts = page_parts(F.col("final_url"), F.col("html")).alias("p")
    pages = ok.select("url", "final_url", "depth", "seq", "root_hostname", "content_type", "html", F.try_element_at(F.transform_keys("headers", lambda k, _: F.lower(k)), F.lit("location")).alias("location"), parts)
    deeper = F.col("depth") + 1
    none = F.lit("GET")

    def rows(df: DataFrame, method, url, tag, attribute, depth) -> DataFrame:
        return df.select(method.alias("method"), url.alias("url"), tag.alias("tag"), attribute.alias("attribute"), depth.alias("depth"), F.col("final_url").alias("source"), "root_hostname", F.col("seq").alias("parent"))

    out = rows(pages.where("final_url <> url"), none, F.col("final_url"), F.lit("redirect"), F.lit(""), F.col("depth"))
    out = out.unionByName(rows(pages.where("location IS NOT NULL"), none, absolute_url(F.col("final_url"), F.col("location")), F.lit("header"), F.lit("location"), deeper))
    links = pages.select("*", F.explode("p.links").alias("l"))
    out = out.unionByName(rows(links, F.col("l.method"), F.col("l.url"), F.col("l.tag"), F.col("l.attribute"), deeper))
    if cfg.js_crawl:
        body = pages.select("*", F.explode(text.relative_endpoints(F.coalesce("html", F.lit("")))).alias("ref"))
        out = out.unionByName(rows(body, none, absolute_url(F.col("final_url"), F.col("ref")), F.lit("regex"), F.lit("js"), deeper))
        file = predicates.is_script(F.col("final_url"), F.col("content_type")) & ~predicates.is_vendor_script(F.col("final_url"))
        scripts = pages.select("*", F.when(file, F.lit("js")).otherwise(F.lit("script")).alias("st"), F.explode(F.when(file, F.array("html")).otherwise(F.col("p.scripts"))).alias("code"))
        found = scripts.select("*", F.explode(js_endpoints(F.col("final_url"), F.col("code"))).alias("e"))
        out = out.unionByName(rows(found, none, F.col("e.url"), F.col("st"), F.col("e.attribute"), deeper))
    root = F.col("root_hostname") if cfg.pin_root else urls.host(F.col("source"))
    return out.where("url IS NOT NULL").withColumn("root_hostname", root).withColumn("seq", F.xxhash64("parent", "url", "tag", "attribute")).drop("parent")


def crawl(site: DataFrame, start: DataFrame, cfg: Crawl, max_levels: int | None = None, visited: DataFrame | None = None, seconds: float | None = None) -> Crawled:
    """Runs to the fixpoint (or ``max_levels``). ``visited`` resumes an earlier run: its keys are not entered again. After ``seconds`` no further level begins; what waits is ``pending``."""
    spark, began = site.sparkSession, time.monotonic()
    candidates = funnel.with_defaults(start)
    if cfg.known_files:
        extra = funnel.with_defaults(known_files(site, start, cfg.known_files))
        candidates = candidates.unionByName(extra.select(*candidates.columns))
    responses, frontiers, rejected, keys = [], [], [], [visited.select("dedup_key")] if visited is not None else []
    empty = spark.createDataFrame([], FRONTIER)
    pending, level = empty, 0
    limit = cfg.limits.max_depth + 1 if max_levels is None else max_levels
    while True:
        seen = None
        for k in keys:
            seen = k if seen is None else seen.union(k)
        counts = None
        for r in responses:
            c = r.where("status IS NOT NULL").groupBy("root_hostname").agg(F.count(F.lit(1)).alias("n"))
            counts = c if counts is None else counts.unionByName(c)
        if counts is not None:
            counts = counts.groupBy("root_hostname").agg(F.sum("n").alias("n"))
        judged = stored(funnel.judged(candidates, cfg, seen, counts))
        keys.append(judged.where("reject_reason IS NULL OR reject_reason IN ('cycle', 'out_of_scope')").select("dedup_key"))
        rejected.append(judged.where("reject_reason IS NOT NULL"))
        front = judged.where("reject_reason IS NULL").select("url", "method", "body", "depth", "root_hostname", "tag", "attribute", "source", "seq", "dedup_key")
        if cfg.path_climb:
            up = funnel.climbed(front, cfg).join(front.select(F.col("dedup_key").alias("k")), F.col("dedup_key") == F.col("k"), "left_anti")
            if seen is not None:
                up = up.join(seen.select(F.col("dedup_key").alias("k")), F.col("dedup_key") == F.col("k"), "left_anti")
            up = stored(up.select("url", F.lit("GET").alias("method"), F.lit("").alias("body"), "depth", "root_hostname", "tag", F.lit("").alias("attribute"), "source", F.xxhash64("url").alias("seq"), "dedup_key"))
            keys.append(up.select("dedup_key"))
            front = front.unionByName(up)
        if front.isEmpty():
            break
        frontiers.append(front)
        if level >= limit or (seconds is not None and time.monotonic() - began > seconds):
            pending = front
            break
        got = stored(fetched(front, site, cfg))
        responses.append(got)
        candidates = stored(extracted(got, cfg))
        level += 1

    def union(parts: list[DataFrame], otherwise: DataFrame) -> DataFrame:
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return otherwise if out is None else out

    none = fetched(empty, site, cfg)
    away = union(rejected, funnel.judged(funnel.with_defaults(empty), cfg))
    reason = F.col("reject_reason")
    errors = away.where((reason == "max_depth") | ((reason == "out_of_scope") & F.lit(cfg.display_out_scope)))
    said = F.when(reason == "max_depth", "maximum crawl depth exceeded").otherwise("endpoint is out of scope")
    errors = errors.select("url", "method", "body", "depth", "root_hostname", "tag", "attribute", "source", said.alias("error"))
    return Crawled(union(responses, none), union(frontiers, empty), away, union(keys, empty.select("dedup_key")), pending, errors)
