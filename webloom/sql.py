"""Registers the Python functions for use in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import html, js, predicates, simhash, whatwg
from .sources import readers


def register(spark: SparkSession) -> list[str]:
    found = {
        "absolute_url": whatwg.absolute_url, "parsed_url": whatwg.parsed_url, "page_parts": html.page_parts, "js_endpoints": js.js_endpoints,
        "simhash": simhash.simhash, "is_private_ipv6": predicates.is_private_ipv6, "raw_request": readers.raw_request,
    }
    for name, f in found.items():
        spark.udf.register(name, F.arrow_udf(f.__wrapped__, f.kind))
    return sorted(found)
