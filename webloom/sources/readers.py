"""Seeds, raw requests, checkpoints and configuration as DataFrames and small objects."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.simhash import split_words
from ..functions.udf import arrow_function
from ..schemas import CHECKPOINT


def url(spark: SparkSession, one: str) -> DataFrame:
    return spark.createDataFrame([(0, one)], "seq bigint, url string")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """A file of URLs, one a line; blanks go. ``seq`` orders them."""
    t = F.regexp_replace("value", r"^\s+|\s+\z", "")
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), t.alias("url")).where("url <> ''")


def url_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Text files that arrive in a folder, as a stream of URLs."""
    return spark.readStream.text(folder).select(F.regexp_replace("value", r"^\s+|\s+\z", "").alias("url")).where("url <> ''")


def parse_raw_request(raw: str | None, https: bool = False) -> dict:
    """The request in HTTP wire text; ``error`` says what is missing."""
    out = {"method": None, "url": None, "headers": None, "body": None, "root_hostname": None, "tag": "raw-request", "depth": 0, "error": None}
    head, _, body = (raw or "").replace("\r\n", "\n").partition("\n\n")
    first, *rest = head.split("\n")
    words = split_words(first)
    if len(words) < 2:
        return out | {"error": "bad request line"}
    headers = {k.strip(): v.strip() for k, mark, v in (line.partition(":") for line in rest) if mark}
    host = next((v for k, v in headers.items() if k.lower() == "host"), "")
    if not host:
        return out | {"error": "no host"}
    target = words[1] if re.match(r"(?i)https?://", words[1]) else f"{'https' if https else 'http'}://{host}{words[1]}"
    return out | {"method": words[0].upper(), "url": target, "headers": headers, "body": body, "root_hostname": host}


_RAW = "struct<method:string,url:string,headers:map<string,string>,body:string,root_hostname:string,tag:string,depth:int,error:string>"
_RAW_ARROW = pa.struct(
    [("method", pa.string()), ("url", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.string()), ("root_hostname", pa.string()), ("tag", pa.string()), ("depth", pa.int32()), ("error", pa.string())]
)


@arrow_function(_RAW)
def raw_request(raw: pa.Array, https: pa.Array) -> pa.Array:
    rows = [parse_raw_request(r, bool(h)) for r, h in zip(raw.to_pylist(), https.to_pylist(), strict=True)]
    return pa.array([r | {"headers": None if r["headers"] is None else list(r["headers"].items())} for r in rows], _RAW_ARROW)


def raw_requests(spark: SparkSession, path: str, https: bool = False) -> DataFrame:
    """Files of one raw request each."""
    return spark.read.text(path, wholetext=True).select(raw_request(F.col("value"), F.lit(https)).alias("r")).select("r.*")


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHECKPOINT).json(path, multiLine=True)


def lines_or_value(spark: SparkSession, value: str) -> list[str]:
    """A value that names a readable file stands for its lines; any other for itself. For short lists of patterns."""
    try:
        found = spark.read.text(value).collect()
    except Exception as e:  # noqa: BLE001  (Spark has no common class for "no such path")
        if "PATH_NOT_FOUND" not in str(e) and "ILLEGAL" not in str(e).upper() and "URI" not in str(e).upper():
            raise
        return [value]
    return [r[0].strip() for r in found if r[0].strip()]


@dataclass(frozen=True)
class CustomField:
    name: str
    regex: tuple[str, ...]
    part: str = "response"
    group: int = 0


def custom_fields(yaml_text: str) -> list[CustomField]:
    """Fields of a YAML list; patterns that the JVM, which runs them, does not compile go, and fields that have none left."""
    import yaml

    from ..functions.predicates import java_pattern

    out = []
    for item in yaml.safe_load(yaml_text) or []:
        good = tuple(p for p in map(java_pattern, item.get("regex", [])) if p is not None)
        if good:
            out.append(CustomField(item["name"], good, item.get("part", "response"), int(item.get("group", 0))))
    return out


def split_patterns(text: str) -> list[str]:
    """Splits at commas outside braces and brackets; a backslash protects what follows it."""
    out, depth, begin, i = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth = max(0, depth - 1)
        elif c == "," and not depth:
            out.append(text[begin:i])
            begin = i + 1
        i += 1
    return [p.strip() for p in [*out, text[begin:]] if p.strip()]


def seconds(text: str) -> int:
    """``10s``, ``5m``, ``2h``, ``1d`` or bare seconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhd]?)\s*", text)
    if not m:
        raise ValueError(f"no duration: {text!r}")
    return int(m.group(1)) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[m.group(2)]


def header_argument(text: str) -> tuple[str, str] | None:
    name, mark, value = text.partition(":")
    return (name.strip(), value.strip()) if mark else None


def as_request(df: DataFrame, url_col: Column | None = None) -> DataFrame:
    """Seeds with method, depth, tag and root host."""
    from ..operators.funnel import with_defaults

    return with_defaults(df if url_col is None else df.withColumn("url", url_col))
