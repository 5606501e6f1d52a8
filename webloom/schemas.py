"""Schemas of requests, responses and results."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()), "map<string,array<string>>": T.MapType(T.StringType(), T.ArrayType(T.StringType())),
}


def struct(text: str) -> T.StructType:
    """A schema of plain fields; needs no session, unlike a DDL string."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (f.split(" ") for f in text.split(", "))])


FORM = struct("action string, method string, enctype string, parameters array<string>")
SECRET = struct("rule_name string, matched_token string, severity string, source string")
CAPTCHA = struct("provider string, sitekey string, page_url string, action string")
LINK = struct("method string, url string, tag string, attribute string")
TLS = struct(
    "host string, port string, probe_status boolean, tls_version string, cipher string, not_before string, not_after string, "
    "subject_dn string, subject_cn string, subject_an array<string>, issuer_dn string, issuer_cn string, issuer_org array<string>, fingerprint_sha256 string"
)
REQUEST = struct(
    "method string, url string, body string, depth int, skip_validation boolean, headers map<string,string>, tag string, attribute string, "
    "root_hostname string, source string, custom_fields map<string,array<string>>, raw string"
)
RESPONSE = T.StructType(
    [
        *struct("depth int, status_code int, headers map<string,string>, body string, content_length bigint, root_hostname string, technologies array<string>, raw string").fields,
        T.StructField("forms", T.ArrayType(FORM)),
        T.StructField("stored_response_path", T.StringType()),
        T.StructField("api_type", T.StringType()),
        T.StructField("secrets", T.ArrayType(SECRET)),
        T.StructField("tls_data", TLS),
    ]
)
RESULT = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("request", REQUEST),
        T.StructField("response", RESPONSE),
        T.StructField("error", T.StringType()),
    ]
)
CHECKPOINT = struct("visited_urls array<string>, in_flight_urls array<string>, timestamp string")
