"""Classification and detection as Column expressions over rule tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import all_of, trimmed


def _any(text: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def api_type(url: Column, content_type: Column, body: Column) -> Column:
    u, c, b = F.lower(url), F.lower(F.coalesce(content_type, F.lit(""))), F.coalesce(body, F.lit(""))
    graphql = _any(u, ("/graphql", "?query=")) | _any(b, ("__schema", "query {", "mutation {"))
    soap = u.endswith(".wsdl") | u.endswith(".asmx") | u.endswith(".svc") | u.contains("?wsdl") | c.contains("application/soap+xml") | (c.contains("text/xml") & b.contains("<soap:"))
    return (
        F.when(u.startswith("ws://") | u.startswith("wss://"), "websocket")
        .when(graphql, "graphql")
        .when(soap, "soap")
        .when(_any(u, ("/api/", "/v1/", "/v2/", "/v3/", "/rest/")), "rest")
        .when(_any(c, ("application/json", "text/json")), "xhr")
    )


# Name, severity, pattern (group 1 is the token).
SECRET_RULES = (
    ("AWS Access Key", "critical", r"\b(AKIA[0-9A-Z]{16})\b"),
    ("GitHub Token", "critical", r"\b(gh[pousr]_[A-Za-z0-9_]{36,255}|github_pat_[A-Za-z0-9_]{22}_[A-Za-z0-9_]{59})\b"),
    ("Google API Key", "high", r"\b(AIza[0-9A-Za-z\-_]{35})\b"),
    ("Slack Webhook", "high", r"(https://hooks\.slack\.com/services/T[a-zA-Z0-9_]+/B[a-zA-Z0-9_]+/[a-zA-Z0-9_]+)"),
    ("Stripe Secret Key", "critical", r"\b(sk_live_[0-9a-zA-Z]{24,34})\b"),
    ("Stripe Publishable Key", "low", r"\b(pk_live_[0-9a-zA-Z]{24,34})\b"),
    ("JWT Token", "medium", r"\b(eyJ[A-Za-z0-9\-_]{10,}\.eyJ[A-Za-z0-9\-_]{10,}\.[A-Za-z0-9\-_]{10,})\b"),
    ("Generic Secret Assignment", "medium", r"""(?i)\b(?:api_key|apikey|secret_key|app_secret|client_secret)\s*[:=]\s*["']([0-9a-zA-Z\-_]{20,})["']"""),
)


def masked(token: Column) -> Column:
    return F.concat(F.substring(token, 1, 4), F.lit("***"))


def secrets(text: Column, source: Column, mask: bool = True) -> Column:
    """Array of findings, in order of rules. Tokens are masked unless asked otherwise."""

    def rule(name: str, severity: str, pattern: str) -> Column:
        return F.transform(all_of(text, pattern), lambda t: F.struct(F.lit(name).alias("rule_name"), (masked(t) if mask else t).alias("matched_token"), F.lit(severity).alias("severity"), source.alias("source")))

    return F.flatten(F.array(*[rule(*r) for r in SECRET_RULES]))


# Fixed values: (where, needle, technologies). "header:x" looks into header x; an empty needle asks for its presence alone.
TECHNOLOGY_RULES = (
    ("header:server", "nginx", ("Nginx",)),
    ("header:server", "apache", ("Apache",)),
    ("header:server", "cloudflare", ("Cloudflare",)),
    ("header:server", "caddy", ("Caddy",)),
    ("header:server", "litespeed", ("LiteSpeed",)),
    ("header:server", "microsoft-iis", ("Microsoft-IIS",)),
    ("header:server", "openresty", ("OpenResty",)),
    ("header:server", "gunicorn", ("Gunicorn",)),
    ("header:server", "uvicorn", ("Uvicorn",)),
    ("header:server", "envoy", ("Envoy",)),
    ("header:x-powered-by", "php", ("PHP",)),
    ("header:x-powered-by", "express", ("Express", "Node.js")),
    ("header:x-powered-by", "asp.net", ("ASP.NET",)),
    ("header:x-powered-by", "next.js", ("Next.js", "React")),
    ("header:x-powered-by", "nuxt", ("Nuxt.js", "Vue.js")),
    ("header:x-powered-by", "django", ("Django", "Python")),
    ("header:x-powered-by", "rails", ("Ruby on Rails", "Ruby")),
    ("header:x-powered-by", "spring", ("Spring Boot", "Java")),
    ("header:x-generator", "wordpress", ("WordPress", "PHP")),
    ("header:x-generator", "drupal", ("Drupal", "PHP")),
    ("header:x-generator", "joomla", ("Joomla", "PHP")),
    ("header:set-cookie", "phpsessid", ("PHP",)),
    ("header:set-cookie", "jsessionid", ("Java",)),
    ("header:set-cookie", "laravel_session", ("Laravel", "PHP")),
    ("header:set-cookie", "xsrf-token", ("Laravel", "PHP")),
    ("header:set-cookie", "csrftoken", ("Django", "Python")),
    ("header:set-cookie", "connect.sid", ("Express", "Node.js")),
    ("header:set-cookie", "wp-settings-", ("WordPress", "PHP")),
    ("header:set-cookie", "wordpress_", ("WordPress", "PHP")),
    ("header:set-cookie", "__cf_bm", ("Cloudflare",)),
    ("header:set-cookie", "cf_clearance", ("Cloudflare",)),
    ("header:cf-ray", "", ("Cloudflare",)),
    ("header:cf-cache-status", "", ("Cloudflare",)),
    ("header:x-amz-cf-id", "", ("Amazon CloudFront", "AWS")),
    ("header:x-drupal-cache", "", ("Drupal", "PHP")),
    ("header:x-drupal-dynamic-cache", "", ("Drupal", "PHP")),
    ("header:x-shopify-stage", "", ("Shopify",)),
    ("script", "jquery", ("jQuery",)),
    ("script", "react", ("React",)),
    ("script", "vue", ("Vue.js",)),
    ("script", "angular", ("Angular",)),
    ("script", "bootstrap", ("Bootstrap",)),
    ("script", "google-analytics.com", ("Google Analytics",)),
    ("script", "googletagmanager.com", ("Google Analytics",)),
    ("script", "cdn.shopify.com", ("Shopify",)),
    ("script", "wp-content", ("WordPress", "PHP")),
    ("script", "wp-includes", ("WordPress", "PHP")),
    ("link", "bootstrap", ("Bootstrap",)),
    ("link", "tailwind", ("Tailwind CSS",)),
    ("link", "font-awesome", ("Font Awesome",)),
    ("link", "fontawesome", ("Font Awesome",)),
    ("link", "wp-content", ("WordPress",)),
    ("link", "wp-includes", ("WordPress",)),
    ("body", "__next_data__", ("Next.js", "React")),
    ("body", "__nuxt__", ("Nuxt.js", "Vue.js")),
    ("body", "data-reactroot", ("React",)),
    ("body", "ng-version", ("Angular",)),
    ("body", "ng-app", ("Angular",)),
    ("body", "elementor", ("Elementor", "WordPress")),
    ("body", "woocommerce", ("WooCommerce", "WordPress")),
)
# Of a generator only the first that fits counts.
GENERATORS = (
    ("wordpress", ("WordPress", "PHP")),
    ("joomla", ("Joomla", "PHP")),
    ("drupal", ("Drupal", "PHP")),
    ("gatsby", ("Gatsby", "React")),
    ("hugo", ("Hugo",)),
    ("shopify", ("Shopify",)),
)
GENERATOR_TAG = (
    r"""(?i)<meta\s+(?:[^>]*\s+)?name=["']generator["']\s+(?:[^>]*\s+)?content=["']([^"']+)["']"""
    r"""|<meta\s+(?:[^>]*\s+)?content=["']([^"']+)["']\s+(?:[^>]*\s+)?name=["']generator["']"""
)
SCRIPT_SRC = r"""(?i)<script\b[^>]*\bsrc=["']?([^"'>\s]+)["']?"""
LINK_HREF = r"""(?i)<link\b[^>]*\bhref=["']?([^"'>\s]+)["']?"""


def _containing(needle: str):
    return lambda x: x.contains(needle)


def technologies(headers: Column, body: Column) -> Column:
    """Sorted distinct names of what headers (a map) and body give away."""
    b = F.coalesce(body, F.lit(""))
    low = F.transform_keys(F.coalesce(headers, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    places = {
        "script": F.transform(all_of(b, SCRIPT_SRC), F.lower),
        "link": F.transform(all_of(b, LINK_HREF), F.lower),
        "body": F.array(F.lower(b)),
    }
    found = []
    for where, needle, names in TECHNOLOGY_RULES:
        if where.startswith("header:"):
            value = F.try_element_at(low, F.lit(where[7:]))
            hit = value.isNotNull() & (F.lower(value).contains(needle) if needle else F.lit(True))
        else:
            hit = F.exists(places[where], _containing(needle))
        found.append(F.when(hit, F.array(*[F.lit(n) for n in names])).otherwise(F.array().cast("array<string>")))

    def generated(g: Column) -> Column:
        out = F.when(F.lit(False), F.array().cast("array<string>"))
        for needle, names in GENERATORS:
            out = out.when(g.contains(needle), F.array(*[F.lit(n) for n in names]))
        return out.otherwise(F.array().cast("array<string>"))

    tags = F.concat(all_of(b, GENERATOR_TAG, 1), all_of(b, GENERATOR_TAG, 2))
    found.append(F.flatten(F.transform(tags, lambda t: generated(F.lower(t)))))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


# Marks of pages that scripts build.
SPA_MOUNT = (
    r"""(?i)<(?:div|section|main)\s+id=["'](?:root|app|__next|__nuxt|main-content)["']\s*>\s*</(?:div|section|main)>"""
    r"""|<app-root(?:\s+[^>]*)?>\s*</app-root>"""
)
SPA_NOSCRIPT = r"(?i)need to enable JavaScript|requires JavaScript|enable JavaScript to continue|JavaScript is disabled"
SPA_BUNDLE = r"""(?i)<script[^>]+src=["'][^"']*(?:react|vue|angular|svelte|next|nuxt|umi|chunk-vendors|runtime~main|main\.[0-9a-f]{8,}\.js)[^"']*["']"""
SPA_TEXT_BYTES = 300


def is_spa(html: Column, content_type: Column) -> Column:
    c = F.lower(F.coalesce(content_type, F.lit("")))
    other = (c != "") & ~c.contains("text/html") & ~c.contains("application/xhtml")
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", " "), r"(?is)<[^>]+>", " ")
    sparse = F.octet_length(trimmed(visible)) < SPA_TEXT_BYTES
    return ~other & (html.rlike(SPA_MOUNT) | (html.contains("<noscript") & html.rlike(SPA_NOSCRIPT)) | (html.rlike(SPA_BUNDLE) & sparse))


def _badge(name: str) -> str:
    # Fixed value: a badge's class before or after its site key.
    mark = rf"""class=["'][^"']*\b{name}\b[^"']*["']"""
    key = r"""data-sitekey=["']([^"']+)["']"""
    return rf"(?i)<[^>]*(?:{mark}[^>]*{key}|{key}[^>]*{mark})"


V3_SCRIPT = r"(?i)https://www\.google\.com/recaptcha/(api|enterprise)\.js\?render=([a-zA-Z0-9_-]+)"
ANY_SITEKEY = r"""(?i)data-sitekey=["']([a-zA-Z0-9_-]{20,})["']"""
PROVIDERS = ("hcaptcha", "turnstile", "recaptcha_v3", "recaptcha_v3_enterprise", "recaptcha_v2", "recaptcha_v2_enterprise")


def captcha(html: Column, page_url: Column) -> Column:
    """Provider and site key of a challenge widget, or null."""

    def key_of(name: str) -> Column:
        p = _badge(name)
        return F.coalesce(F.nullif(F.regexp_extract(html, p, 1), F.lit("")), F.nullif(F.regexp_extract(html, p, 2), F.lit("")))

    def info(provider: Column, key: Column) -> Column:
        return F.when(key.isNotNull(), F.struct(provider.alias("provider"), key.alias("sitekey"), page_url.alias("page_url"), F.lit("").alias("action")))

    render = F.nullif(F.nullif(F.regexp_extract(html, V3_SCRIPT, 2), F.lit("")), F.lit("explicit"))
    v3 = F.when(F.regexp_extract(html, V3_SCRIPT, 1) == "enterprise", "recaptcha_v3_enterprise").otherwise("recaptcha_v3")
    v2 = F.when(html.contains("recaptcha/enterprise.js"), "recaptcha_v2_enterprise").otherwise("recaptcha_v2")
    return F.coalesce(
        info(F.lit("hcaptcha"), key_of("h-captcha")),
        info(F.lit("turnstile"), key_of("cf-turnstile")),
        info(v3, render),
        info(v2, key_of("g-recaptcha")),
        info(v2, F.nullif(F.regexp_extract(html, ANY_SITEKEY, 1), F.lit(""))),
    )


def captcha_from_json(value: Column, page_url: Column) -> Column:
    v = F.from_json(value, "provider string, sitekey string, action string")
    known = F.when(F.lower(v["provider"]).isin(*PROVIDERS), F.lower(v["provider"]))
    ok = known.isNotNull() & (F.coalesce(v["sitekey"], F.lit("")) != "")
    return F.when(ok, F.struct(known.alias("provider"), v["sitekey"].alias("sitekey"), page_url.alias("page_url"), F.coalesce(v["action"], F.lit("")).alias("action")))


def synthetic_value(name: Column, kind: Column | None = None, search: str = "example", other: str = "example_test") -> Column:
    """A plausible value for a form field by its name and type."""
    n, t = F.lower(name), F.lower(kind if kind is not None else F.lit("text"))
    # Words in field names and what they get.
    return (
        F.when((t == "password") | _any(n, ("pass", "pwd")), "Password123!")
        .when((t == "email") | _any(n, ("email", "mail")), "test@example.com")
        .when(_any(n, ("user", "login", "name")), "admin")
        .when((t == "tel") | _any(n, ("phone", "mobile")), "+15550199")
        .when((t == "number") | _any(n, ("age", "count")), "1")
        .when((t == "search") | _any(n, ("search", "q")), search)
        .otherwise(other)
    )
