"""Audits of recorded HTTP responses and environment files (section 2.12).

The reference probes a live local server; here the responses are data
(``status``, ``headers`` map), so every check is a column expression.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X

# FIXED VALUES
LOCAL_HOSTS = ["localhost", "127.0.0.1", "[::1]"]
SECURITY_HEADERS = ["content-security-policy", "x-content-type-options", "x-frame-options", "referrer-policy",
                    "permissions-policy"]
HOSTILE_ORIGIN = "https://evil.com"
ENV_FILES = [".env", ".env.local", ".env.development"]
URL_RE = "(?i)(?<![A-Za-z0-9_])[a-z][a-z0-9+.-]*://[^\\s\"'<>]+"
ASSIGN_RE = "(?i)^\\s*[A-Z0-9_]*(?:HOST|URL|URI|ENDPOINT|BASE)[A-Z0-9_]*\\s*=\\s*[\"']?([^\"'\\s#]+)[\"']?"
DOMAIN_RE = "(?i)^[a-z0-9.-]+\\.[a-z]{2,}(?::\\d+)?\\z"


def headers_map(json_col: str = "headers_json") -> Column:
    """Header names lower-cased (a later duplicate wins)."""
    return F.transform_keys(F.from_json(F.col(json_col), "map<string,string>"), lambda k, v: F.lower(k))


# scheme, optional user, then a bracketed address or a name (names with "_" too)
HOST_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\s]*@)?(\[[^\]]*\]|[^/?#:@\s]*)"


def url_host(url) -> Column:
    """Lower-case host of an absolute URL; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(X.col(url), HOST_RE, 1), F.lit("")))


def security_headers(responses: DataFrame, headers: str = "headers") -> DataFrame:
    h = F.col(headers)
    missing = F.filter(F.array(*[F.lit(x) for x in SECURITY_HEADERS]),
                       lambda k: F.coalesce(F.try_element_at(h, k), F.lit("")) == "")
    sus = F.size(missing) > 0
    return responses.select("*", F.when(sus, "DAST-SUSPECTED").otherwise("DAST-CLEAN").alias("result"),
                            F.when(sus, "LOW").otherwise("INFO").alias("severity"),
                            F.array_join(missing, ", ").alias("missing"))


def cors(responses: DataFrame, headers: str = "headers") -> DataFrame:
    origin = F.coalesce(F.try_element_at(F.col(headers), F.lit("access-control-allow-origin")), F.lit(""))
    risky = (origin == "*") | (F.lower(origin) == HOSTILE_ORIGIN)
    return responses.select("*", F.when(risky, "DAST-SUSPECTED").otherwise("DAST-CLEAN").alias("result"),
                            F.when(risky, "MEDIUM").otherwise("INFO").alias("severity"))


def external_redirects(responses: DataFrame, headers: str = "headers", target: str = "target") -> DataFrame:
    """3xx responses whose Location resolves (absolute, or relative to the
    target) to a host that is not loopback."""
    loc = F.try_element_at(F.col(headers), F.lit("location"))
    absolute = loc.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    host = F.when(absolute, url_host(loc)).when(loc.startswith("//"), url_host(F.concat(F.lit("http:"), loc))) \
        .otherwise(url_host(F.col(target)))
    r = responses.where(F.col("status").between(300, 399) & X.nonempty(loc))
    return r.select("*", host.alias("location_host")).where(
        F.col("location_host").isNull() | ~F.col("location_host").isin(*LOCAL_HOSTS))


def env_hosts(lines: DataFrame, text: str = "text", file: str = "file") -> DataFrame:
    """``aud_env_hosts``: in the audited env files, every non-loopback URL host
    and every bare domain assigned to a *HOST/URL/URI/ENDPOINT/BASE* key."""
    f = lines.where(F.col(file).isin(*ENV_FILES))
    urls = (f.select("*", F.explode(F.regexp_extract_all(F.col(text), F.lit(URL_RE), F.lit(0))).alias("url"))
            .select("*", url_host("url").alias("host")).where(F.col("host").isNotNull() & ~F.col("host").isin(*LOCAL_HOSTS))
            .withColumn("signal", F.lit("url")).drop("url"))
    val = F.regexp_extract(F.col(text), ASSIGN_RE, 1)
    val = X.js_trim(val)
    assigned = (f.select("*", val.alias("_v"))
                .where((F.col("_v") != "") & ~F.col("_v").contains("://") & ~F.col("_v").isin("localhost", "127.0.0.1")
                       & F.col("_v").rlike(DOMAIN_RE))
                .select(*f.columns, F.substring_index("_v", ":", 1).alias("host"))
                .withColumn("signal", F.lit("assigned")))
    return urls.unionByName(assigned)
