"""Tenant resolution and backend-URL checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.functions.text import bound
from guardspark.sources.config import ServiceConfig

# Host names that a backend may not have.
BLOCKED_HOSTS = ["localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback", "metadata.google.internal", "metadata.goog", "169.254.169.254", "fd00:ec2::254"]


def path_tenant(path: Column) -> Column:
    """``/x/v1/...`` names the tenant x, unless x is ``v1``."""
    parts = F.split(F.regexp_replace(path, "^/+", ""), "/")
    return F.when((F.get(parts, F.lit(1)) == "v1") & (F.get(parts, F.lit(0)) != "v1"), F.get(parts, F.lit(0)))


def api_key(authorization: Column) -> Column:
    t = F.trim(authorization)
    return F.when(t.startswith("Bearer "), F.trim(F.substring(t, 8, 2**31 - 1))).when(t.startswith("sk-") | t.startswith("key-"), t)


def admin_allowed(header: Column, authorization: Column, key: str) -> Column:
    """Whether the header or the bearer token is the key. Digests are compared, so the time says nothing of the key."""
    token = F.when(authorization.startswith("Bearer "), F.substring(authorization, 8, 2**31 - 1))
    same = lambda x: F.coalesce(F.sha2(x, 256) == F.sha2(F.lit(key), 256), F.lit(False))
    return same(header) | same(token)


def resolve(requests: DataFrame, tenants: DataFrame, default: str = "default") -> DataFrame:
    """``tenant`` by header, then path, then API key, then the default; an unknown value falls through.

    ``tenants`` (id, api_keys) joins on its keys; Spark broadcasts it if its measured size allows.
    """
    ids = tenants.select(F.col("id"))
    keys = tenants.select(F.col("id").alias("k_id"), F.explode("api_keys").alias("k"))
    keys = keys.groupBy("k").agg(F.min("k_id").alias("k_id"))
    r = requests.withColumns({"_p": path_tenant(F.col("path")), "_k": api_key(F.col("authorization"))})
    r = r.join(ids.select(F.col("id").alias("_h_id")), F.col("x_tenant_id") == F.col("_h_id"), "left")
    r = r.join(ids.select(F.col("id").alias("_p_id")), F.col("_p") == F.col("_p_id"), "left")
    r = r.join(keys, F.col("_k") == F.col("k"), "left")
    return r.withColumn("tenant", F.coalesce("_h_id", "_p_id", "k_id", F.lit(default))).drop("_p", "_k", "_h_id", "_p_id", "k", "k_id")


def routed(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """An explicit tenant in the path must exist: ``status`` 400 if it doesn't."""
    r = requests.withColumn("_p", path_tenant(F.col("path"))).join(tenants.select(F.col("id").alias("_id")), F.col("_p") == F.col("_id"), "left")
    return r.withColumn("status", F.when(F.col("_p").isNotNull() & F.col("_id").isNull(), 400).otherwise(200)).drop("_p", "_id")


def inherited(tenants: DataFrame, defaults: ServiceConfig) -> DataFrame:
    """Each tenant's settings, or the default's."""
    return tenants.select("id", *[F.coalesce(F.col(c), F.lit(getattr(defaults, c))).alias(c) for c in ("backend_url", "policy_path", "stream_format", "safety_threshold", "chunk_threshold")])


@dataclass(frozen=True)
class UrlRules:
    allow_http: bool = False
    allow_localhost: bool = False
    allow_private: bool = False
    allowed_domains: tuple[str, ...] | None = None

    @classmethod
    def development(cls) -> UrlRules:
        return cls(True, True, True)


def host_of(url: Column) -> Column:
    """Host in lower case, IPv6 in brackets."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1)), F.lit(""))


def url_problem(url: Column, rules: UrlRules) -> Column:
    """Null if the backend URL is fine, else what is wrong: invalid_url, invalid_scheme, missing_host or blocked_host. Scheme and host are looked for once a row."""
    scheme = F.nullif(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))
    schemes = ["https", "http"] if rules.allow_http else ["https"]

    def problem(u: Column) -> Column:
        blocked = bound(u["host"], lambda host: host_blocked(host, rules))
        return F.when(u["scheme"].isNull(), "invalid_url").when(~u["scheme"].isin(schemes), "invalid_scheme").when(u["host"].isNull(), "missing_host").when(blocked, "blocked_host")

    return bound(F.struct(scheme.alias("scheme"), host_of(url).alias("host")), problem)


def host_blocked(host: Column, rules: UrlRules) -> Column:
    """Whether a host (lower case, IPv6 in brackets) is a blocked name, an address of a blocked range or outside of the allowed domains."""
    named = lambda names: reduce(lambda a, b: a | b, [(host == d) | host.endswith("." + d) for d in names], F.lit(False))
    blocked = F.lit(False) if rules.allow_localhost else named(BLOCKED_HOSTS)
    quad = F.when(host.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"), F.transform(F.split(host, "\\."), lambda x: x.try_cast("int")))
    six = F.when(host.startswith("["), F.regexp_replace(host, r"^\[|\]$", ""))
    blocked = blocked | F.coalesce(bound(quad, lambda q: quad_blocked(q, rules)), F.lit(False)) | F.coalesce(bound(six, lambda x: six_blocked(x, rules)), F.lit(False))
    return blocked if rules.allowed_domains is None else blocked | ~named([d.lower() for d in rules.allowed_domains])


def quad_blocked(q: Column, rules: UrlRules) -> Column:
    """The ranges that an IPv4 address (four numbers) may not be in."""
    a, b = F.get(q, F.lit(0)), F.get(q, F.lit(1))
    out = (a == 169) & (b == 254)
    if not rules.allow_localhost:
        out = out | (a == 127)
    if not rules.allow_private:
        out = out | a.isin(0, 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
    return out


def six_blocked(address: Column, rules: UrlRules) -> Column:
    """The same for IPv6, by the first group in hex; a leading "::" is zero."""
    group = F.coalesce(F.conv(F.nullif(F.regexp_extract(address, "^([0-9a-f]{1,4}):", 1), F.lit("")), 16, 10).try_cast("int"), F.lit(0))

    def within(g: Column) -> Column:
        out = g.between(0xFE80, 0xFEBF)
        return out if rules.allow_private else out | g.between(0xFC00, 0xFDFF)

    out = bound(group, within)
    return out if rules.allow_localhost else out | address.rlike("^(0{0,4}:){1,7}0{0,3}1$")
