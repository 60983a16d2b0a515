"""Registrable domains by the longest matching public-suffix rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline.functions import policy, urls


def registrable_domains(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (with url) plus host, registrable_domain, suffix_type, reason.

    ``rules`` has rule (``com``, ``*.ck``, ``!www.ck``) and kind. All ends of the host are looked up at once; an exception wins over a
    wildcard, and a longer rule over a shorter one. Distinct hosts are looked up once.
    """
    host = urls.host(F.col("url"))
    reason = (
        F.when(~urls.scheme(F.col("url")).isin("http", "https"), "unsupported_url_scheme")
        .when(urls.userinfo(F.col("url")).isNotNull(), "userinfo_not_allowed")
        .when(host.isNull() & (urls.raw_host(F.col("url")) != ""), "invalid_idn_hostname")
        .when(host.isNull(), "missing_hostname")
        .when(policy.ipv4_number(host).isNotNull() | host.startswith("["), "ip_literal_candidate")
    )
    rows = rows.withColumns({"host": host, "early": reason})
    parts = F.split("host", r"\.")
    hosts = rows.filter("early is null").select("host").distinct()
    ends = hosts.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("k", "end"), F.size(parts).alias("n"))
    plain = F.regexp_replace("rule", r"^(!|\*\.)", "")
    table = rules.select(plain.alias("end"), F.when(F.col("rule").startswith("!"), -1).when(F.col("rule").startswith("*."), 1).otherwise(0).alias("extra"), "kind")
    # labels of the suffix: the rule's own, one more for a wildcard, one less for an exception
    hit = ends.join(table, "end").withColumn("labels", F.col("n") - F.col("k") + F.col("extra")).filter("labels <= n")
    best = hit.groupBy("host").agg(F.max(F.struct((F.col("extra") == -1).alias("exception"), "labels", "kind", "n")).alias("b"))
    own = best.filter("b.n > b.labels").select("host", F.col("b.labels").alias("labels"), F.col("b.kind").alias("suffix_type"))
    domain = F.array_join(F.slice(parts, F.size(parts) - F.col("labels"), F.col("labels") + 1), ".")
    own = own.select("host", domain.alias("registrable_domain"), "suffix_type")
    out = rows.join(own, "host", "left")
    return out.withColumn("reason", F.coalesce("early", F.when(F.col("registrable_domain").isNull(), F.lit("not_registrable_domain")))).drop("early")
