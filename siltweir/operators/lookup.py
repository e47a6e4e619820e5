"""Lookups of addresses and hosts: threat lists, owners of domains, addresses that may be fetched."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltweir.functions.hosts import url_host, url_part
from siltweir.functions.transforms import feed_key

#: Ports that a fetch may go to.
PORTS = (80, 443, 8080, 8443)


def threat_hits(df: DataFrame, url: str, feed: DataFrame, feed_url: str, trusted: DataFrame | None = None, out: str = "threat") -> DataFrame:
    """df with `out`: 'address' where the address itself is listed, 'host' where its host is and isn't trusted, else NULL.
    Two equi-joins on distinct keys; the optimiser broadcasts a list only if it is small."""
    key, host = feed_key(F.col(url)), F.lower(url_host(F.col(url)))
    urls = feed.select(feed_key(F.col(feed_url)).alias("__fk")).where("__fk is not null").distinct().withColumn("__u", F.lit(1))
    hosts = feed.select(F.lower(url_host(F.col(feed_url))).alias("__fh")).where("__fh <> ''").distinct()
    if trusted is not None:
        hosts = hosts.join(trusted.select(F.lower(F.col(trusted.columns[0])).alias("__fh")).distinct(), "__fh", "left_anti")
    x = df.withColumns({"__k": key, "__h": host})
    x = x.join(urls, F.col("__k") == F.col("__fk"), "left").join(hosts.withColumn("__g", F.lit(1)), F.col("__h") == F.col("__fh"), "left")
    return x.withColumn(out, F.when(F.col("__u") == 1, "address").when(F.col("__g") == 1, "host")).drop("__k", "__h", "__fk", "__fh", "__u", "__g")


def owners(df: DataFrame, host: str, owned: DataFrame, out: str = "owner", most_labels: int = 8) -> DataFrame:
    """df with the owner of the host or of the nearest domain above it. owned: (domain, owner). Hosts are taken once; their
    endings of up to `most_labels` labels, and the whole host, meet the table by an equi-join."""
    h = df.select(F.lower(F.col(host)).alias("__h")).where("__h is not null").distinct()
    labels = F.split("__h", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".").alias("d")))
    ends = F.array_append(ends, F.struct(F.size(labels).alias("n"), F.col("__h").alias("d")))
    e = h.select("__h", F.explode(F.array_distinct(ends)).alias("e")).select("__h", "e.n", "e.d")
    best = e.join(owned.select(F.lower("domain").alias("d"), F.col("owner").alias("__o")), "d").groupBy("__h").agg(F.max_by("__o", "n").alias(out))
    x = df.withColumn("__k", F.lower(F.col(host)))
    return x.join(best, F.col("__k") == F.col("__h"), "left").drop("__k", "__h")


def target_error(url: Column) -> Column:
    """Why an address isn't to be fetched: scheme, host or port; NULL if it may be."""
    scheme, auth = F.lower(url_part(url, 1)), F.regexp_replace(url_part(url, 2), r"^.*@", "")
    given = F.try_to_number(F.nullif(F.regexp_extract(auth, r":(\d{1,5})$", 1), F.lit("")), F.lit("99999")).cast("int")
    port = F.coalesce(given, F.when(scheme == "https", 443).otherwise(80))
    return F.when(~scheme.isin("http", "https"), "scheme").when(url_host(url) == "", "host").when(~port.isin(*PORTS), "port")


@F.pandas_udf(T.BooleanType())
def is_public(ip: pd.Series) -> pd.Series:
    """Whether an address is global and no multicast one; addresses mapped into the newer form are unwrapped. NULL for what is
    no address."""

    def one(x):
        try:
            a = ipaddress.ip_address(x)
        except (ValueError, TypeError):
            return None
        a = getattr(a, "ipv4_mapped", None) or a
        return a.is_global and not a.is_multicast

    return ip.map(one).astype("boolean")
