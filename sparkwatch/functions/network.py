"""IPv6 networks, which Spark has no function for: an Arrow-batched UDF."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _inside(text: str | None, net: ipaddress.IPv4Network | ipaddress.IPv6Network) -> bool:
    try:
        return ipaddress.ip_address((text or "").strip()) in net
    except ValueError:
        return False


@F.pandas_udf(T.BooleanType())
def in_ipv6_network(address: pd.Series, network: pd.Series) -> pd.Series:
    """Whether an address (in any spelling) is in a network; what is no address is not."""
    nets = {n: ipaddress.ip_network(n, strict=False) for n in network.unique()}
    return pd.Series([_inside(a, nets[n]) for a, n in zip(address, network, strict=True)])


def register(spark: SparkSession) -> None:
    if not spark.catalog.functionExists("in_ipv6_network"):
        spark.udf.register("in_ipv6_network", in_ipv6_network)
