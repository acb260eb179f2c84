"""Deployment inventories: many configurations as normalised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.schemas import INVENTORY

# What an absent setting means.
DEFAULTS = {
    "dim_deployment": {
        "workers": "auto",
        "admin_address": "127.0.0.1",
        "admin_port": "8053",
        "log_level": "info",
        "policy": "round_robin",
        "upstream_timeout": "800ms",
    },
    "dim_listener": {"transport": "udp"},
    "dim_backend": {"port": "53", "weight": "1"},
}


def with_defaults(dims: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Fill absent values; present ones - also bad ones - are left for validation."""
    out = {}
    for name, df in dims.items():
        for col, value in DEFAULTS.get(name, {}).items():
            df = df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))
        out[name] = df
    return out


def read_inventory(spark: SparkSession, path: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The raw tables below ``path`` with their fixed schemas (parquet or json)."""
    return {name: spark.read.schema(schema).format(fmt).load(f"{path}/{name}") for name, schema in INVENTORY.items()}


def load_inventory(spark: SparkSession, path: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The tables below ``path`` with defaults filled in."""
    return with_defaults(read_inventory(spark, path, fmt))


def explode_regions(regions: DataFrame) -> DataFrame:
    """(config_id, region_pos, name, client_cidrs array) to one row per CIDR.

    An empty or missing list leaves one row without CIDR, so that it can be reported.
    """
    return regions.selectExpr(
        "config_id", "region_pos", "name AS region", "posexplode_outer(client_cidrs) AS (cidr_pos, cidr)"
    )
