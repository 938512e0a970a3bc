"""Tenant scope of account jobs. A tenant is the region of an account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tenant_accounts(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """account, tenant. Nation and region are dimension tables; Spark sees their
    size and broadcasts them itself."""
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("r_name").alias("tenant")
    )
    return customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("account"), "tenant"
    )


def tenant_scope(accounts: DataFrame, enabled: DataFrame) -> DataFrame:
    """Accounts of the tenants listed in ``enabled`` (column tenant)."""
    return accounts.join(enabled.select("tenant"), "tenant", "left_semi").select(
        F.col("account").alias("c_custkey"), "tenant"
    )


def one_tenant(table: DataFrame, tenant: str) -> DataFrame:
    """Rows of one tenant; on a table partitioned by tenant this prunes files."""
    if not tenant:
        raise ValueError("a tenant is required")
    return table.where(F.col("tenant") == tenant)
