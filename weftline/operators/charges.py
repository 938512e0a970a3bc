"""Billing by charge: a table of links says which invoice took which charge.

A run takes every charge since ``since`` and before its date that no link names:
those of its period, and older ones as arrears. So each charge is on exactly one
invoice, however late it arrives, whatever periods ran before and however often a
run is repeated. A charge is an order, named by its key.

Links and invoices of a run are parts of their own in a version store, published in
one step: a run that fails has billed nothing. One writer per ledger.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.billing import DUE_DAYS, MONTH, check_period, parse_date
from weftline.operators.tenancy import one_tenant
from weftline.sources.versions import VersionStore

LINKS, INVOICES = "links/", "invoices/"
MONEY = "decimal(28,2)"


def link_charges(
    orders: DataFrame,
    accounts: DataFrame,
    run_date: str | dt.date | None,
    since: str | dt.date | None,
    links: DataFrame | None = None,
    tenant: str | None = None,
    period: str = MONTH,
) -> DataFrame:
    """The charges this run bills: charge, account, tenant, day, amount, arrear.

    ``links`` (charge, day) are those of earlier runs. Both bounds are literals and
    reach the scans of orders and links; only charges of that time meet the links.
    A charge without a key, an account or a date is not billed.
    """
    check_period(period)
    first, end = F.lit(parse_date(since)), F.lit(parse_date(run_date))
    start = F.add_months(end, -1) if period == MONTH else F.date_sub(end, 1)
    in_scope = accounts if tenant is None else one_tenant(accounts, tenant)
    charges = (
        orders.where(F.col("o_orderdate") >= first.cast("timestamp_ntz"))
        .where(F.col("o_orderdate") < end.cast("timestamp_ntz"))
        .where("o_orderkey IS NOT NULL")
        .select(
            F.col("o_orderkey").alias("charge"),
            F.col("o_custkey").alias("account"),
            F.to_date("o_orderdate").alias("day"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        )
    )
    if links is not None:
        billed = links.where((F.col("day") >= first) & (F.col("day") < end)).select("charge")
        charges = charges.join(billed, "charge", "left_anti")
    return charges.join(in_scope.select("account", "tenant"), "account").withColumn("arrear", F.col("day") < start)


def invoices_of(linked: DataFrame, run_date: str | dt.date | None, run: int, period: str = MONTH) -> DataFrame:
    """One invoice per account: invoice_key, tenant, account, period_start, period_end,
    due_date, run, n_charges, amount, n_arrears, arrears. ``n_charges`` and ``amount``
    hold the arrears too. Sums are taken in the tasks first, so a busy account is no
    hot group."""
    end = F.lit(parse_date(run_date))
    start = F.add_months(end, -1) if period == MONTH else F.date_sub(end, 1)
    arrear = F.col("arrear")
    owed = F.sum(F.when(arrear, F.col("amount")).otherwise(F.lit(0).cast("decimal(18,2)")))
    totals = linked.groupBy("tenant", "account").agg(
        F.count(F.lit(1)).alias("n_charges"),
        F.sum("amount").cast(MONEY).alias("amount"),
        F.count_if(arrear).alias("n_arrears"),
        owed.cast(MONEY).alias("arrears"),
    )
    dated = totals.withColumns(
        {"period_start": start, "period_end": end, "due_date": F.date_add(end, DUE_DAYS), "run": F.lit(run)}
    )
    key = F.concat_ws(":", "tenant", "account", "period_start", "period_end", "run")
    columns = ["tenant", "account", "period_start", "period_end", "due_date", "run", "n_charges", "amount", "n_arrears", "arrears"]
    return dated.select(key.alias("invoice_key"), *columns)


class ChargeLedger:
    """Links and invoices of all runs."""

    def __init__(self, store: VersionStore, since: str | dt.date | None) -> None:
        self.store, self.since = store, parse_date(since)

    def links(self) -> DataFrame | None:
        """charge, account, tenant, day, amount, arrear, run of all runs."""
        return self.store.parts(LINKS)

    def invoices(self) -> DataFrame | None:
        return self.store.parts(INVOICES)

    def bill(
        self,
        orders: DataFrame,
        accounts: DataFrame,
        run_date: str | dt.date | None,
        tenant: str | None = None,
        period: str = MONTH,
    ) -> DataFrame:
        """Bill what is unbilled; the invoices of this run, none if nothing is owed."""
        run = 1 + len(self.store.versions(LINKS))
        linked = link_charges(orders, accounts, run_date, self.since, self.links(), tenant, period)
        links = self.store.write(linked.withColumn("run", F.lit(run)), "links")
        written = self.store.read(links)
        invoices = self.store.write(invoices_of(written, run_date, run, period), "invoices")
        self.store.publish({f"{LINKS}{run:08d}": links, f"{INVOICES}{run:08d}": invoices})
        return self.store.read(invoices)
