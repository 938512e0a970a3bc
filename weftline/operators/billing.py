"""Billing, autopay and delinquency over account charges.

Charges are orders; money is decimal. Charges are added up per account before
they meet the account table, so an account with very many charges costs one row
per task in the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.tenancy import one_tenant

MONTH, DAY = "month", "day"
DUE_DAYS = 30
DELINQUENT, COMPLIANT = "delinquent", "compliant"
PAID, PARTIAL, OPEN = "paid", "partial", "open"


def parse_date(value: str | dt.date | None) -> dt.date:
    """A run date, YYYY-MM-DD. A missing or malformed one is an error."""
    if isinstance(value, dt.date):
        return value
    if not value:
        raise ValueError("a run date is required")
    day = dt.datetime.strptime(value, "%Y-%m-%d").date()
    if day.isoformat() != value:
        raise ValueError(f"not a date of the form YYYY-MM-DD: {value!r}")
    return day


def check_period(period: str) -> None:
    if period not in (MONTH, DAY):
        raise ValueError(f"unknown billing period {period!r}")


def _amount() -> Column:
    return F.sum(F.col("o_totalprice").cast("decimal(18,2)"))


def _with_key(invoices: DataFrame) -> DataFrame:
    return invoices.select(
        F.concat_ws(":", "tenant", "account", "period_start", "period_end").alias("invoice_key"),
        "tenant",
        "account",
        "period_start",
        "period_end",
        "due_date",
        "n_charges",
        "amount",
    )


def billing_run(
    orders: DataFrame,
    accounts: DataFrame,
    run_date: str | dt.date | None,
    tenant: str | None = None,
    existing: DataFrame | None = None,
    period: str = MONTH,
) -> DataFrame:
    """Invoices of the period that ends at ``run_date`` (exclusive).

    ``tenant`` None bills every tenant. ``existing`` invoices (account,
    period_start, period_end) of any kind of period cover the days between their
    bounds: those days are not billed again, so a second run adds nothing, a month
    takes what its daily runs left, and month ends of different length do not
    overlap. The date bounds are literals and reach the scan.
    """
    check_period(period)
    end = F.lit(parse_date(run_date))
    start = F.add_months(end, -1) if period == MONTH else F.date_sub(end, 1)
    in_scope = accounts if tenant is None else one_tenant(accounts, tenant)
    days = (
        orders.where(F.col("o_orderdate") >= start.cast("timestamp_ntz"))
        .where(F.col("o_orderdate") < end.cast("timestamp_ntz"))
        .groupBy(F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("day"))
        .agg(F.count(F.lit(1)).alias("n_charges"), _amount().alias("amount"))
    )
    if existing is not None:
        first, last = F.greatest("period_start", start), F.date_sub(F.least("period_end", end), 1)
        covered = existing.where((F.col("period_end") > start) & (F.col("period_start") < end))
        covered = covered.select("account", F.explode(F.sequence(first, last)).alias("day"))  # days of one period
        days = days.join(covered, ["account", "day"], "left_anti")
    totals = (
        days.groupBy("account")
        .agg(F.sum("n_charges").alias("n_charges"), F.sum("amount").cast("decimal(28,2)").alias("amount"))
        .withColumn("period_start", start)
        .withColumn("period_end", end)
        .withColumn("due_date", F.date_add(end, DUE_DAYS))
    )
    return _with_key(totals.join(in_scope, "account"))


def all_invoices(
    orders: DataFrame, period: str = MONTH, issued_by: str | dt.date | None = None
) -> DataFrame:
    """Every calendar period's invoice of every account: account, period_start,
    issued, due_date, n_charges, amount. ``issued_by`` keeps those issued by that
    day, as a date bound that reaches the scan."""
    check_period(period)
    if issued_by is not None:
        last = parse_date(issued_by)
        last = last.replace(day=1) if period == MONTH else last
        orders = orders.where(F.col("o_orderdate") < F.lit(last).cast("timestamp_ntz"))
    day = F.to_date("o_orderdate")
    start = F.trunc(day, "month") if period == MONTH else day
    issued = F.add_months("period_start", 1) if period == MONTH else F.date_add("period_start", 1)
    return (
        orders.groupBy(
            F.col("o_custkey").alias("account"),
            start.alias("period_start"),
        )
        .agg(F.count(F.lit(1)).alias("n_charges"), _amount().alias("amount"))
        .withColumn("issued", issued)
        .withColumn("due_date", F.date_add("issued", DUE_DAYS))
    )


def funds(customer: DataFrame) -> DataFrame:
    """account, funds: the positive balance in hundredths."""
    return customer.select(
        F.col("c_custkey").alias("account"),
        (F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 100).cast("decimal(18,2)").alias("funds"),
    )


def autopay_run(invoices: DataFrame, account_funds: DataFrame) -> DataFrame:
    """Pay each account's invoices from its funds, oldest first.

    An account has one invoice per period, so a window per account is short
    however many charges lie behind it. An account without a row of funds has none;
    its invoices stay open.
    """
    oldest_first = (
        Window.partitionBy("account")
        .orderBy("period_start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("decimal(28,2)")
    prior = F.coalesce(F.sum("amount").over(oldest_first), zero)
    applied = F.greatest(zero, F.least(F.col("amount"), F.coalesce("funds", zero) - F.col("prior")))
    return (
        invoices.withColumn("prior", prior)
        .join(account_funds, "account", "left")
        .withColumn("applied", applied.cast("decimal(28,2)"))
        .withColumn("balance", (F.col("amount") - F.col("applied")).cast("decimal(28,2)"))
        .withColumn(
            "status",
            F.when(F.col("balance") == 0, PAID).when(F.col("applied") > 0, PARTIAL).otherwise(OPEN),
        )
        .drop("prior", "funds")
    )


def autopay_tenant(
    orders: DataFrame,
    accounts: DataFrame,
    account_funds: DataFrame,
    tenant: str,
    run_date: str | dt.date | None,
) -> DataFrame:
    """Autopay of one tenant's invoices issued by ``run_date``; both are required."""
    invoices = all_invoices(orders, issued_by=parse_date(run_date))
    in_scope = one_tenant(accounts, tenant).select("account")
    return autopay_run(invoices.join(in_scope, "account", "left_semi"), account_funds)


def invoice_mark(invoices: DataFrame, marks: DataFrame, as_of: str | dt.date | None) -> DataFrame:
    """Move the due date of the invoices of marked accounts to the day before
    (delinquent) or after (compliant) ``as_of``: adds due_date_marked."""
    day = F.lit(parse_date(as_of))
    moved = (
        F.when(F.col("mark") == DELINQUENT, F.date_sub(day, 1))
        .when(F.col("mark") == COMPLIANT, F.date_add(day, 1))
        .otherwise(F.col("due_date"))
    )
    return (
        invoices.join(marks.select("account", "mark"), "account", "left")
        .withColumn("due_date_marked", moved)
        .drop("mark")
    )


def invoice_delinquency(
    balances: DataFrame, as_of: str | dt.date | None, due: str = "due_date"
) -> DataFrame:
    """account, status, past_due, oldest_due as of a date. An account is
    delinquent when an unpaid invoice fell due before it."""
    overdue = (F.col("balance") > 0) & (F.col(due) < F.lit(parse_date(as_of)))
    zero = F.lit(0).cast("decimal(28,2)")
    return balances.groupBy("account").agg(
        F.when(F.bool_or(overdue), DELINQUENT).otherwise(COMPLIANT).alias("status"),
        F.sum(F.when(overdue, F.col("balance")).otherwise(zero)).cast("decimal(28,2)").alias("past_due"),
        F.min(F.when(overdue, F.col(due))).alias("oldest_due"),
    )


def delinquency_transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Accounts whose status differs: account, old_status, new_status."""
    old = before.select("account", F.col("status").alias("old_status"))
    new = after.select("account", F.col("status").alias("new_status"))
    return old.join(new, "account", "full_outer").where(
        ~F.col("old_status").eqNullSafe(F.col("new_status"))
    )
