import datetime as dt
from decimal import Decimal

import pytest
from conftest import rows, same_rows
from pyspark.sql import functions as F

from weftline.operators import billing, charges, tenancy
from weftline.operators.charges import ChargeLedger
from weftline.sources.tables import load_table
from weftline.sources.versions import VersionStore
from weftline.sources.workspace import fresh_path, stage

SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_totalprice double"


def day(text):
    return dt.datetime.fromisoformat(text)


def ledger(spark, since="1998-10-01"):
    return ChargeLedger(VersionStore(spark, fresh_path(spark, "ledger")), since)


@pytest.fixture(scope="module")
def accounts(spark, tiny):
    return tenancy.tenant_accounts(*[load_table(spark, tiny, t) for t in ("customer", "nation", "region")])


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame([(1, "ASIA"), (2, "EUROPE")], "account bigint, tenant string")


def brief(invoices):
    return rows(invoices.select("account", "run", "n_charges", "amount", "n_arrears", "arrears"))


def test_a_late_charge_is_an_arrear_of_the_next_run(spark, two):
    book = ledger(spark)
    first = spark.createDataFrame([(1, 1, day("1998-10-03"), 10.0), (2, 2, day("1998-10-03"), 20.0)], SCHEMA)
    assert brief(book.bill(first, two, "1998-10-04", period=billing.DAY)) == [
        (1, 1, 1, Decimal("10.00"), 0, Decimal("0.00")),
        (2, 1, 1, Decimal("20.00"), 0, Decimal("0.00")),
    ]
    late = first.unionByName(spark.createDataFrame([(3, 1, day("1998-10-03 12:00:00"), 99.0)], SCHEMA))
    again = late.unionByName(spark.createDataFrame([(4, 1, day("1998-11-05"), 1.5)], SCHEMA))
    assert brief(book.bill(late, two, "1998-11-01")) == [(1, 2, 1, Decimal("99.00"), 0, Decimal("0.00"))]
    later = again.unionByName(spark.createDataFrame([(5, 2, day("1998-10-30"), 7.0)], SCHEMA))
    assert brief(book.bill(later, two, "1998-12-01")) == [
        (1, 3, 1, Decimal("1.50"), 0, Decimal("0.00")),
        (2, 3, 1, Decimal("7.00"), 1, Decimal("7.00")),
    ]
    assert book.bill(later, two, "1998-12-01").isEmpty()
    links = book.links()
    assert rows(links.select("charge")) == [(1,), (2,), (3,), (4,), (5,)]


def test_every_charge_on_one_invoice(spark, tiny, accounts):
    book = ledger(spark, "1998-09-01")
    orders = load_table(spark, tiny, "orders")
    early = orders.where(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    book.bill(early, accounts, "1998-09-02", period=billing.DAY)
    book.bill(early, accounts, "1998-10-01")
    book.bill(orders, accounts, "1998-10-05", "ASIA", period=billing.DAY)
    book.bill(orders, accounts, "1998-11-01")
    book.bill(orders, accounts, "1998-11-01")
    owed = orders.where("o_orderdate >= '1998-09-01' AND o_orderdate < '1998-11-01'")
    owed = owed.join(accounts, F.col("o_custkey") == F.col("account"))
    assert rows(book.links().select("charge")) == rows(owed.select("o_orderkey"))
    total = owed.agg(F.count(F.lit(1)), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)")).first()
    billed = book.invoices().agg(F.sum("n_charges"), F.sum("amount").cast("decimal(28,2)")).first()
    assert tuple(total) == tuple(billed)
    keys = book.invoices().select("invoice_key")
    assert keys.count() == keys.distinct().count()


def test_without_late_charges_it_equals_a_run_by_period(spark, tiny, accounts):
    orders = load_table(spark, tiny, "orders")
    found = ledger(spark).bill(orders, accounts, "1998-11-01", "AMERICA")
    columns = ["account", "period_start", "period_end", "due_date", "n_charges", "amount"]
    same_rows(found.select(columns), billing.billing_run(orders, accounts, "1998-11-01", "AMERICA").select(columns))


def test_bounds_reach_both_scans(spark, tiny, accounts):
    book = ledger(spark)
    orders = load_table(spark, tiny, "orders")
    book.bill(orders, accounts, "1998-10-02", period=billing.DAY)
    plan = charges.link_charges(orders, accounts, "1998-11-01", "1998-10-01", book.links())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in text and "GreaterThanOrEqual(day" in text


def test_rows_without_key_account_or_date(spark, two):
    odd = [(None, 1, day("1998-10-03"), 1.0), (1, None, day("1998-10-03"), 1.0), (2, 1, None, 1.0), (3, 1, day("1998-10-03"), None)]
    found = ledger(spark).bill(spark.createDataFrame(odd, SCHEMA), two, "1998-11-01")
    assert brief(found) == [(1, 1, 1, None, 0, Decimal("0.00"))]
    assert ledger(spark).bill(spark.createDataFrame([], SCHEMA), two, "1998-11-01").isEmpty()


def test_dates_are_required(spark, two):
    with pytest.raises(ValueError):
        ledger(spark, None)
    with pytest.raises(ValueError):
        ledger(spark).bill(spark.createDataFrame([], SCHEMA), two, "1998-11-1")
    with pytest.raises(ValueError):
        ledger(spark).bill(spark.createDataFrame([], SCHEMA), two, "1998-11-01", period="week")


def test_a_failed_run_bills_nothing(spark, two):
    book = ledger(spark)
    orders = stage(spark.createDataFrame([(1, 1, day("1998-10-03"), 10.0)], SCHEMA), "orders")
    broken = orders.withColumn("o_totalprice", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception):
        book.bill(broken, two, "1998-11-01")
    assert book.links() is None
    assert book.bill(orders, two, "1998-11-01").count() == 1
