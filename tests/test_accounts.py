import datetime as dt
from decimal import Decimal

import pytest
from conftest import rows, same_rows
from pyspark.sql import functions as F

from weftline.operators import billing, locations, tenancy
from weftline.sources.tables import load_table, schema_of
from weftline.sources.workspace import fresh_path
from weftline.streaming import locations as stream


@pytest.fixture(scope="module")
def accounts(spark, tiny):
    tables = [load_table(spark, tiny, t) for t in ("customer", "nation", "region")]
    return tenancy.tenant_accounts(*tables)


@pytest.fixture(scope="module")
def orders(spark, tiny):
    return load_table(spark, tiny, "orders")


def test_tenant_scope(spark, accounts):
    enabled = spark.createDataFrame([("ASIA",), ("AFRICA",)], "tenant string")
    got = tenancy.tenant_scope(accounts, enabled)
    assert {r.tenant for r in got.collect()} == {"ASIA", "AFRICA"}
    with pytest.raises(ValueError):
        tenancy.one_tenant(accounts, "")


@pytest.mark.parametrize("bad", [None, "", "1998-1-01", "19980101", "1998-02-30", "01.11.1998"])
def test_run_date_is_required_and_strict(orders, accounts, bad):
    with pytest.raises(ValueError):
        billing.billing_run(orders, accounts, bad, "ASIA")


def test_unknown_period(orders, accounts):
    with pytest.raises(ValueError):
        billing.billing_run(orders, accounts, "1998-11-01", "ASIA", period="week")


def test_second_run_adds_nothing(orders, accounts):
    first = billing.billing_run(orders, accounts, "1998-11-01").cache()
    assert first.count() > 0
    assert billing.billing_run(orders, accounts, "1998-11-01", existing=first).isEmpty()
    other = billing.billing_run(orders, accounts, "1998-12-01", existing=first)
    same_rows(other, billing.billing_run(orders, accounts, "1998-12-01"))


def test_days_then_month_bill_each_charge_once(orders, accounts):
    days = billing.billing_run(orders, accounts, "1998-10-02", period=billing.DAY)
    for date in ("1998-10-03", "1998-10-07"):
        days = days.unionByName(billing.billing_run(orders, accounts, date, existing=days, period=billing.DAY))
    month = billing.billing_run(orders, accounts, "1998-11-01", existing=days)
    both = days.unionByName(month)
    whole = billing.billing_run(orders, accounts, "1998-11-01")
    charges = lambda df: df.agg(F.sum("n_charges"), F.sum("amount").cast("decimal(28,2)")).first()
    assert charges(both) == charges(whole)
    assert both.count() == both.select("invoice_key").distinct().count()
    assert billing.billing_run(orders, accounts, "1998-10-05", existing=both, period=billing.DAY).isEmpty()


def test_month_ends_do_not_overlap(orders, accounts):
    march = billing.billing_run(orders, accounts, "1998-03-31")
    april = billing.billing_run(orders, accounts, "1998-04-30", existing=march)
    n = orders.where("o_orderdate >= '1998-02-28' AND o_orderdate < '1998-04-30'").join(
        accounts, F.col("o_custkey") == F.col("account")
    )
    assert march.unionByName(april).agg(F.sum("n_charges")).first()[0] == n.count()


def test_autopay_of_a_tenant_needs_both(spark, tiny, orders, accounts):
    purses = billing.funds(load_table(spark, tiny, "customer"))
    for tenant, date in (("", "1998-01-15"), ("ASIA", None), ("ASIA", "1998-1-15")):
        with pytest.raises(ValueError):
            billing.autopay_tenant(orders, accounts, purses, tenant, date)
    paid = billing.autopay_tenant(orders, accounts, purses, "ASIA", "1998-01-15")
    plan = paid._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_orderdate" in plan
    assert paid.agg(F.max("issued")).first()[0] <= dt.date(1998, 1, 15)


def test_month_is_the_sum_of_its_days(orders, accounts):
    monthly = billing.billing_run(orders, accounts, "1996-03-01", "EUROPE")
    days = None
    for i in range(29):
        day = billing.billing_run(
            orders, accounts, dt.date(1996, 2, 2) + dt.timedelta(i), "EUROPE", period=billing.DAY
        )
        days = day if days is None else days.unionByName(day)
    total = lambda df: rows(df.groupBy("account").agg(F.sum("amount").cast("decimal(28,2)"), F.sum("n_charges")))
    assert total(monthly) == total(days)


def test_runs_equal_all_invoices(orders, accounts):
    run = billing.billing_run(orders, accounts, "1998-11-01").select("account", "period_start", "due_date", "n_charges", "amount")
    every = billing.all_invoices(orders).where(F.col("issued") == F.lit(dt.date(1998, 11, 1)))
    same_rows(run, every.drop("issued"))


def test_date_bounds_reach_the_scan(orders, accounts):
    plan = billing.billing_run(orders, accounts, "1998-11-01", "ASIA")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "o_orderpriority" not in plan


def money(x):
    return Decimal(x).quantize(Decimal("0.01"))


def test_autopay_pays_oldest_first(spark):
    invoices = spark.createDataFrame(
        [(1, dt.date(2000, m, 1), money(100)) for m in (1, 2, 3)]
        + [(2, dt.date(2000, 1, 1), money(5)), (3, dt.date(2000, 1, 1), money(7))],
        "account bigint, period_start date, amount decimal(28,2)",
    )
    purse = spark.createDataFrame(
        [(1, money(150)), (2, money(5)), (3, money(0))], "account bigint, funds decimal(18,2)"
    )
    got = rows(billing.autopay_run(invoices, purse).select("account", "period_start", "applied", "balance", "status"), "account", "period_start")
    assert [(r[0], r[2], r[3], r[4]) for r in got] == [
        (1, money(100), money(0), "paid"),
        (1, money(50), money(50), "partial"),
        (1, money(0), money(100), "open"),
        (2, money(5), money(0), "paid"),
        (3, money(0), money(7), "open"),
    ]


def test_funds_ignore_debts(spark):
    customers = spark.createDataFrame([(1, -5.0), (2, 2.25)], "c_custkey bigint, c_acctbal double")
    assert rows(billing.funds(customers)) == [(1, money(0)), (2, money(225))]


def test_marking_moves_status_both_ways_and_back(spark, tiny, orders):
    as_of = "1998-01-15"
    customers = load_table(spark, tiny, "customer")
    paid = billing.autopay_run(billing.all_invoices(orders), billing.funds(customers)).cache()
    start = billing.invoice_delinquency(paid, as_of).cache()
    everyone = customers.select(F.col("c_custkey").alias("account"))

    def marked(balances, mark):
        out = billing.invoice_mark(balances, everyone.withColumn("mark", F.lit(mark)), as_of)
        return out.drop("due_date").withColumnRenamed("due_date_marked", "due_date")

    late = marked(paid, billing.DELINQUENT)
    good = marked(late, billing.COMPLIANT)
    assert billing.invoice_delinquency(good, as_of).where("status = 'delinquent'").isEmpty()
    owing = paid.where("balance > 0").select("account").distinct().count()
    assert billing.invoice_delinquency(late, as_of).where("status = 'delinquent'").count() == owing
    same_rows(billing.invoice_delinquency(marked(late, "none"), as_of), billing.invoice_delinquency(late, as_of))
    to_late = billing.delinquency_transitions(start, billing.invoice_delinquency(late, as_of))
    assert {(r.old_status, r.new_status) for r in to_late.collect()} == {("compliant", "delinquent")}
    to_good = billing.delinquency_transitions(start, billing.invoice_delinquency(good, as_of))
    assert {(r.old_status, r.new_status) for r in to_good.collect()} == {("delinquent", "compliant")}
    assert billing.delinquency_transitions(start, start).isEmpty()


# --- locations -------------------------------------------------------------


def test_append_is_idempotent(spark, tiny):
    events = load_table(spark, tiny, "events")
    path = fresh_path(spark, "log")
    locations.write_log(locations.with_day(events.where("value > 50")), path)
    same_rows(locations.location_append(spark, path, events.unionByName(events)), events)
    same_rows(locations.location_append(spark, path, events), events)
    once = fresh_path(spark, "log-once")
    locations.location_append(spark, once, events.repartition(8))
    files = spark.read.parquet(once).select(locations.DAY, F.col("_metadata.file_path").alias("file")).distinct()
    assert files.count() == files.select(locations.DAY).distinct().count()


def test_first_append_makes_the_log_and_null_times_repeat_once(spark):
    rows = spark.createDataFrame([(1, None), (2, None)], "event_id bigint, ts timestamp_ntz")
    path = fresh_path(spark, "log")
    assert locations.location_append(spark, path, rows).count() == 2
    assert locations.location_append(spark, path, rows).count() == 2


def test_late_events_reach_the_log(spark, tiny):
    events = load_table(spark, tiny, "events")
    source, path, offsets = (fresh_path(spark, n) for n in ("source", "log", "offsets"))
    late = "ts < timestamp_ntz'2024-01-15'"
    for part in (events.where(f"NOT {late}"), events.where(late)):
        part.coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(schema_of("events")).parquet(source)
        stream.start_location_log(arriving, path, offsets).awaitTermination()
    same_rows(spark.read.schema(schema_of("events")).parquet(path).select(events.columns), events)


def test_invoices_without_funds_stay_open(spark):
    invoices = spark.createDataFrame([(1, "2024-01-01", 5.0)], "account bigint, period_start string, amount double")
    invoices = invoices.withColumn("amount", F.col("amount").cast("decimal(28,2)"))
    paid = billing.autopay_run(invoices, spark.createDataFrame([], "account bigint, funds decimal(18,2)")).collect()
    assert [(r["status"], float(r["balance"])) for r in paid] == [("open", 5.0)]


def test_latest(spark, tiny):
    events = load_table(spark, tiny, "events")
    newest = {}
    for r in events.collect():
        if r.user_id not in newest or (r.ts, r.event_id) > newest[r.user_id][:2]:
            newest[r.user_id] = (r.ts, r.event_id, r.value)
    got = {r.user_id: (r.ts, r.event_id, r.value) for r in locations.location_latest(events).collect()}
    assert got == newest


def test_stream_log_equals_batch_log(spark, tiny):
    events = load_table(spark, tiny, "events")
    source, path, offsets = (fresh_path(spark, n) for n in ("source", "log", "offsets"))
    early = events.where("ts < timestamp_ntz'2024-01-15'")
    for part in (early, events):  # the first half arrives twice, in order
        part.orderBy("ts").coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(schema_of("events")).parquet(source)
        stream.start_location_log(arriving, path, offsets).awaitTermination()
    same_rows(spark.read.schema(schema_of("events")).parquet(path).select(events.columns), events)
