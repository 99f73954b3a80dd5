"""A portfolio of one's own: stored from CSV, opened in other sessions, laid out for cards and months."""

import os
import re
import subprocess
import sys
from dataclasses import replace

import pytest
from panels import statement
from pyspark.sql import functions as F

from revolva import registry
from revolva.operators import features, quality
from revolva.operators.checks import ROW_CHECKS
from revolva.sources import dirty, files, readers, schemas, store
from test_plans import PER_CARD

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def csv_folder(spark, small_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("csv"))
    p = store.load(spark, small_dir)
    for t in schemas.TABLES:
        readers.write_csv(getattr(p, t), f"{folder}/{t}.csv")
    return folder


@pytest.fixture(scope="module")
def folder(spark, csv_folder, tmp_path_factory):
    where = f"{tmp_path_factory.mktemp('stores')}/mine"
    store.save(readers.read_portfolio(spark, csv_folder, "csv", check=False), where, buckets=4)
    return where


@pytest.fixture(scope="module")
def p(spark, folder):
    return store.open_store(spark, folder)


@pytest.fixture
def plan(spark):
    """Plans as they would be with dimensions too large to broadcast."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda df: df._jdf.queryExecution().executedPlan()
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_and_types_survive(spark, p, small_dir):
    source = store.load(spark, small_dir)
    for t, schema in schemas.TABLES.items():
        got, want = getattr(p, t), getattr(source, t)
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in schema]
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("name", PER_CARD)
def test_per_card_work_needs_no_shuffle(p, plan, name):
    text = plan(registry.ON_CLEAN[name](p)).toString()
    assert "Exchange hashpartitioning" not in text and "Exchange rangepartitioning" not in text


LATEST = ["top_risk_accounts", "ead_account", "ead_portfolio", "ead_product", "ead_income", "ead_region", "ead_ccf_sensitivity", "ead_accounts_py"]


@pytest.mark.parametrize("name", LATEST)
def test_the_last_month_is_read_alone(spark, p, plan, name):
    """Statements of one month, one file per bucket, and no scan for the date of that month."""
    df = registry.ON_CLEAN[name](p)
    text = plan(df).toString()
    assert len(re.findall(r"FileScan parquet [^\n]*_statements\[", text)) == 1
    assert re.search(r"PartitionFilters: \[[^\]]*period_month#\d+ = 20", text)
    df.collect()
    scans = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(df._jdf.queryExecution().executedPlan().collectLeaves())
    read = [s.metrics().apply("numPartitions").value() for s in scans if s.metrics().contains("numPartitions")]
    assert read == [1]


def test_results_equal_those_of_the_csv(spark, p, csv_folder):
    raw = readers.read_portfolio(spark, csv_folder)
    for name in ["roll_matrix", "ead_product", "expected_loss_stage", "customer_risk_profile", "lgd_product"]:
        a, b = (registry.ON_CLEAN[name](x) for x in (p, raw))
        assert a.exceptAll(b).count() == 0 and a.count() == b.count(), name


def test_a_new_session_opens_it(folder, spark, p):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from revolva.operators import features, migration
from revolva.sources import store
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.warehouse.dir", {folder + "-other"!r}).getOrCreate())
spark.conf.set("spark.sql.adaptive.enabled", "false")
p = store.open_store(spark, {folder!r})
plan = features.roll_rate_base(p)._jdf.queryExecution().executedPlan().toString()
assert "Exchange hashpartitioning" not in plan, plan
print("ROWS", p.statements.count(), p.last_month, migration.roll_matrix(p).first().total_accounts)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=folder)
    assert done.returncode == 0, done.stderr[-2000:]
    from revolva.operators import migration

    want = f"ROWS {p.statements.count()} {p.last_month} {migration.roll_matrix(p).first().total_accounts}"
    assert want in done.stdout


def test_views_over_the_store_equal_the_operators(spark, folder, p):
    assert store.create_views(spark, folder) == list(features.VIEWS)
    assert store.create_views(spark, folder) == list(features.VIEWS)  # replaces them
    for name, build in features.VIEWS.items():
        got, want = spark.table(name), build(p)
        assert got.columns == want.columns
        doubles = {f.name for f in want.schema if f.dataType.simpleString() == "double"}
        shown = lambda df: df.select(*[F.round(c, 6).alias(c) if c in doubles else c for c in df.columns])
        assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema], name
        assert shown(got).exceptAll(shown(want)).count() == 0 and got.count() == want.count() > 0, name
    for name in features.VIEWS:
        spark.sql(f"DROP VIEW {name}")


def test_a_new_session_has_the_views(folder, spark, p):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from revolva.sources import store
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.warehouse.dir", {folder + "-views"!r}).getOrCreate())
store.create_views(spark, {folder!r})
row = spark.sql("SELECT ewi_flag, count(*) AS n FROM vw_early_warning_indicators GROUP BY ewi_flag ORDER BY ewi_flag").collect()
print("FLAGS", [(r.ewi_flag, r.n) for r in row])
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=folder)
    assert done.returncode == 0, done.stderr[-2000:]
    want = features.early_warning(p).groupBy("ewi_flag").count().orderBy("ewi_flag").collect()
    assert f"FLAGS {[(r.ewi_flag, r['count']) for r in want]}" in done.stdout


def test_checks_counted_while_saving_equal_the_single_ones(spark, small_dir, tmp_path):
    clean = store.load(spark, small_dir)
    bad = dirty.with_faults(clean)
    panel = bad.statements.dropDuplicates(["card_id", "period_month"])
    bad = replace(bad, statements=panel)
    store.save(bad, f"{tmp_path}/bad", buckets=2)
    seen = {t["name"]: t["quality"] for t in store.manifest(spark, f"{tmp_path}/bad")["tables"]}
    for table, tests in ROW_CHECKS.items():
        want = {r.issue: r["count"] for r in quality.issue_counts(getattr(bad, table), tests).collect()}
        assert {k: v for k, v in seen[table].items() if k != "rows"} == want
        assert seen[table]["rows"] == getattr(bad, table).count()
    assert sum(seen["statements"].values()) > seen["statements"]["rows"]


def test_the_battery_scans_each_table_once(p, plan):
    assert plan(quality.battery(p)).toString().count("FileScan") == 4


def test_a_changed_file_is_noticed(spark, make, tmp_path):
    folder = f"{tmp_path}/s"
    store.save(make([statement(c, m) for c in range(5) for m in range(3)]), folder, buckets=2)
    version = store.manifest(spark, folder)["version"]
    name = files.listing(spark, f"{folder}/{version}/cards")[0][0]
    with open(f"{folder}/{version}/cards/{name}", "ab") as f:
        f.write(b"x")
    with pytest.raises(store.StoreChanged, match="cards"):
        store.open_store(spark, folder)


def test_replacing_keeps_the_old_version_until_the_new_one_is_whole(spark, make, tmp_path):
    folder = f"{tmp_path}/s"
    first = make([statement(c, m) for c in range(5) for m in range(3)])
    store.save(first, folder, buckets=2)
    before = store.manifest(spark, folder)
    with pytest.raises(FileExistsError):
        store.save(first, folder)
    with pytest.raises(readers.RepeatedStatements):
        store.save(make([statement(1, 0), statement(1, 0)]), folder, buckets=2, replace=True)
    broken = replace(first, statements=first.statements.withColumn("min_due", F.raise_error(F.lit("broken")).cast("int")))
    with pytest.raises(Exception, match="broken"):
        store.save(broken, folder, buckets=2, replace=True)
    assert store.manifest(spark, folder) == before
    assert store.open_store(spark, folder).statements.count() == 15
    second = store.save(make([statement(c, m) for c in range(7) for m in range(4)]), folder, buckets=3, replace=True)
    assert second.statements.count() == 28 and str(second.last_month) == "2022-04-01"
    assert [x for x in os.listdir(folder) if x.startswith("version")] == [store.manifest(spark, folder)["version"]]


def test_nothing_is_opened_without_a_manifest(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.open_store(spark, f"{tmp_path}/none")


@pytest.mark.parametrize("by_month", [False, True])
def test_either_layout_gives_the_same(spark, make, tmp_path, by_month):
    source = make([statement(c, m, balance=100 * c + m) for c in range(9) for m in range(5)])
    p = store.save(source, f"{tmp_path}/s", buckets=3, by_month=by_month)
    assert p.statements.exceptAll(source.statements).count() == 0 and str(p.last_month) == "2022-05-01"
    assert p.latest_statements().count() == 9
    assert len(store.manifest(spark, f"{tmp_path}/s")["tables"][3]["files"]) == (3 * 5 if by_month else 3)


def test_an_empty_panel(spark, make, tmp_path):
    p = store.save(make([statement(1, 0)]), f"{tmp_path}/one", buckets=2)
    assert p.latest_statements().count() == 1
    empty = replace(p, statements=p.statements.where("false"), last_month=None)
    opened = store.save(empty, f"{tmp_path}/empty", buckets=2)
    assert opened.statements.count() == 0 and opened.last_month is None and opened.latest_statements().count() == 0


def test_changed_order_tables_are_mapped_anew(spark, small_dir, tmp_path):
    for t in store.ORDER_TABLES:
        spark.read.parquet(f"{small_dir}/{t}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    before = store.load(spark, str(tmp_path))
    assert store.load(spark, str(tmp_path)) is before
    count = before.statements.count()
    few = spark.read.parquet(f"{small_dir}/lineitem.parquet").where("l_orderkey % 2 = 0").coalesce(1)
    few.write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert store.load(spark, str(tmp_path)).statements.count() < count


def test_a_published_file_appears_once(spark, tmp_path):
    path = f"{tmp_path}/note"
    assert files.publish(spark, path, "one") and not files.publish(spark, path, "two")
    assert files.read(spark, path) == "one"
    assert files.publish(spark, path, "three", replace=True) and files.read(spark, path) == "three"
    assert [f for f in os.listdir(tmp_path) if not f.endswith(".crc")] == ["note"]
