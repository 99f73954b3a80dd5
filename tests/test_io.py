import glob
import os
from dataclasses import replace

import pytest
from panels import statement
from pyspark.sql import functions as F

from revolva.operators import exports, features
from revolva.sources import readers, schemas, store


@pytest.fixture(scope="module")
def p(spark, small_dir):
    return store.load(spark, small_dir)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_portfolio_round_trip(spark, p, tmp_path, fmt):
    for t in schemas.TABLES:
        writer = readers.write_csv if fmt == "csv" else readers.write_parquet
        writer(getattr(p, t), f"{tmp_path}/{t}.{fmt}")
    back = readers.read_portfolio(spark, str(tmp_path), fmt)
    for t, schema in schemas.TABLES.items():
        got = getattr(back, t)
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in schema]
        assert got.exceptAll(getattr(p, t)).count() == 0 and got.count() == getattr(p, t).count()


def test_malformed_csv_stops_the_read(spark, tmp_path):
    path = tmp_path / "cards.csv"
    path.write_text("card_id,customer_id,product_type,credit_limit\n1,1,classic,1000\n2,x,classic,1000\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_csv(spark, str(path), "cards").collect()


def test_repeated_statements_are_refused(make):
    with pytest.raises(readers.RepeatedStatements, match="1 repeated"):
        readers.check_panel(make([statement(1, 0), statement(1, 0), statement(1, 1)]).statements)
    readers.check_panel(make([statement(1, 0), statement(1, 1)]).statements)


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        readers.read_portfolio(spark, "/nowhere", "xml")


def test_six_exports(spark, p, tmp_path):
    exports.write_all(p, str(tmp_path))
    for name, build in exports.EXPORTS.items():
        back = spark.read.option("header", True).csv(f"{tmp_path}/{name}")
        want = build(p)
        assert back.columns == want.columns
        assert back.count() == want.count() > 0


def test_exports_appear_together_and_once(spark, p, tmp_path, monkeypatch):
    folder = f"{tmp_path}/out"
    counts = exports.write_all(p, folder)
    assert counts == {name: build(p).count() for name, build in exports.EXPORTS.items()}
    assert {r.export: r.rows for r in exports.export_files(p, folder).collect()} == counts
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/**", recursive=True)}
    assert exports.write_all(p, folder) == counts
    assert {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/**", recursive=True)} == before
    # A run that fails leaves the former exports valid, and nothing of its own.
    broken = {**exports.EXPORTS, "T6_expected_loss": lambda p: p.cards.withColumn("card_id", F.raise_error(F.lit("broken")).cast("string"))}
    with monkeypatch.context() as m:
        m.setattr(exports, "EXPORTS", broken)
        with pytest.raises(Exception, match="broken"):
            exports.write_all(replace(p, version="another"), folder)
    assert exports.exported(spark, folder)["rows"] == counts
    assert not [x for x in os.listdir(folder) if x.startswith(".staged")]
    # Lost or changed files are written again.
    os.remove(glob.glob(f"{folder}/T2_monthly_trend/part-*.csv")[0])
    assert exports.exported(spark, folder) is None
    assert exports.write_all(p, folder) == counts and exports.exported(spark, folder)["rows"] == counts


def test_views_answer_sql(spark, p):
    p.create_views()
    for name, build in features.VIEWS.items():
        assert spark.table(name).columns == build(p).columns
    got = spark.sql(
        "select current_bucket, count(*) n from vw_roll_rate_base r join cards c on c.card_id = r.card_id "
        "group by current_bucket"
    )
    assert sum(r.n for r in got.collect()) == features.roll_rate_base(p).count()


def test_shared_folder_comes_from_the_session(spark):
    assert store.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_buckets_come_from_the_configuration(spark):
    assert store.default_buckets(spark) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_folder(Session)
