"""Portfolios stored so that work on a card needs no shuffle and work on a month reads that month.

``save`` writes the tables below a folder and ``open_store`` reads them in any later session. Tables
of cards are bucketed by ``card_id``, so joins, aggregations and windows on the card read
co-located data. Statements are also partitioned by month, or sorted by month within their
buckets where the files of a month would be small. A card has at most one statement per
month, so no bucket can be dominated by a single card.

A manifest, published last and whole, makes a stored version valid: schemas, buckets, the last month,
the counts of the quality checks, which are taken while the rows are written, and all files
with their sizes. A version that was not finished is never read, and a changed file is noticed.

The order tables of a folder are mapped and stored on first use, and again when they change.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revolva.config import DEFAULTS, RiskConfig
from revolva.operators import checks, views
from revolva.plans.portfolio import Portfolio
from revolva.sources import files, mapping
from revolva.sources.dirty import with_faults
from revolva.sources.readers import check_panel
from revolva.sources.schemas import CLUSTER_KEY, TABLES

MANIFEST = "manifest.json"
MONTH = "period_month"
ORDER_TABLES = ("customer", "nation", "region", "orders", "lineitem")
#: Bytes of order lines for each bucket and month from which months get files of their own.
MONTH_BYTES = 4 << 20

_stored: dict[tuple[str, str], tuple[str, Portfolio]] = {}
_lock = threading.Lock()


class StoreChanged(ValueError):
    """The files of a store are not those that its manifest lists."""


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session may fall back to a temporary folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="revolva-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared folder and read it back: a cut of lineage that survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/revolva-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Changes whenever a file of the order tables does."""
    return hashlib.md5(json.dumps(_inputs(spark, sf_dir)).encode()).hexdigest()


def _inputs(spark: SparkSession, sf_dir: str) -> dict[str, list[files.File]]:
    return {t: files.listing(spark, f"{sf_dir.rstrip('/')}/{t}.parquet") for t in ORDER_TABLES}


def default_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def derive(spark: SparkSession, sf_dir: str) -> Portfolio:
    """The mapped portfolio as lazy frames over the order tables."""
    people = mapping.holders(spark, sf_dir)
    stmts = mapping.statements(people, mapping.activity(spark, sf_dir))
    return Portfolio(mapping.customers(people), mapping.cards(people), stmts, mapping.writeoffs(stmts))


@dataclass(frozen=True)
class Stored:
    """One table of a stored version."""

    name: str
    schema: str
    buckets: int
    monthly: bool
    last_month: str | None
    quality: dict[str, int]
    files: list[files.File]


def _sorting(name: str, monthly: bool) -> list[str]:
    key = CLUSTER_KEY[name]
    return [MONTH, key] if name == "statements" and not monthly else [key]


def _table_name(path: str, name: str) -> str:
    return f"revolva_{hashlib.md5(path.encode()).hexdigest()[:12]}_{name}"


def _write(df: DataFrame, name: str, path: str, buckets: int, spread: bool, by_month: bool = False) -> Stored:
    """Write a table below ``path`` and count its faults on the way. ``spread`` deals rows to buckets first."""
    spark, key = df.sparkSession, CLUSTER_KEY[name]
    panel, clustered = name == "statements", name != "customers"
    monthly = panel and by_month
    counts = checks.ROW_CHECKS.get(name, {})
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    if spread and clustered:
        df = df.repartition(buckets, key)
    month = F.col(MONTH).cast("string") if panel else F.lit(None).cast("string")
    observed = df.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.max(month).alias("last_month"),
        *[F.count_if(test()).alias(check) for check, test in counts.items()],
    )
    writer = observed.write.mode("error")
    if monthly:
        writer = writer.partitionBy(MONTH)
    table = _table_name(path, name)
    if clustered:
        writer.option("path", f"{path}/{name}").bucketBy(buckets, key).sortBy(*_sorting(name, monthly)).saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # its files stay; open_store declares it from the manifest
    else:
        writer.parquet(f"{path}/{name}")
    schema = json.dumps(df.schema.jsonValue())
    quality = dict(seen.get)
    last = quality.pop("last_month")
    return Stored(name, schema, buckets if clustered else 0, monthly, last, quality, files.listing(spark, f"{path}/{name}"))


def _declare(spark: SparkSession, path: str, table: Stored) -> DataFrame:
    """The frame of a stored table, which becomes a table of the session's catalog."""
    schema = T.StructType.fromJson(json.loads(table.schema))
    name = _table_name(path, table.name)
    if not spark.catalog.tableExists(name):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        layout = f"PARTITIONED BY ({MONTH}) " if table.monthly else ""
        if table.buckets:
            order = ", ".join(_sorting(table.name, table.monthly))
            layout += f"CLUSTERED BY ({CLUSTER_KEY[table.name]}) SORTED BY ({order}) INTO {table.buckets} BUCKETS "
        spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet {layout}LOCATION '{path}/{table.name}'")
        months = sorted({f[0].partition("/")[0] for f in table.files})
        if table.monthly and months:
            added = " ".join("PARTITION ({}='{}')".format(*m.split("=")) for m in months)
            spark.sql(f"ALTER TABLE {name} ADD {added}")
    return spark.table(name).select(schema.fieldNames())


def _publish(spark: SparkSession, folder: str, version: str, tables: list[Stored], source: str | None, replace: bool) -> None:
    manifest = {
        "version": version,
        "source": source,
        "last_month": next(t.last_month for t in tables if t.name == "statements"),
        "tables": [vars(t) for t in sorted(tables, key=lambda t: t.name)],
    }
    if not files.publish(spark, f"{folder}/{MANIFEST}", json.dumps(manifest, indent=1), replace):
        raise FileExistsError(f"{folder} holds a portfolio; save with replace=True")


def save(p: Portfolio, folder: str, buckets: int | None = None, by_month: bool = True, replace: bool = False) -> Portfolio:
    """Store a portfolio of one's own below ``folder`` and open it.

    ``buckets`` (default: spark.sql.shuffle.partitions) should give buckets of one month some
    100 MB; with ``by_month`` False, the months of a bucket share a file. Repeated (card, month) keys are refused before the version becomes valid. With
    ``replace``, a version that was there stays valid until the new one is published, and
    is deleted then. A version that fails leaves the folder as it was.
    """
    spark, folder = p.statements.sparkSession, folder.rstrip("/")
    if not replace and files.exists(spark, f"{folder}/{MANIFEST}"):
        raise FileExistsError(f"{folder} holds a portfolio; save with replace=True")
    before = manifest(spark, folder)["version"] if files.exists(spark, f"{folder}/{MANIFEST}") else None
    count = buckets or default_buckets(spark)
    version = f"version-{uuid.uuid4().hex}"
    path = f"{folder}/{version}"
    try:
        with ThreadPoolExecutor(len(TABLES) + 1) as pool:
            frames = {name: getattr(p, name) for name in TABLES} | {"holders": p.holders}
            tables = list(pool.map(lambda x: _write(x[1], x[0], path, count, True, by_month), frames.items()))
        stored = {t.name: t for t in tables}
        check_panel(_declare(spark, path, stored["statements"]))
        _publish(spark, folder, version, tables, None, replace)
    except BaseException:
        files.remove(spark, path)
        raise
    if before:
        files.remove(spark, f"{folder}/{before}")
    return open_store(spark, folder)


def manifest(spark: SparkSession, folder: str) -> dict:
    """What the valid version of a store holds, also the counts of the quality checks."""
    path = f"{folder.rstrip('/')}/{MANIFEST}"
    if not files.exists(spark, path):
        raise FileNotFoundError(f"no portfolio is stored in {folder}")
    return json.loads(files.read(spark, path))


def open_store(spark: SparkSession, folder: str, check: bool = True) -> Portfolio:
    """The portfolio stored in a folder, in this or any later session.

    With ``check``, files are listed and compared with the manifest first, by name and size.
    """
    folder = folder.rstrip("/")
    held = manifest(spark, folder)
    path = f"{folder}/{held['version']}"
    frames = {}
    for entry in held["tables"]:
        table = Stored(**entry)
        if check:
            now = [f[:2] for f in files.listing(spark, f"{path}/{table.name}")]
            if now != [tuple(f[:2]) for f in table.files]:
                raise StoreChanged(f"the files of {table.name} in {folder} are not those of its manifest")
        frames[table.name] = _declare(spark, path, table)
    last = held["last_month"] and date.fromisoformat(held["last_month"])
    return Portfolio(
        *[frames[t] for t in TABLES], stored_holders=frames["holders"], last_month=last, version=held["version"]
    )


def create_views(spark: SparkSession, folder: str, cfg: RiskConfig = DEFAULTS) -> list[str]:
    """Create the six feature views over a stored portfolio, in the current database, or replace them.

    Tables and views are defined by text: a catalog that outlives the session keeps both.
    """
    folder = folder.rstrip("/")
    open_store(spark, folder)
    path = f"{folder}/{manifest(spark, folder)['version']}"
    named = views.texts({t: _table_name(path, t) for t in TABLES}, cfg)
    for name, text in named.items():
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS {text}")
    return list(named)


def load(spark: SparkSession, sf_dir: str) -> Portfolio:
    """The mapped portfolio of an order book, stored on first use and whenever the book changes."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    source = fingerprint(spark, key[1])
    with _lock:
        known = _stored.get(key)
        if known is None or known[0] != source:
            known = _stored[key] = (source, _store(spark, key[1], source))
        return known[1]


def _store(spark: SparkSession, sf_dir: str, source: str) -> Portfolio:
    folder = f"{shared_folder(spark)}/revolva-portfolio-{source}-{spark.sparkContext.applicationId}"
    if files.exists(spark, f"{folder}/{MANIFEST}"):
        return open_store(spark, folder)
    count = default_buckets(spark)
    version = f"version-{uuid.uuid4().hex}"
    path = f"{folder}/{version}"
    people = mapping.holders(spark, sf_dir)
    # Both sides of the join are spread over the buckets beforehand, so that the
    # joined statements are already where the write needs them.
    act = mapping.activity(spark, sf_dir).repartition(count, "card_id")
    stmts = mapping.statements(people.repartition(count, "card_id"), act)
    customers, cards = mapping.customers(people), mapping.cards(people)
    holders = Portfolio(customers, cards, stmts, stmts).holders

    lines = sum(size for _, size, _ in _inputs(spark, sf_dir)["lineitem"])
    by_month = lines >= MONTH_BYTES * count * mapping.MONTHS

    def panel() -> list[Stored]:
        written = _write(stmts, "statements", path, count, False, by_month)
        losses = mapping.writeoffs(_declare(spark, path, written))
        return [written, _write(losses, "writeoffs", path, count, False)]

    with ThreadPoolExecutor(4) as pool:
        first = pool.submit(panel)
        others = [pool.submit(_write, df, name, path, count, True) for name, df in (("customers", customers), ("cards", cards), ("holders", holders))]
        tables = first.result() + [x.result() for x in others]
    _publish(spark, folder, version, tables, source, False)
    return open_store(spark, folder, check=False)


def load_dirty(spark: SparkSession, sf_dir: str) -> Portfolio:
    """The mapped portfolio with planted data-quality faults."""
    return with_faults(load(spark, sf_dir))
