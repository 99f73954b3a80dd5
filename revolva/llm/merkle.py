"""A Merkle manifest of a table: a root over all rows, and for each row a proof that leads to it.

A row's digest is its leaf. The leaves of a source, ascending by doc_id, are joined 16 at a
time into parents until one node is left, the source's subroot; the subroots, ordered by
source, are joined in the same way into the root. A proof is the digests of a node's
siblings, level by level.

Each level is a window over consecutive nodes with lags and leads of fixed offsets: at
level l, the rows at multiples of 16**l hold the level's nodes, so a lag or lead of
k * 16**l rows is the k-th sibling. A node's slot (its place among 16) and the length of its
run (the last one is shorter) mask the offsets that belong to another run. The first child
of each run hashes the parent. The other rows take over the siblings of their node from the
nearest node row before them.

A window never holds a whole source. Sources are cut into blocks of ``BLOCK`` consecutive
rows, whole subtrees of ``LEVELS`` levels, and the top nodes of all blocks are the rows of the
next round. Positions come from a range partitioning by (source, doc_id, leaf) and one count
for each source and partition, so a source may hold any share of the rows. The rounds go
down again with the siblings of the blocks above, one row per block.

Equal rows: ties of doc_id are ordered by leaf, so equal rows are interchangeable, and a
proof may belong to any of them. Leaves and positions are stored in the shared folder, so
that all rounds and the second way down see the same ones, also after the loss of an executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revolva.llm.session import stored

ARITY = 16
#: Levels of a round, and the rows of a window.
LEVELS = 2
BLOCK = ARITY**LEVELS

#: Columns of documents that a leaf covers, in this order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIBLINGS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of parts put together; nulls among them are skipped."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf(**replaced: Column) -> Column:
    """The digest of a row; ``replaced`` gives other values for some columns."""
    values = [replaced.get(c, F.col(c)).cast("string") for c in COVERED]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def _group(source: Column) -> Column:
    """A name of a source that is never null and sorts like it, null first, by bytes."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their 0-based place within ``grp`` in ``order``, and ``n``, the size of ``grp``.

    ``order`` may have ties among rows that need not be told apart.
    """
    spread = (
        rows.withColumn("_any", F.monotonically_increasing_id())  # splits rows that are equal otherwise
        .repartitionByRange("grp", *order, "_any")
        .sortWithinPartitions("grp", *order, "_any")
        .drop("_any")
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_row", 33))
    )
    kept = stored(spread, "merkle-order")
    # One row for each group and partition that holds some of it.
    counts = kept.groupBy("grp", "_slice").agg(F.count(F.lit(1)).alias("_count"), F.min("_row").alias("_least"))
    within = Window.partitionBy("grp")
    before = F.sum("_count").over(within.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select(
        "grp", "_slice", (F.coalesce(before, F.lit(0)) - F.col("_least")).alias("_shift"), F.sum("_count").over(within).alias("n")
    )
    return kept.join(places, ["grp", "_slice"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_row", "_slice", "_shift")


def climbed(nodes: DataFrame) -> DataFrame:
    """Nodes (grp, pos, n, node) with block and, for each level l of a round, their siblings ``left_l``, ``right_l``.

    ``top`` is the digest of the block's top node, on the block's first row. A level with a
    single node in its group has no siblings, and its node stays as it is.
    """
    rows = "OVER (PARTITION BY grp, block ORDER BY pos)"
    df = nodes.withColumns({"block": F.floor(F.col("pos") / BLOCK), "top": F.col("node")})
    for level in range(LEVELS):
        step = ARITY**level
        place = f"(pos DIV {step})"
        slot = f"({place} % {ARITY})"
        run = f"least({ARITY}, (n + {step - 1}) DIV {step} - ({place} - {slot}))"
        is_node = f"(pos % {step} = 0 AND n > {step})"
        before = [f"CASE WHEN {slot} >= {k} THEN lag(top, {k * step}) {rows} END" for k in range(ARITY - 1, 0, -1)]
        after = [f"CASE WHEN {slot} + {k} < {run} THEN lead(top, {k * step}) {rows} END" for k in range(1, ARITY)]
        left, right = f"left_{level}", f"right_{level}"
        df = df.selectExpr(
            "*",
            f"CASE WHEN {is_node} THEN concat_ws('', {', '.join(before)}) END AS {left}",
            f"CASE WHEN {is_node} THEN concat_ws('', {', '.join(after)}) END AS {right}",
        )
        first = F.expr(f"{is_node} AND {slot} = 0")
        df = df.withColumn("top", F.when(first, digest(F.col("top"), F.col(right))).otherwise(F.col("top")))
        if level:
            latest = lambda c: F.expr(f"last({c}, true) {rows}")  # noqa: E731  of this row and the ones before
            df = df.withColumns({left: latest(left), right: latest(right)})
    return df


def _tops(df: DataFrame) -> DataFrame:
    """The top nodes of all blocks, as nodes of the next round."""
    return df.where(F.col("pos") % BLOCK == 0).select(
        "grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("node")
    )


def _path(above: str | None = None) -> Column:
    """The siblings of a node from its own level up, as pairs of the digests left and right of it."""
    own = [
        F.struct(F.col(f"left_{level}").alias("left"), F.col(f"right_{level}").alias("right")) for level in range(LEVELS)
    ]
    path = F.filter(F.array(*own), lambda x: x["left"].isNotNull())
    return F.concat(path, F.col(above)) if above else path


def ladder(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(peaks, blocks) of nodes (grp, pos, n, node).

    ``peaks`` is (grp, node), one row for each group. ``blocks`` is (grp, block, path), the
    siblings from each block's top node up to the peak.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    rounds = [nodes]
    while True:
        rounds.append(stored(_tops(climbed(rounds[-1])), "merkle-nodes"))
        most = -(-most // BLOCK)
        if most <= 1:
            break
    peaks = rounds[-1].select("grp", "node")
    above = rounds[-1].select("grp", F.col("pos").alias("block"), F.array().cast(_SIBLINGS).alias("path"))
    for level in reversed(rounds[1:-1]):
        joined = climbed(level).join(above.withColumnRenamed("path", "_above"), ["grp", "block"])
        above = stored(joined.select("grp", F.col("pos").alias("block"), _path("_above").alias("path")), "merkle-paths")
    return peaks, above


def proven(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """``nodes`` with ``path``, the siblings of each up to the peak of its group."""
    carried = [c for c in nodes.columns if c not in ("n", "node")]
    return (
        climbed(nodes)
        .join(blocks.withColumnRenamed("path", "_above"), ["grp", "block"])
        .select(*carried, _path("_above").alias("path"))
    )


def folded(start: Column, path: Column) -> Column:
    """The digest that a node and its siblings lead to."""
    return F.aggregate(path, start, lambda acc, x: digest(x["left"], acc, x["right"]))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, from left to right."""
    return digest(F.concat_ws("", F.transform(path, lambda x: F.concat(x["left"], x["right"]))))


def manifest(documents: DataFrame, tampered: Column | None = None, altered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row of ``documents``.

    A leaf covers doc_id, source, lang, n_chars and text: `-` for null, else the value's byte
    count, `:` and the value. To check the proofs, the texts of the rows that ``tampered``
    selects are replaced by ``altered`` (A-Z in lower case by default) and ``folded_root`` is
    the root that such a leaf and the original siblings lead to; ``verified`` tells whether
    it is the root. Rows whose doc_id is null are never tampered with unless the condition is
    true for them, and come first in their source.

    Null, empty and very long texts have leaves like others; other columns are ignored. A
    table of a single row has the leaf as root and no siblings. An empty table gives no rows.
    """
    chosen = F.lit(False) if tampered is None else tampered
    other = lowered(F.col("text")) if altered is None else altered
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _group(F.col("source")).alias("grp"),
        leaf().alias("node"),
        F.when(chosen, leaf(text=other)).alias("changed"),
    )
    # Texts are read and hashed once.
    leaves = numbered(stored(rows, "merkle-leaves"), ["doc_id", "node"])
    kept = stored(leaves, "merkle-positions")
    subroots, blocks = ladder(kept.select("grp", "pos", "n", "node"))
    sources = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "node"), ["source"])
    sources = stored(sources, "merkle-sources")
    root, upper = ladder(sources.select("grp", "pos", "n", "node"))
    tops = proven(sources.select("grp", "source", "pos", "n", "node"), upper).select(
        F.col("source").alias("grp"), F.col("path").alias("upper")
    )
    tops = stored(tops.join(subroots.withColumnRenamed("node", "subroot"), "grp"), "merkle-subroots")
    # One row per block: the way from the block to the root.
    to_root = blocks.join(tops, "grp").select("grp", "block", F.concat("path", "upper").alias("path"), "subroot")
    peak = root.select("node").scalar()
    found = (
        climbed(kept)
        .join(to_root.withColumnRenamed("path", "_above"), ["grp", "block"])
        .select("doc_id", F.col("node").alias("leaf"), "changed", "subroot", _path("_above").alias("path"))
    )
    shown = found.select(
        "doc_id",
        "leaf",
        "subroot",
        peak.alias("root"),
        proof(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"),
    )
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))
