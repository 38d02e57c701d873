"""Sharding by a K-d tree over document metadata (DataFrame functions only).

Units are groups of equal texts, which stay together.  Only a group that alone is larger than a
leaf's target cannot; it is dealt into pieces of ``UNIT`` of the target by a hash of the id.  Groups above ``BIG`` of the target, of which
there are at most ``shards / BIG``, are too coarse for a cut: the largest first, each goes to the
emptiest leaf.  The tree shares out the rest, so that every leaf reaches the target.  A node
that must become ``n`` leaves is cut at the weighted quantile that its left leaves lack, along its widest
dimension: text size, source, language or text hash, each scaled to the range of the whole
table; sources and languages count by their rank in code-point order.  Every coordinate carries the unit's hash in its low bits, so even a source that holds
a third of all rows can be cut anywhere.  Quantiles are found by histograms of ``2**BITS`` cells
that narrow down on the cut; only sums for cells of nodes, at most ``shards * 2**BITS`` rows,
reach the driver.

Null texts have no bytes and are equal to the empty text here; null source and language rank
first, before the empty ones.  Equal texts of several sources or languages take the least.  Repeated rows stay rows.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, running_totals

UNIT, BITS, TOLERANCE = 0.004, 10, 0.0005
#: Share of a leaf's target above which a group is placed before the tree.
BIG = 0.02
#: Distinct values that may be broadcast, and parts for more of them.
FEW, SALTS = 100_000, 32
DIMS = ("size", "source", "lang", "hash")


def _ranked(rows: DataFrame, column: str) -> DataFrame:
    """Adds the rank of ``column``'s value among the distinct ones, null first."""
    seen = rows.select(column).distinct().withColumn("_one", F.lit(1))
    ranks = running_totals(seen, [F.col(column).asc_nulls_first()], "_one", tag="shard-ranks").select(F.col(column).alias("_value"), F.col("before_rows").alias(f"_{column}"))
    ranks = materialize(ranks, "shard-ranks")
    on = F.col(column).eqNullSafe(F.col("_value"))
    if ranks.count() <= FEW:
        return rows.join(F.broadcast(ranks), on).drop("_value", column)
    # a value may hold a third of the rows: deal it over SALTS parts
    ranks = ranks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_deal", F.pmod(F.xxhash64("doc_id", "_text"), F.lit(SALTS)).cast("int"))
    return rows.join(ranks, on & (F.col("_deal") == F.col("_salt"))).drop("_value", "_salt", "_deal", column)


def units(docs: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their unit's key, and the units with bytes and four coordinates of 48 bits."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
        docs["source"].cast("string").alias("source"),
        docs["lang"].cast("string").alias("lang"),
    )
    rows = materialize(rows, "shard-rows")
    rows = materialize(_ranked(_ranked(rows, "source"), "lang"), "shard-ranked")
    total = rows.agg(F.sum("size").alias("s")).first()["s"] or 0
    target = max(1, total // shards)
    large = rows.groupBy("_text").agg(F.sum("size").alias("_b")).where(F.col("_b") > target)
    large = large.select(F.col("_text").alias("_t"), F.ceil(F.col("_b") / (UNIT * target)).alias("_pieces"))
    # fewer groups than shards are that large
    rows = rows.join(F.broadcast(large), F.col("_text") == F.col("_t"), "left").drop("_t")
    rows = rows.withColumn("_piece", F.when(F.col("_pieces").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("_pieces")))).drop("_pieces")
    found = rows.groupBy("_text", "_piece").agg(
        F.sum("size").alias("bytes"), F.max("size").alias("d_size"), F.min("_source").alias("d_source"), F.min("_lang").alias("d_lang")
    )
    return rows, found.withColumn("d_hash", F.pmod(F.xxhash64("_text", "_piece"), F.lit(1 << 32)))


def kd_shards(docs: DataFrame, shards: int) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    rows, found = units(docs, shards)
    found = materialize(found, "shard-units")
    target = (found.agg(F.sum("bytes").alias("s")).first()["s"] or 0) / shards
    load = [0] * shards
    big = []
    for r in found.where(F.col("bytes") > BIG * target).orderBy(F.col("bytes").desc(), "_text", "_piece").collect():
        at = min(range(shards), key=lambda i: load[i])
        load[at] += r["bytes"]
        big.append((r["_text"], r["_piece"], at))
    space = [max(target - x, 0.0) for x in load]
    found = found.where(F.col("bytes") <= BIG * target)
    ends = found.agg(*[f(f"d_{d}").alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if not target:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    salt = F.pmod(F.xxhash64("_text", "_piece", F.lit(9)), F.lit(1 << 24))
    for d in DIMS:  # 24 bits of the scaled value above 24 bits of the unit's hash
        width = max(1, (ends[f"hi_{d}"] or 0) - (ends[f"lo_{d}"] or 0))
        scaled = F.floor((F.col(f"d_{d}") - (ends[f"lo_{d}"] or 0)) * float((1 << 24) - 1) / float(width)).cast("long")
        found = found.withColumn(f"c_{d}", F.shiftleft(scaled, 24) + salt)
    found = materialize(found.select("_text", "_piece", "bytes", *[f"c_{d}" for d in DIMS]), "shard-tree")

    leaves: dict[int, tuple[int, int]] = {0: (0, shards)}  # node -> first shard, number of shards
    node: Column = F.lit(0)
    while any(n > 1 for _, n in leaves.values()):
        here = found.withColumn("node", node)
        open_ = [k for k, (_, n) in leaves.items() if n > 1]
        box = {
            r["node"]: r
            for r in here.where(F.col("node").isin(open_))
            .groupBy("node")
            .agg(F.sum("bytes").alias("b"), *[f(F.shiftright(f"c_{d}", 24)).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))])
            .collect()
        }
        open_ = [k for k in open_ if k in box]
        axis = {k: max(DIMS, key=lambda d: box[k][f"hi_{d}"] - box[k][f"lo_{d}"]) for k in open_}
        want = {}
        for k in open_:
            first, n = leaves[k]
            here_, left_ = sum(space[first : first + n]), sum(space[first : first + n // 2])
            want[k] = box[k]["b"] * (left_ / here_ if here_ else (n // 2) / n)
        lo = dict.fromkeys(open_, 0)  # the cut lies in [lo, lo + 2**bits)
        below = dict.fromkeys(open_, 0)
        bits, todo = 48, list(open_)
        while todo and bits > 0:
            shift = max(0, bits - BITS)
            cases = None
            for k in todo:
                c = F.col(f"c_{axis[k]}") - lo[k]
                hit = (F.col("node") == k) & (c >= 0) & (c < (1 << bits))
                cell = F.shiftright(c, shift)
                cases = F.when(hit, cell) if cases is None else cases.when(hit, cell)
            cells: dict[int, dict[int, int]] = {k: {} for k in todo}
            for r in here.withColumn("cell", cases).where("cell is not null").groupBy("node", "cell").agg(F.sum("bytes").alias("b")).collect():
                cells[r["node"]][r["cell"]] = r["b"]
            left = []
            for k in todo:
                run = below[k]
                for cell in sorted(cells[k]):
                    b = cells[k][cell]
                    if run + b >= want[k]:
                        break
                    run += b
                begin = lo[k] + (cell << shift)
                if shift and b > TOLERANCE * target:
                    lo[k], below[k] = begin, run
                    left.append(k)
                else:  # the nearer edge of the cell
                    lo[k] = begin + (1 << shift) if run + b - want[k] <= want[k] - run else begin
            todo, bits = left, shift
        cut = None
        nxt, new, renamed = {}, len(leaves), {}
        for k, (first, n) in leaves.items():
            nxt[k] = (first, n)
            if k in open_:
                nxt[k], nxt[new] = (first, n // 2), (first + n // 2, n - n // 2)
                renamed[k] = new
                new += 1
            elif n > 1:
                nxt[k] = (first, 1)  # no unit at all
        for k, right in renamed.items():
            at = (F.col("node") == k) & (F.col(f"c_{axis[k]}") >= lo[k])
            cut = F.when(at, F.lit(right)) if cut is None else cut.when(at, F.lit(right))
        moved = (cut.otherwise(F.col("node")) if cut is not None else F.col("node")).alias("at")
        found = materialize(here.select("_text", "_piece", "bytes", *[f"c_{d}" for d in DIMS], moved), "shard-tree")
        node, leaves = F.col("at"), nxt
    number = None
    for k, (first, _) in leaves.items():
        number = F.when(node == k, F.lit(first)) if number is None else number.when(node == k, F.lit(first))
    placed = found.select(F.col("_text").alias("_t"), F.col("_piece").alias("_p"), number.cast("int").alias("shard"))
    if big:
        placed = placed.unionByName(spark.createDataFrame(big, "_t long, _p long, shard int"))
    rows = rows.select("doc_id", "size", "text_crc32", "_text", "_piece").join(placed, (F.col("_text") == F.col("_t")) & (F.col("_piece") == F.col("_p")))
    rows = running_totals(rows.select("doc_id", "size", "text_crc32", "shard"), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "size", ["shard"], "shard-slots")
    return rows.select("doc_id", "size", "text_crc32", "shard", F.col("before_rows").cast("long").alias("slot"))
