"""Document fingerprints from closed syncmers.

A window of ``K`` bytes is a closed syncmer if the least hash among its inner substrings of
``S`` bytes stands at its first or last place.  Whether it is chosen depends on its own bytes
alone, so the same passage gives the same anchors in every document.  A fingerprint holds all
anchors of a text, by hash, with their byte positions, as hex: 16 digits each, 33 bits of hash and 31
of position, which hold any place in a value that Spark can hold.  Likeness is the share of both texts' anchors that they share; shared anchors count
only if they lie on one diagonal (the commonest shift, within ``DRIFT`` bytes), so that a
passage must keep its place to count.

Nulls and empty texts have the empty fingerprint; texts shorter than ``K`` have one anchor, the
hash of the whole text.  Two equal fingerprints have likeness 1, an empty one and any other 0.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, partitions, small_batches, take_turn
from .kernels import gram_hash, prefix_hash, sliding_min

K, S, DRIFT = 24, 8, 64
#: Bytes of fingerprints that a worker holds before it passes rows on.
HELD = 16 << 20
_HASH_BITS, _PLACE_BITS = 33, 31
_WHERE = (1 << _PLACE_BITS) - 1


def syncmers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (``_HASH_BITS``) and positions of all closed syncmers of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < K:
        if not len(raw):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        whole = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big") >> (64 - _HASH_BITS)
        return np.array([whole], np.uint64), np.zeros(1, np.int64)
    prefix = prefix_hash(raw)
    inner = gram_hash(prefix, S)
    w = K - S + 1
    least = sliding_min(inner, w)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[w - 1 :] == least))
    return gram_hash(prefix, K)[at] >> np.uint64(64 - _HASH_BITS), at


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All anchors in order of their hash; a hash that recurs keeps its first position."""
    h, at = syncmers(data)
    h, first = np.unique(h, return_index=True)
    return h, at[first]


def to_hex(h: np.ndarray, at: np.ndarray) -> str:
    packed = (h << np.uint64(_PLACE_BITS)) | at.astype(np.uint64)
    return packed.astype(">u8").tobytes().hex()


def from_hex(text: str) -> tuple[np.ndarray, np.ndarray]:
    packed = np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)
    return packed >> np.uint64(_PLACE_BITS), (packed & np.uint64(_WHERE)).astype(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the union's anchors that both hold, in place."""
    (ha, pa_), (hb, pb) = a, b
    if len(ha) == len(hb) and (ha == hb).all() and (pa_ == pb).all():
        return 1.0
    if not len(ha) or not len(hb):
        return 0.0
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    shift = np.sort(pb[ib] - pa_[ia])
    on_line = np.searchsorted(shift, shift + DRIFT, side="right") - np.arange(len(shift))
    return float(on_line.max()) / (len(ha) + len(hb) - len(both))


def edited(text: str, following: str) -> str:
    """The last ``len // 2`` code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents dealt to ranges of descending id; a range ends with a copy of the next range's first document.

    The texts cross the network once.  Only ids are looked at beforehand, and of those only one
    bound for each range comes to the driver.  Ids that recur are ordered by their texts; rows
    without an id come last.  The last document is followed by the first.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    bounds = rows.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (20 * n))
    bounds = sorted({int(b) for b in bounds})
    place = F.lit(0)
    if bounds:
        # how many bounds lie above: ranges count from the largest ids
        listed = F.array(*[F.lit(b) for b in bounds])
        place = F.lit(len(bounds)) - F.aggregate(listed, F.lit(0), lambda s, b: s + F.when(F.col("doc_id") > b, 1).otherwise(0))
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(place))
    heads = rows.groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()  # one for each range
    used = [(r["part"], r["head"]) for r in heads]
    before = {part: used[i - 1][0] for i, (part, _) in enumerate(used)}  # the first range follows the last
    copies = spark.createDataFrame(
        [(part, head, before[part]) for part, head in used], "p int, head long, to int"
    )
    # of a head's repeated rows the first by text is the one that follows; the others are dropped by the reader
    halo = (
        rows.join(F.broadcast(copies), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("head")))
        .select("doc_id", "text", F.col("to").alias("part"), F.lit(1).alias("halo"))
    )
    return (
        rows.withColumn("halo", F.lit(0))
        .unionByName(halo)
        .repartition(n, "part")
        .sortWithinPartitions("part", "halo", F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last())
    )


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness (see the module)."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    arrow = arrow_schema(schema)
    small_batches(docs.sparkSession)

    def run(batches):
        take_turn("syncmers")
        out: list[tuple] = []
        size = 0
        held = None  # (part, id, text, anchors) that waits for the document after it

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        def close(nxt_text, nxt_anchors):
            nonlocal size
            _, doc, text, mine = held
            new = edited(text, nxt_text)
            data = new.encode()
            other = anchors(data)
            out.append(
                (doc, len(text), hashlib.sha256(data).hexdigest(), to_hex(*mine), to_hex(*other), likeness(mine, other), likeness(mine, nxt_anchors))
            )
            size += 16 * (len(mine[0]) + len(other[0]))

        for batch in batches:
            for doc, text, part, halo in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if halo and (held is None or held[0] != part):
                    continue  # a repeated row of the head
                text = text or ""
                mine = anchors(text.encode())
                if held is not None:
                    close(text, mine)
                held = None if halo else (part, doc, text, mine)
                if size >= HELD:
                    yield rows()
                    out.clear()
                    size = 0
            if out:
                yield rows()
                out.clear()
                size = 0

    return with_next(docs, id_col, text_col).mapInArrow(run, schema)
