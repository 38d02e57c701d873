"""Suffix-array dedup by distributed prefix doubling, up to a threshold of ``L`` bytes.

Every byte covered by an ``L``-byte string that also starts earlier (smaller id, or same document
and earlier start) is removed.  Suffixes are ranked by growing prefixes, and one that is unique
drops out (prefix doubling with discarding).  So that not every byte becomes a row, stretches
are settled first whose windows need no rank of their own:

1. Each window of ``L`` bytes is named by its anchor, the least hash of its ``GRAM``-byte substrings.
   Equal windows have equal anchors, so windows whose anchor is unique in the corpus are unique and go.
2. Successive windows with one anchor form a segment.  Of equal segments only the first can bring
   anything new: the others repeat it as a whole (those within one text are known without a shuffle).
   Segments alone under their anchor go too.
3. The segments left are cut, at places counted from their anchor, into blocks of ``STEP`` windows. All windows
   of a block hold its core, so the core takes the anchor's part and step 2 is done again.
4. The windows left are ranked by their first ``L / 4`` bytes, then by pairs of ranks at growing
   offsets: positions with equal pairs get the least of them as new rank, a rank held once is
   discarded, and the next prefix joins each position with the one that its half ends at.  A window
   whose rank at ``L`` is not its own position repeats.

Ranks are 64-bit hashes of exact substrings at first, then positions.  A position is the document's key
and the offset in one number; the longest text sets how many bits the offset gets.  Anchors that many
segments share are dealt over salted parts.  Null and empty texts have no bytes.  Ids that are null,
repeated, negative or too large for a position are replaced by their place in the order (id, text)
while working; repeated rows are told apart by that place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART, arrow_schema, discard, materialize, running_totals, small_batches, take_turn, text_buffers
from .kernels import gram_hash, prefix_hash, sliding_min, span_hash

L, GRAM, STEP = 100, 20, 8
#: Bits that hold any offset: a value in Spark has fewer than 2**31 bytes.
WIDEST = 31
#: Frequent anchors that are broadcast, at most.
FEW = 100_000


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``key`` (0 up, in order), doc_id, text; and the bits that an offset takes."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    one = rows.select("doc_id", F.octet_length("text").alias("b"))
    s = one.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("b").alias("b")).first()
    shift = max(1, (s["b"] or 0).bit_length())
    if s["n"] >= 1 << (63 - shift):
        raise ValueError(f"{s['n']} texts of up to {s['b']} bytes have more positions than 63 bits number")
    if s["n"] == s["d"] and s["n"] and s["lo"] >= 0 and s["hi"] < 1 << (63 - shift):
        return rows.withColumn("key", F.col("doc_id")), shift
    placed = running_totals(rows.withColumn("_one", F.lit(1)), [F.col("doc_id").asc_nulls_first(), F.col("text")], "_one", tag="suffix-keys")
    return materialize(placed.select("doc_id", "text", F.col("before_rows").alias("key")), "suffix-docs"), shift


def segments(data: np.ndarray, length: int = L) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: first and last window start of each segment, its anchor's hash and its own."""
    prefix = prefix_hash(data)
    at, last, place, grams = _anchored(prefix, length)
    return at, last, grams[place], span_hash(prefix, at, last + length)


def blocks(data: np.ndarray, chosen: np.ndarray, length: int = L) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of the blocks in the segments that begin at ``chosen``; the core's hash is the anchor's."""
    prefix = prefix_hash(data)
    at, last, place, _ = _anchored(prefix, length)
    mine = np.isin(at, chosen)
    at, last, place = at[mine], last[mine], place[mine]
    n = last - at + 1
    origin = np.repeat(place - (length - GRAM), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)
    core = origin + (start - origin) // STEP * STEP
    head = np.ones(len(start), bool)
    head[1:] = (core[1:] != core[:-1]) | (origin[1:] != origin[:-1])
    lo = np.flatnonzero(head)
    hi = np.append(lo[1:] - 1, len(start) - 1)[: len(lo)]
    first, final, core = start[lo], start[hi], core[lo]
    return first, final, span_hash(prefix, core + STEP - 1, core + length), span_hash(prefix, first, final + length)


def _anchored(prefix: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start of each segment, its anchor's place, and the hashes of all grams."""
    grams = gram_hash(prefix, GRAM)
    w = length - GRAM + 1
    # the place in the low bits: of equal grams in one window the leftmost is the anchor
    place = np.uint64((1 << WIDEST) - 1)
    least = sliding_min((grams & ~place) | np.arange(len(grams), dtype=np.uint64), w)
    at = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(at[1:] - 1, len(least) - 1)
    return at, last, (least[at] & place).astype(np.int64), grams


def _texts(batch, column: int):
    data, off = text_buffers(batch.column(column))
    for i in range(len(off) - 1):
        yield i, data[off[i] : off[i + 1]]


def _settle(first: np.ndarray, last: np.ndarray, a: np.ndarray, h: np.ndarray):
    """Of one text's segments the first of each kind, then the runs of windows that repeat one of them."""
    order = np.lexsort((first, last - first, h, a))
    same = np.append(False, (a[order][1:] == a[order][:-1]) & (h[order][1:] == h[order][:-1]) & (np.diff((last - first)[order]) == 0))
    fresh, known = np.sort(order[~same]), np.sort(order[same])
    if not len(known):
        return fresh, known, known
    lo, hi = first[known], last[known]
    head = np.append(True, lo[1:] > hi[:-1] + 1)
    cut = np.flatnonzero(head)
    return fresh, lo[cut], np.maximum.reduceat(hi, cut)


def _segment_rows(rows: DataFrame, length: int, shift: int) -> DataFrame:
    """Segments, or the blocks of ``spans`` where that column is there; runs known to repeat have no ``a`` and ``h``."""
    cut = "spans" in rows.columns
    schema = "a long, h long, pos long, n int"
    arrow = arrow_schema(schema)

    def run(batches):
        take_turn("suffixes")
        for batch in batches:
            keys = batch.column(0).to_pylist()
            spans = batch.column(2).to_pylist() if cut else None
            parts: list[tuple] = []
            runs: list[tuple] = []
            for i, data in _texts(batch, 1):
                if len(data) >= length:
                    first, last, a, h = blocks(data, np.array([s["o"] for s in spans[i]]), length) if cut else segments(data, length)
                    fresh, lo, hi = _settle(first, last, a, h)
                    base = keys[i] << shift
                    parts.append((a[fresh], h[fresh], base + first[fresh], (last - first + 1)[fresh]))
                    if len(lo):
                        runs.append((base + lo, hi - lo + 1))
            if parts:
                a, h, pos, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(h.view(np.int64)), pa.array(pos), pa.array(n.astype(np.int32))], schema=arrow)
            if runs:
                pos, n = (np.concatenate(x) for x in zip(*runs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(pos), pa.int64()), pa.nulls(len(pos), pa.int64()), pa.array(pos), pa.array(n.astype(np.int32))], schema=arrow)

    return rows.select("key", "text", *["spans"] * cut).mapInArrow(run, schema)


def _prefixes(length: int) -> list[int]:
    """The lengths that are ranked: a quarter of the threshold (rounded up), then doubled up to it."""
    out = [-(-length // 4)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def _places(own: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Where ranks of the second length are needed: the windows, and what later pairs reach from them."""
    at = own
    for short, full in reversed(list(zip(lengths[1:], lengths[2:], strict=False))):
        at = np.unique(np.concatenate([at, at + full - short]))
    return at


def _pairs(rows: DataFrame, length: int, shift: int) -> DataFrame:
    """``r1, r2, pos, own``: first rank pairs of the windows of ``spans`` (array of first start, number) and of the places that they reach."""
    schema = "r1 long, r2 long, pos long, own boolean"
    arrow = arrow_schema(schema)
    lengths = _prefixes(length)

    def run(batches):
        take_turn("suffixes")
        for batch in batches:
            keys, spans = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, data in _texts(batch, 1):
                g = gram_hash(prefix_hash(data), lengths[0])
                own = np.unique(np.concatenate([np.arange(s["o"], s["o"] + s["n"]) for s in spans[i]]))
                at = _places(own, lengths)
                second = g[at + lengths[1] - lengths[0]]
                yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), pa.array(second.view(np.int64)), pa.array((keys[i] << shift) + at), pa.array(np.isin(at, own))], schema=arrow)

    return rows.select("key", "text", "spans").mapInArrow(run, schema)


def _ranked(pairs: DataFrame, tag: str) -> DataFrame:
    """``pos, own, rank``: the least position with the same pair; positions whose pair is unique are discarded."""
    ranks = pairs.groupBy("r1", "r2").agg(F.min("pos").alias("rank"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return materialize(pairs.join(ranks, ["r1", "r2"]).select("pos", "own", "rank"), tag)


def _repeated(pairs: DataFrame, length: int) -> DataFrame:
    """``pos`` of the windows whose ``length`` bytes start earlier, by doubling."""
    lengths = _prefixes(length)
    ranks = _ranked(pairs, "suffix-ranks")
    for short, full in zip(lengths[1:], lengths[2:], strict=False):
        second = ranks.select((F.col("pos") - (full - short)).alias("pos"), F.col("rank").alias("r2"))
        was, ranks = ranks, _ranked(ranks.withColumnRenamed("rank", "r1").join(second, "pos"), "suffix-ranks")
        discard(was)
    return ranks.where("own and pos > rank").select("pos")


def _cut(rows: DataFrame, length: int) -> DataFrame:
    """Apply ``spans`` (array of first start, number of windows; null: none)."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"
    arrow = arrow_schema(schema)

    def run(batches):
        take_turn("suffixes")
        for batch in batches:
            spans, out = batch.column(2).to_pylist(), []
            for i, data in _texts(batch, 1):
                gone: list[list[int]] = []
                for s in sorted(spans[i] or (), key=lambda s: s["o"]):
                    a, b = s["o"], s["o"] + s["n"] - 1 + length
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], b)
                    else:
                        gone.append([a, b])
                sha, at = hashlib.sha256(), 0
                for a, b in gone:
                    sha.update(data[at:a])
                    at = b
                sha.update(data[at:])
                out.append((len(data), sum(b - a for a, b in gone), len(gone), sha.hexdigest(), [{"start": a, "end": b} for a, b in gone]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:], strict=True)]], schema=arrow)

    return rows.select("doc_id", "text", "spans").mapInArrow(run, schema)


def _dealt(rows: DataFrame, counted: DataFrame, key: list[str], by: str) -> DataFrame:
    """``rows`` that have their ``key`` in ``counted`` (one row for each, with the number ``_c``); frequent keys are dealt over parts.

    Fewer than ``FEW`` keys can have more rows than their ``FEW``-th share, so the list of those is broadcast.
    """
    bar = max(PART, (counted.agg(F.sum("_c").alias("s")).first()["s"] or 0) // FEW)
    parts = F.ceil(F.col("_c") / bar).cast("int")
    many = counted.where(F.col("_c") > bar).select(*key, parts.alias("_parts"))
    rows = rows.join(F.broadcast(many), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    one = counted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_c") > bar, parts - 1).otherwise(0)))).drop("_c")
    return rows.join(one, [*key, "_salt"]).drop("_salt")


def remove_repeats(docs: DataFrame, length: int = L, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte spans)."""
    spark = docs.sparkSession
    small_batches(spark, 200)
    rows, shift = _keyed(docs, id_col, text_col)

    def by_doc(df: DataFrame) -> DataFrame:
        span = F.struct(F.col("pos").bitwiseAND((1 << shift) - 1).cast("int").alias("o"), "n")
        return df.groupBy(F.shiftright("pos", shift).alias("_key")).agg(F.collect_list(span).alias("spans"))

    def sift(every: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Runs of windows that repeat as a whole, and what may repeat in part (with its documents' texts)."""
        known = every.where("a is null").select("pos", "n")
        shared = materialize(every.where("a is not null").groupBy("a").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1"), "suffix-anchors")
        again = materialize(_dealt(every.where("a is not null"), shared, ["a"], "pos"), "suffix-shared")
        discard(shared)
        firsts = materialize(again.groupBy("a", "h", "n").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("_c")), "suffix-firsts")
        repeats = firsts.where("_c > 1")
        whole = materialize(known.unionByName(_dealt(again, repeats, ["a", "h", "n"], "pos").where("pos <> first").select("pos", "n")), "suffix-whole")
        discard(again)
        discard(every)
        several = firsts.groupBy("a").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
        left = materialize(by_doc(_dealt(firsts.drop("_c"), several, ["a"], "first").select(F.col("first").alias("pos"), "n")), "suffix-left")
        discard(firsts)
        return whole, rows.join(left, F.col("key") == F.col("_key"))

    whole, left = sift(materialize(_segment_rows(rows, length, shift), "suffix-segments"))
    parts, left = sift(materialize(_segment_rows(left, length, shift), "suffix-blocks"))
    pairs = materialize(_pairs(left, length, shift), "suffix-pairs")
    repeated = _repeated(pairs, length).select("pos", F.lit(1).alias("n"))
    spans = materialize(by_doc(whole.unionByName(parts).unionByName(repeated)), "suffix-spans")
    for used in (whole, parts, pairs):
        discard(used)
    return _cut(rows.join(spans, F.col("key") == F.col("_key"), "left"), length)
