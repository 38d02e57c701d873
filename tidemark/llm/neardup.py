"""MinHash near-dedup by a signature-coordinate inverted join.

1. Texts become sets of hashed word shingles; equal sets are one set from here on.
2. Each set is posted under its ``K`` (coordinate, value) pairs.  Pairs that only one set has are
   skipped.  Two linked sets agree in ``t`` coordinates at least (6.5 standard deviations below the
   agreement expected at the threshold), so a set with fewer shared pairs is out, and of the others
   the ``K - t + 1`` rarest pairs meet at least once (prefix).
3. Of the posted sets the shingles are counted: a set most of whose shingles are nobody else's
   cannot reach the threshold and goes.  Only shingles of two sets or more are kept, with the level
   of their count in the high bits.
4. Posting lists are not paired.  Every list has a leader, the set with the most company; members
   are compared with it once, however many lists they share.  A member differs from the leader's
   shared shingles ``P`` by ``m`` that it lacks and ``o`` that it adds.  Two members whose
   differences have nothing in common are linked if and only if ``cost_a + cost_b <= W``, where
   ``cost = 100 m + percent o`` and ``W = (100 - percent) |P|``; whoever fits that with the cheapest
   member is linked to it, which joins all such pairs.
5. What is left are pairs that share a difference.  ``(100 + percent) * shared >= cost_a + cost_b - W``
   bounds how many they must share, so differences are posted by prefix again, rarest first, and
   pairs meet only where both have enough left that others share.  These candidates are confirmed on
   the sets.

Lists of near copies grow with their group, and so do the rows made here, but not with its square:
near copies differ from their leader each in its own way.  Hot lists and leaders are dealt over
salted parts.  Components of the links are found by alternating stars.

Null, empty and wordless texts have no shingles and no links.  Rows without an id form no links.
Equal texts fall together whatever their ids; rows of one id with different texts are judged each
by its own text.  Only the id and text columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, discard, materialize, partitions, row_blocks, salted, small_batches, take_turn, text_buffers
from .kernels import COEF_LOWER, _splitmix, mix, prefix_hash, shingles, span_hash, words

K = 64
_A = _splitmix(K, 101) | np.uint64(1)
_B = _splitmix(K, 202)
#: Set numbers that may be broadcast.
FEW = 1_000_000
#: Bits of a shingle's hash below the level of its count.
LEVEL = 56


def shingle_sets(batch_column: pa.Array, n: int = 5):
    """The sorted distinct shingle hashes of each text, in order."""
    data, off = text_buffers(batch_column)
    for lo, hi in row_blocks(off, 1 << 19):
        part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        starts, ends, first = words(part, at)
        hashed = span_hash(prefix_hash(part, COEF_LOWER), starts, ends)
        found, doc = shingles(hashed, first, n)
        cut = np.searchsorted(doc, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield np.unique(found[cut[i] : cut[i + 1]])


def signature(found: np.ndarray) -> np.ndarray:
    """``K`` minima of 32 bits under random linear maps."""
    least = np.full(K, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(found), 512):
        part = (found[i : i + 512, None] * _A[None, :] + _B[None, :]) >> np.uint64(32)
        np.minimum(least, part.min(axis=0), out=least)
    return least.astype(np.uint32)


def _sums(found: np.ndarray) -> tuple[int, int, int]:
    """What names a set: its size and two sums over its hashes."""
    if not len(found):
        return 0, 0, 0
    return len(found), int(found.sum(dtype=np.uint64).view(np.int64)), int(mix(found ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64).view(np.int64))


def _signatures(docs: DataFrame, n: int) -> DataFrame:
    schema = "doc_id long, n_shingles long, s1 long, s2 long, sig array<int>"
    arrow = arrow_schema(schema)

    def run(batches):
        take_turn("neardup")
        for batch in batches:
            rows = [(*_sums(found), signature(found).view(np.int32) if len(found) else None) for found in shingle_sets(batch.column(1), n)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, f.type) for x, f in zip(cols, list(arrow)[1:], strict=True)]], schema=arrow)

    return docs.mapInArrow(run, schema)


def _full_sets(docs: DataFrame, n: int) -> DataFrame:
    schema = "doc_id long, n_shingles long, s1 long, s2 long, shingles array<long>"
    arrow = arrow_schema(schema)

    def run(batches):
        take_turn("neardup")
        for batch in batches:
            ids, rows, held = batch.column(0).to_pylist(), [], 0

            def flush():
                return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

            for doc, found in zip(ids, shingle_sets(batch.column(1), n), strict=True):
                rows.append((doc, *_sums(found), found.view(np.int64)))
                held += len(found)
                if held > 1 << 19:
                    yield flush()
                    rows, held = [], 0
            if rows:
                yield flush()

    return docs.mapInArrow(run, schema)


def components(edges: DataFrame, tag: str = "component") -> DataFrame:
    """``a, b`` links -> ``node, root`` (least reachable node); alternating large and small stars."""
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), tag)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        was, e = e, materialize(small, tag)
        discard(was)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def agreement(threshold: float) -> int:
    return max(1, int(K * threshold - 6.5 * math.sqrt(K * threshold * (1 - threshold))))


def _posts(reps: DataFrame, t: int) -> DataFrame:
    """``rep, key, df, score``: the rarest shared coordinate values of every set that shares ``t`` or more."""
    n = partitions(reps.sparkSession)
    every = reps.select("rep", F.posexplode("sig").alias("c", "v")).select("rep", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v").cast("long")).alias("key")).repartition(n, "key")
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = every.join(shared, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("p"), F.sum(F.log2("df")).alias("score"))
    rarest = F.slice("p", 1, F.greatest(F.size("p") - (t - 1), F.lit(0)))
    return mine.select("rep", "score", F.explode(rarest).alias("x")).select("rep", "score", "x.key", "x.df")


def _shared_shingles(docs: DataFrame, posted: DataFrame, n: int, percent: int) -> DataFrame:
    """``rep, size, ys``: of the sets that can link at all, the shingles that other sets have too."""
    key = ["n_shingles", "s1", "s2"]
    ids = materialize(posted.select("least").distinct(), "minhash-ids")
    few = F.broadcast(ids) if ids.count() <= FEW else ids
    texts = docs.join(few, F.col("doc_id") == F.col("least"), "left_semi")
    sets = _full_sets(texts, n).join(posted.select("rep", *key), key).groupBy("rep", F.col("n_shingles").alias("size")).agg(F.first("shingles").alias("x"))
    every = sets.select("rep", "size", F.explode("x").alias("x")).repartition(partitions(docs.sparkSession), "x")
    df = every.groupBy("x").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    level = F.least(F.floor(4 * F.log2("df")), F.lit(127)).cast("long")
    y = F.shiftleft(level, LEVEL).bitwiseOR(F.col("x").bitwiseAND((1 << LEVEL) - 1))
    mine = every.join(df, "x").groupBy("rep", "size").agg(F.collect_list(y).alias("ys"))
    out = materialize(mine.where(100 * F.size("ys") >= percent * F.col("size")), "minhash-sets")
    discard(ids)
    return out


def _differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``head, rep, cost, w, f, post``: what each member costs and the differences it is posted under."""
    head = sets.select(F.col("rep").alias("head"), F.col("ys").alias("ps"))
    counts = members.groupBy("head").agg(F.count(F.lit(1)).alias("_n"))
    mine = members.join(counts, "head").join(sets, "rep")
    both = salted(mine, head.join(counts, "head"), "head", "rep", "_n")
    both = both.select("head", "rep", "size", F.size("ys").alias("known"), F.size("ps").alias("np"), F.array_except("ps", "ys").alias("lacks"), F.array_except("ys", "ps").alias("adds"))
    m, lone = F.size("lacks"), F.col("size") - F.col("known")
    both = both.withColumns({"m": m.cast("long"), "o": F.size("adds") + lone, "w": ((100 - percent) * F.col("np")).cast("long")})
    both = both.withColumn("cost", 100 * F.col("m") + percent * F.col("o"))
    able = F.col("m") + F.size("adds")  # differences that another member may share
    need = F.greatest(F.lit(1), F.ceil((F.col("cost") - F.col("w")) / 100))
    both = both.withColumns({"able": able, "need": need, "f": (100 + percent) * able - F.col("cost")})
    take = F.greatest(F.lit(0), F.least(F.col("able"), F.col("m") + F.col("o") - F.col("need") + 1 - lone)).cast("int")
    order = F.concat(F.sort_array("adds"), F.transform(F.sort_array("lacks", asc=False), lambda y: -y))
    fits = (F.col("able") >= F.col("need")) & (F.col("f") >= percent * F.col("need") - F.col("w"))
    return both.select("head", "rep", "cost", "w", "f", F.when(fits, F.slice(order, 1, take)).alias("post"))


def _candidates(members: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different components that share a difference from a leader and may share enough.

    ``f`` of a posting counts only what stands at its place or later: the first difference that a
    pair shares has all others behind it.  Pairs that the cheapest member joins are not looked for.
    """
    mine = members.join(roots, F.col("rep") == F.col("node"), "left").select("head", "rep", "cost", "w", "f", "post", F.coalesce("root", "rep").alias("comp"))
    several = mine.groupBy("head").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("cost").alias("least"), F.min(F.when(F.size("post") > 0, F.col("cost"))).alias("low"))
    several = several.where("lo <> hi").select("head", "least", "low")
    rows = mine.where(F.size("post") > 0).join(several, "head").select("head", "rep", "cost", "w", "f", "comp", "least", "low", F.posexplode("post").alias("at", "d"))
    rows = rows.withColumn("f", F.col("f") - (100 + percent) * F.col("at")).where("f > -least OR (cost + least > w AND f >= low - w)").drop("at", "least", "low")
    shared = rows.groupBy("head", "d").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("head", "d")
    rows = materialize(rows.join(shared, ["head", "d"], "left_semi"), "minhash-differences")
    side = lambda s: rows.select("head", "d", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "cost", "f", "comp")], *["w"] * (s == "a"))
    met = side("a").join(side("b"), ["head", "d"]).where("rep_a < rep_b AND comp_a <> comp_b AND f_a >= cost_b - w AND f_b >= cost_a - w")
    return met.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda s: sets.select(F.col("rep").alias(s), F.col("size").alias(f"n{s}"), F.col("ys").alias(f"y{s}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("i", F.size(F.array_intersect("ya", "yb")))
    return both.where(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable), kept."""
    small_batches(docs.sparkSession)
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    key = ["n_shingles", "s1", "s2"]
    signed = materialize(_signatures(base, n), "minhash")
    reps = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"))
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "minhash-reps")
    named = reps.select("rep", "least", *key)

    posts = materialize(_posts(reps, agreement(percent / 100)), "minhash-posts")
    sets = _shared_shingles(base, named.join(posts.select("rep").distinct(), "rep", "left_semi"), n, percent)

    # every list has the leader with the most company; a list that lost all members but one is out
    able = posts.join(sets.select("rep"), "rep", "left_semi")
    heads = able.groupBy("key").agg(F.max(F.struct("score", "rep")).alias("h"), F.count(F.lit(1)).alias("n"), F.first("df").alias("df")).where("n > 1")
    led = salted(able.select("key", "rep", "df"), heads.select("key", F.col("h.rep").alias("head"), "df"), "key", "rep", "df")
    members = materialize(led.select("head", "rep").distinct(), "minhash-members")
    discard(posts)

    differ = materialize(_differences(members, sets, percent), "minhash-differ")
    cheapest = differ.groupBy("head").agg(F.min(F.struct("cost", "rep")).alias("c")).select("head", F.col("c.rep").alias("b"), F.col("c.cost").alias("least_cost"), F.lit(0).cast("long").alias("_"))
    counts = differ.groupBy("head").agg(F.count(F.lit(1)).alias("_n"))
    star = salted(differ.select("head", "rep", "cost", "w").join(counts, "head"), cheapest.drop("_").join(counts, "head"), "head", "rep", "_n")
    links = materialize(star.where("rep <> b AND cost + least_cost <= w").select(F.col("rep").alias("a"), "b").distinct(), "minhash-links")
    more = _confirmed(_candidates(differ, components(links), percent), sets, percent)
    roots = components(links.unionByName(more))

    rooted = named.join(roots, F.col("rep") == F.col("node"), "left").select("least", *key, F.coalesce("root", "rep").alias("root"))
    found = rooted.groupBy("root").agg(F.min("least").alias("found"))
    rooted = rooted.join(found, "root").select(*[F.col(k).alias(f"_{k}") for k in key], "found")
    on = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    for k in key:
        on = on & (F.col(k) == F.col(f"_{k}"))
    out = signed.select("doc_id", *key).join(rooted, on, "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
