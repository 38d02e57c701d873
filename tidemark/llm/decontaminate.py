"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Texts are compared as lower-cased words (maximal runs of letters and digits); every character of a
script written without spaces, and every symbol beyond ASCII, is a word of its own.  Seeds are all
``N``-word grams of the benchmark items, however common: which of an item's grams an edited copy
keeps is not known beforehand.  An item of fewer than ``N`` words is one seed, which documents are
searched for at its own length.  A document that holds a seed of an item is aligned with it:
matches score 2, mismatches and gaps -1, over the stretch of the document around each cluster of
seeds.  Stretches are passed over only if too few of their words are the item's to reach
``least`` at all.  The score is the share of the item's best possible score, so edited copies
keep most of it.  Pairs that reach ``least`` are contaminated.

The benchmark is split into blocks of at most ``BLOCK`` bytes, and each block is one pass over the
documents: nothing larger is ever sent to a worker.  Null and empty texts and items match nothing.
Rows and items without an id keep it null; repeated rows give repeated pairs, and items of one id
with different texts are searched for each.  Only the id and text columns are looked at; ``clean``
hands the others on as they are.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, row_blocks, small_batches, take_turn, text_buffers
from .kernels import COEF_LOWER, code_points, prefix_hash, shingles, span_hash

N, LEAST, BLOCK = 4, 0.5, 4 << 20
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True
#: Letters of scripts written without spaces: Thai to Lao, Burmese, Khmer, Tai, Han with kana and bopomofo.
UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF))


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point: 0 stands between words, 1 is part of a word, 2 is a word of its own."""
    kind = np.ones(0x110000, np.uint8)
    for lo, hi in UNSPACED:
        kind[lo : hi + 1] = 2
    for c in range(0x20000):
        cat = unicodedata.category(chr(c))
        if cat[0] in "PZ" or cat == "Cc" or c in (0x200B, 0x2060, 0xFEFF):
            kind[c] = 0
        elif cat[0] == "S":
            kind[c] = 2
    return kind


def _kind_of_bytes(data: np.ndarray) -> np.ndarray:
    kind = WORD[data].astype(np.uint8)
    lead, point, length = code_points(data)
    found = _kinds()[point]
    for j in range(4):
        at = lead[length > j] + j
        inside = at < len(data)
        kind[at[inside]] = found[length > j][inside]
    return kind


def _words(data: np.ndarray, off: np.ndarray):
    """Hash of every word and how many words precede each text, with starts and ends."""
    kind = _kind_of_bytes(data)
    solid = np.append(kind > 0, False)
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    single = kind == 2
    edge[:-1] |= (single | np.append(False, single[:-1])[: len(data)]) & ((data & 0xC0) != 0x80)
    prev = np.append(False, solid[:-1])
    starts = np.flatnonzero(solid & (~prev | edge))
    ends = np.flatnonzero(prev & (~solid | edge))
    return span_hash(prefix_hash(data, COEF_LOWER), starts, ends), starts, ends, np.searchsorted(starts, off)


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return _words(raw, np.array([0, len(raw)]))[0]


def grams(hashed: np.ndarray, n: int = N) -> np.ndarray:
    return shingles(hashed, np.array([0, len(hashed)]), n)[0]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: its score, and the stretch of ``text`` in words.  Row by row; gaps along
    the row are closed by a running maximum."""
    m = len(text)
    row, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best = (0, 0, 0)
    ramp = np.arange(m + 1)
    for w in item:
        diag = row[:-1] + np.where(text == w, 2, -1)
        up = row[1:] - 1
        take = diag >= up
        new = np.append(0, np.where(take, diag, up))
        come = np.append(0, np.where(take, origin[:-1], origin[1:]))
        dead = new <= 0
        new[dead] = 0
        come[dead] = ramp[dead]
        lifted = new + ramp  # a gap of g words costs g
        top = np.maximum.accumulate(lifted)
        frm = np.maximum.accumulate(np.where(lifted == top, ramp, 0))
        gap = top - ramp
        better = gap > new
        row, origin = np.where(better, gap, new), np.where(better, come[frm], come)
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(origin[j]), j)
    return best


class _Seeds:
    def __init__(self, items: list[tuple[int, np.ndarray]]):
        """``items``: id and words; items are told apart by their place, so ids may recur."""
        self.ids = [i for i, _ in items]
        self.items = [words for _, words in items]
        self.sizes = sorted({min(N, len(words)) for words in self.items})
        pairs = sorted({(int(g), i) for i, words in enumerate(self.items) for g in grams(words)})
        self.gram = np.array([g for g, _ in pairs], np.uint64)
        self.item = np.array([i for _, i in pairs], np.int64)
        self.known = np.unique(self.gram)
        self.mask = np.zeros(1 << 20, bool)
        self.mask[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, found: np.ndarray) -> np.ndarray:
        """Places in ``found`` that hold a seed."""
        at = np.flatnonzero(self.mask[(found & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at) or not len(self.known):
            return at[:0]
        near = np.minimum(np.searchsorted(self.known, found[at]), len(self.known) - 1)
        return at[self.known[near] == found[at]]


def _blocks(column: pa.Array):
    data, off = text_buffers(column)
    for lo, hi in row_blocks(off, 1 << 19):
        part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        hashed, starts, ends, first = _words(part, at)
        yield lo, part, at, hashed, starts, ends, first


def _can_reach(item: np.ndarray, text: np.ndarray, least: float) -> bool:
    """Whether enough words of ``text`` are the item's: an alignment of score ``least`` or more has at most
    ``len(item)`` matches, so its gaps leave it shorter than ``span``."""
    span = int((3 - 2 * least) * len(item)) + 1
    held = np.append(0, np.cumsum(np.isin(text, item)))
    most = int((held[span:] - held[:-span]).max()) if len(text) > span else int(held[-1])
    return most / len(item) >= least


def _hits(seeds: _Seeds, column: pa.Array, least: float):
    """Of the texts in ``column``: row, place of the item, score, start, end, passage of every pair that reaches ``least``."""
    for lo, part, off, hashed, starts, ends, first in _blocks(column):
        pairs: dict[tuple[int, int], list[int]] = {}
        for n in seeds.sizes:
            found, doc = shingles(hashed, first, n)
            at = seeds.find(found)
            # words where each seed stands, then the items that it belongs to
            word = first[doc[at]] + at - np.searchsorted(doc, doc[at])
            left, right = np.searchsorted(seeds.gram, found[at], "left"), np.searchsorted(seeds.gram, found[at], "right")
            for d, w, a, b in zip(doc[at].tolist(), word.tolist(), left.tolist(), right.tolist(), strict=True):
                if w + n <= first[d + 1]:  # a shorter text gives the hash of all its words
                    for i in seeds.item[a:b].tolist():
                        pairs.setdefault((d, i), []).append(w)
        for (d, i), places in pairs.items():
            item = seeds.items[i]
            reach = 2 * len(item) + 8
            best, begin = (0, 0, 0), 0
            lo_w, hi_w = int(first[d]), int(first[d + 1])
            j = 0
            while j < len(places):  # one alignment for each cluster of seeds
                k = j
                while k + 1 < len(places) and places[k + 1] - places[k] <= reach:
                    k += 1
                a, b = max(lo_w, places[j] - reach), min(hi_w, places[k] + reach)
                if _can_reach(item, hashed[a:b], least):
                    got = align(item, hashed[a:b])
                    if got[0] > best[0]:
                        best, begin = got, a
                j = k + 1
            score = best[0] / (2 * len(item))
            if score >= least:
                s, e = int(starts[begin + best[1]]), int(ends[begin + best[2] - 1])
                yield lo + d, i, score, s - int(off[d]), e - int(off[d]), part[s:e].tobytes().decode("utf-8", "replace")


def _benchmark_blocks(benchmark: DataFrame):
    """The items, in blocks of at most ``BLOCK`` bytes of word hashes (or one item); one block is held at a time."""
    block: list[tuple[int, np.ndarray]] = []
    held = 0
    for r in benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].alias("text")).where("text is not null").orderBy("item_id", "text").toLocalIterator():
        words = word_hashes(r["text"])
        if not len(words):
            continue
        if block and held + words.nbytes > BLOCK:
            yield _Seeds(block)
            block, held = [], 0
        block.append((r["item_id"], words))
        held += words.nbytes
    if block:
        yield _Seeds(block)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs: doc_id, item_id, score, start, end (bytes of the aligned stretch), passage."""
    small_batches(docs.sparkSession)
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    schema = "doc_id long, item_id long, score double, start long, end long, passage string"
    arrow = arrow_schema(schema)

    def search(seeds: _Seeds) -> DataFrame:
        def run(batches):
            take_turn("decontaminate")
            for batch in batches:
                ids = batch.column(0)
                rows = [(ids[d].as_py(), seeds.ids[i], *found) for d, i, *found in _hits(seeds, batch.column(1), least)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        return base.mapInArrow(run, schema)

    out = None
    for seeds in _benchmark_blocks(benchmark):
        more = search(seeds)
        out = more if out is None else out.unionByName(more)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; every row is judged by its own text, whatever its id."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def keep(docs: DataFrame, seeds: _Seeds) -> DataFrame:
        def run(batches):
            take_turn("decontaminate")
            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                for d, *_ in _hits(seeds, batch.column(at), least):
                    mask[d] = False
                yield batch.filter(pa.array(mask))

        return docs.mapInArrow(run, docs.schema)

    for seeds in _benchmark_blocks(benchmark):
        docs = keep(docs, seeds)
    return docs
