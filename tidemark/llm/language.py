"""Language ID of mixed-language text: script ranges, per-word scores, Viterbi with a switching penalty.

Training counts, by language, hashed byte grams of 2 to 4 bytes of lower-cased words (runs of letters and
their marks) with their edges and the scripts of letters, by code point.  A word's candidates are the languages that use its rarest script (at least ``SHARE`` of
their letters in training); its score for each is the mean-scaled log probability of its grams.
Viterbi labels every word at a cost of ``PENALTY`` for each switch.  Successive words that put all
languages in the same order are one step: a best path never switches inside them.  The document's
language is the one with the most letters (characters, not bytes; the first by name if equal); ``score``
is its share of them.

Texts that are null or have no letter are ``und`` with score 0.  Without training rows every other
text is ``und`` too.  Rows are kept as they come; repeated rows repeat.  About
``max_train`` documents of each language are used, chosen by a hash of the id.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, row_blocks, small_batches, take_turn, text_buffers
from .kernels import LOWER, code_points, gram_hash, prefix_hash

BUCKETS, PENALTY, SHARE, MAX_TRAIN = 1 << 16, 6.0, 1e-4, 4000
GRAMS = (2, 3, 4)
#: Script ranges by the last code point of each range.
SCRIPTS = (
    (0x7F, "ascii"), (0xFF, "latin-1"), (0x24F, "latin-extended"), (0x36F, "phonetic"), (0x3FF, "greek"), (0x52F, "cyrillic"), (0x58F, "armenian"), (0x5FF, "hebrew"), (0x6FF, "arabic"),
    (0x8FF, "syriac-to-samaritan"), (0x97F, "devanagari"), (0x9FF, "bengali"), (0xA7F, "gurmukhi"), (0xAFF, "gujarati"), (0xB7F, "oriya"), (0xBFF, "tamil"), (0xC7F, "telugu"), (0xCFF, "kannada"),
    (0xD7F, "malayalam"), (0xDFF, "sinhala"), (0xE7F, "thai"), (0xEFF, "lao"), (0xFFF, "tibetan"), (0x109F, "burmese"), (0x10FF, "georgian"), (0x11FF, "hangul-jamo"), (0x139F, "ethiopic"),
    (0x177F, "cherokee-to-tagalog"), (0x17FF, "khmer"), (0x18AF, "mongolian"), (0x1DFF, "limbu-to-phonetic"), (0x1EFF, "latin-additional"), (0x1FFF, "greek-extended"), (0x2E7F, "symbols"),
    (0x303F, "han-radicals"), (0x30FF, "kana"), (0x318F, "bopomofo-hangul"), (0x31EF, "bopomofo-more"), (0x31FF, "kana-more"), (0x9FFF, "han"), (0xABFF, "yi-to-meetei"), (0xD7FF, "hangul"),
    (0xFAFF, "han-compatible"), (0xFFFF, "forms"), (0x1FFFF, "historic"), (0x10FFFF, "han-more"),
)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point the number of its script, and whether it is a letter or a mark on one."""
    script = np.searchsorted([last for last, _ in SCRIPTS], np.arange(0x110000)).astype(np.uint8)
    letter = np.zeros(0x110000, bool)
    letter[[c for c in range(0x32000) if unicodedata.category(chr(c))[0] in "LM"]] = True
    return script, letter


ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def _features(data: np.ndarray, off: np.ndarray):
    """Words (starts, ends, words before each text), for each gram its word and bucket, and the words' scripts and letters."""
    lead, point, length = code_points(data)
    scripts, letters = _tables()
    solid = np.append(ASCII_LETTER[data], False)
    own = np.zeros(len(data), np.uint8)  # the script, at the first byte of a letter
    good = letters[point]
    for j in range(4):
        solid[(lead + j)[good & (length > j)]] = True
    own[lead[good]] = scripts[point[good]]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    prev = np.append(False, solid[:-1])
    starts = np.flatnonzero(solid & (~prev | edge))
    ends = np.flatnonzero(prev & (~solid | edge))
    # each word framed by spaces in a fresh buffer
    n = ends - starts
    frame = np.full(int(n.sum()) + 2 * len(n), 32, np.uint8)
    begin = np.cumsum(n + 2) - (n + 2)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    frame[np.repeat(begin + 1, n) + inner] = LOWER[data[np.repeat(starts, n) + inner]]
    word_of = np.repeat(np.arange(len(n)), n + 2)
    prefix = prefix_hash(frame)
    word, bucket = [], []
    for k in GRAMS:
        h = gram_hash(prefix, k)
        same = word_of[: len(h)] == word_of[k - 1 : k - 1 + len(h)]
        word.append(word_of[: len(h)][same])
        bucket.append((h[same] >> np.uint64(40)).astype(np.int64) % BUCKETS)
    # the script furthest from ASCII, and letters: bytes that begin a character
    if len(lead) and len(n):
        script = np.maximum.reduceat(np.append(own, 0), np.stack([starts, ends], axis=1).reshape(-1))[::2].astype(np.int64)
        size = n - np.add.reduceat(np.append((data & 0xC0) == 0x80, False).astype(np.int64), np.stack([starts, ends], axis=1).reshape(-1))[::2]
    else:
        script, size = np.zeros(len(n), np.int64), n
    return starts, ends, np.searchsorted(starts, off), np.concatenate(word), np.concatenate(bucket), script, size


class Model:
    def __init__(self, names: list[str], grams: np.ndarray, scripts: np.ndarray):
        """``grams``: languages x buckets counts; ``scripts``: languages x scripts counts of words."""
        self.names = names
        g = grams + 0.5
        log = np.log(g / g.sum(axis=1, keepdims=True))
        self.log = (log - log.mean(axis=0)).T.astype(np.float32).copy()
        self.fits = scripts >= SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)

    def words(self, word: np.ndarray, bucket: np.ndarray, script: np.ndarray) -> np.ndarray:
        """Words x languages scores; languages that do not use a word's script are out."""
        n = len(script)
        score = np.stack([np.bincount(word, self.log[bucket, i], minlength=n) for i in range(len(self.names))], axis=1)
        fits = self.fits[:, script].T
        fits = fits | ~fits.any(axis=1, keepdims=True)
        return np.where(fits, score / np.sqrt(len(GRAMS)), -30.0)


def viterbi(score: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The label of each word."""
    best = score.argmax(axis=1)
    if (best == best[0]).all():
        return best
    order = score.argsort(axis=1)
    cut = np.flatnonzero(np.append(True, (order[1:] != order[:-1]).any(axis=1)))
    runs = np.add.reduceat(score, cut, axis=0).tolist()
    total, back = runs[0], []
    for run in runs[1:]:
        top = max(total)
        j, floor = total.index(top), top - penalty
        back.append([k if t >= floor else j for k, t in enumerate(total)])
        total = [max(t, floor) + r for t, r in zip(total, run, strict=True)]
    label = [total.index(max(total))]
    for row in reversed(back):
        label.append(row[label[-1]])
    return np.repeat(label[::-1], np.diff(np.append(cut, len(score))))


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model | None:
    """``docs``: doc_id, text, lang; rows without text or lang are not used."""
    small_batches(docs.sparkSession)
    known = docs.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy("lang").collect()}
    if not counts:
        return None
    names = sorted(counts)
    bar = None
    for lang in names:
        part = F.lit(min((1 << 63) - 1, int(min(1.0, max_train / counts[lang]) * (1 << 63))))
        bar = F.when(F.col("lang") == lang, part) if bar is None else bar.when(F.col("lang") == lang, part)
    sample = known.where(F.xxhash64("doc_id", F.lit(7)).bitwiseAND((1 << 63) - 1) <= bar)
    schema = "lang int, kind int, at int, n double"
    arrow = arrow_schema(schema)

    def run(batches):
        take_turn("language")
        grams, scripts = np.zeros((len(names), BUCKETS)), np.zeros((len(names), len(SCRIPTS)))
        index = {x: i for i, x in enumerate(names)}
        for batch in batches:
            langs = np.array([index[x] for x in batch.column(1).to_pylist()])
            data, off = text_buffers(batch.column(0))
            for lo, hi in row_blocks(off, 1 << 18):
                part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                _, _, first, word, bucket, script, _ = _features(part, at)
                lang = np.repeat(langs[lo:hi], np.diff(first))
                np.add.at(grams.reshape(-1), lang[word] * BUCKETS + bucket, 1)
                np.add.at(scripts.reshape(-1), lang * len(SCRIPTS) + script, 1)
        for kind, table in ((0, grams), (1, scripts)):
            i, j = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(np.full(len(i), kind), pa.int32()), pa.array(j, pa.int32()), pa.array(table[i, j])], schema=arrow)

    grams, scripts = np.zeros((len(names), BUCKETS)), np.zeros((len(names), len(SCRIPTS)))
    summed = sample.select("text", "lang").mapInArrow(run, schema).groupBy("lang", "kind", "at").agg(F.sum("n").alias("n"))
    for r in summed.toLocalIterator():  # at most languages x (buckets + scripts) rows
        (scripts if r["kind"] else grams)[r["lang"], r["at"]] = r["n"]
    return Model(names, grams, scripts)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, spans (lang, start, end in bytes; empty if not asked for)."""
    schema = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,start:long,end:long>>"
    arrow = arrow_schema(schema)
    small_batches(docs.sparkSession)

    def run(batches):
        take_turn("language")
        for batch in batches:
            preds, scores, listed = [], [], []
            data, off = text_buffers(batch.column(1))
            for lo, hi in row_blocks(off, 1 << 18):
                part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                if model is not None:
                    starts, ends, first, word, bucket, script, letters = _features(part, at)
                    score = model.words(word, bucket, script)
                for i in range(hi - lo):
                    a, b = (first[i], first[i + 1]) if model is not None else (0, 0)
                    if a == b or not letters[a:b].any():
                        preds.append("und"), scores.append(0.0), listed.append([])
                        continue
                    label = viterbi(score[a:b])
                    size = np.bincount(label, letters[a:b], minlength=len(model.names))
                    top = int(size.argmax())
                    preds.append(model.names[top])
                    scores.append(float(size[top] / size.sum()))
                    if spans:
                        cut = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
                        last = np.append(cut[1:], len(label)) - 1
                        listed.append([{"lang": model.names[label[c]], "start": int(starts[a + c] - at[i]), "end": int(ends[a + z] - at[i])} for c, z in zip(cut, last, strict=True)])
                    else:
                        listed.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(listed, arrow.field(3).type)], schema=arrow)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def held_out(doc_id):
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
