"""Token-ID output: tokenise, and encode with a static range asymmetric numeral system.

One frequency table (exact counts over all documents, scaled to ``2**SCALE``) is shared by all
blocks.  A block holds whole documents in order: its header has the documents' ids and lengths,
a checksum of the ids, and checkpoints (step, word offset, states) from which the decoder's lanes
can start in parallel.  Symbols are dealt to ``lanes`` interleaved 64-bit states; step ``s`` of
lane ``j`` is symbol ``s * lanes + j``.  Blocks are independent of one another; they are stored as
binary rows of Parquet files, which any store that Spark reads can hold.

Null and empty texts have the end id alone.  Rows without an id come first.  Repeated rows are
kept.  An empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REMEMBERED, arrow_schema, discard, materialize, new_path, partitions, running_totals, small_batches, take_turn

SCALE, LANES, BLOCK, EVERY = 20, 8192, 1 << 19, 32
MAGIC = b"TMRANS2\0"
#: Bytes that a worker may remember pieces in, and characters that it encodes at once.
MEMORY, SOME = 224 << 20, 8 << 20
_U32, _LOW = np.uint64(32), np.uint64(1 << 31)


class Table:
    """Frequencies scaled to ``2**SCALE``: every symbol that occurs has at least 1."""

    def __init__(self, symbols: list[int], counts: list[int]):
        order = np.argsort(symbols, kind="stable")
        self.symbols = np.array(symbols, np.uint32)[order]
        total, room = sum(counts), (1 << SCALE) - len(counts)
        if room < 0:
            raise ValueError("more symbols than the scale has places")
        f = np.array([1 + counts[i] * room // total for i in order], np.int64)
        if len(f):
            f[np.argmax(f)] += (1 << SCALE) - f.sum()
        self.freq = f.astype(np.uint64)
        self.start = (np.cumsum(f) - f).astype(np.uint64)
        self.id = zlib.crc32(self.symbols.tobytes() + self.freq.tobytes())

    def places(self, ids: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_places"):
            self._places = np.zeros(int(self.symbols[-1]) + 1 if len(self.symbols) else 1, np.int32)
            self._places[self.symbols] = np.arange(len(self.symbols))
        return self._places[ids]

    def slots(self) -> np.ndarray:
        if not hasattr(self, "_slots"):
            self._slots = np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.freq.astype(np.int64))
        return self._slots


def encode_block(table: Table, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    n = len(ids)
    named = np.array([i is not None for i in doc_ids], np.uint8)
    doc_ids = np.array([i or 0 for i in doc_ids], np.int64)
    lanes = int(min(LANES, max(1, n // 32)))
    steps = -(-n // lanes)
    place = table.places(ids)
    freq, start = table.freq[place], table.start[place]
    x = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []
    written = 0
    for s in range(steps - 1, -1, -1):
        lo, hi = s * lanes, min(n, (s + 1) * lanes)
        f, c, y = freq[lo:hi], start[lo:hi], x[: hi - lo]
        full = y >= (f << np.uint64(63 - SCALE))
        out = (y[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        y = np.where(full, y >> _U32, y)
        q = y // f
        x[: hi - lo] = (q << np.uint64(SCALE)) + (y - q * f) + c
        words.append(out)
        written += len(out)
        if s and s % EVERY == 0:
            marks.append((s, written, x.copy()))
    body = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    head = MAGIC + struct.pack("<IIQIII", table.id, lanes, n, len(doc_ids), len(marks), zlib.crc32(ids.astype("<u4").tobytes()))
    parts = [head, named.tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), x.astype("<u8").tobytes()]
    for s, after, states in reversed(marks):  # words before the checkpoint = all but those written by then
        parts += [struct.pack("<QQ", s, written - after), states.astype("<u8").tobytes()]
    return b"".join([*parts, struct.pack("<Q", written), body.astype("<u4").tobytes()])


def _steps(table: Table, x: np.ndarray, words: np.ndarray, at: int, steps: int, lanes: int, out: np.ndarray) -> None:
    n, slots, mask = len(out), table.slots(), np.uint64((1 << SCALE) - 1)
    for s in range(steps):
        lo, hi = s * lanes, min(n, (s + 1) * lanes)
        y = x[: hi - lo]
        low = y & mask
        place = slots[low.astype(np.int64)]
        y = table.freq[place] * (y >> np.uint64(SCALE)) + low - table.start[place]
        need = np.flatnonzero(y < _LOW)
        y[need] = (y[need] << _U32) | words[at : at + len(need)].astype(np.uint64)
        at += len(need)
        x[: hi - lo] = y
        out[lo:hi] = table.symbols[place]


class Block:
    """A block's header: documents, checkpoints and where the words lie; raises ValueError for another table's."""

    def __init__(self, table: Table, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a block")
        which, self.lanes, self.n, docs, marks, self.crc = struct.unpack_from("<IIQIII", data, 8)
        if which != table.id:
            raise ValueError("the block belongs to another frequency table")
        at = 8 + struct.calcsize("<IIQIII")

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        named, ids, self.lengths = take("u1", docs), take("<i8", docs), take("<u4", docs)
        self.doc_ids = pa.array(ids.astype(np.int64), mask=named == 0)
        #: step, words before it, the lanes' states: decoding can begin at any of these
        self.begins = [(0, 0, take("<u8", self.lanes))]
        for _ in range(marks):
            s, word = take("<u8", 2)
            self.begins.append((int(s), int(word), take("<u8", self.lanes)))
        self.words = take("<u4", int(take("<u8", 1)[0]))
        self.table = table

    def span(self, i: int) -> tuple[int, np.ndarray]:
        """What lies between checkpoint ``i`` and the next: place of the first id, and the ids; needs no other span."""
        first, word, states = self.begins[i]
        last = self.begins[i + 1][0] if i + 1 < len(self.begins) else -(-self.n // self.lanes)
        lo, hi = first * self.lanes, min(self.n, last * self.lanes)
        out = np.empty(hi - lo, np.uint32)
        _steps(self.table, states.astype(np.uint64), self.words, word, last - first, self.lanes, out)
        return lo, out

    def ids(self, workers: int = 1) -> np.ndarray:
        """All token ids; ``workers`` threads each take the next span.  Raises ValueError if the checksum differs."""
        spans = range(len(self.begins))
        if workers > 1:
            with ThreadPoolExecutor(workers) as pool:
                parts = [x for _, x in pool.map(self.span, spans)]
        else:
            parts = [self.span(i)[1] for i in spans]
        out = np.concatenate(parts)
        if zlib.crc32(out.astype("<u4").tobytes()) != self.crc:
            raise ValueError("checksum of a block does not match")
        return out


def decode_block(table: Table, data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Document ids, lengths and token ids of a block; raises ValueError if it is damaged."""
    block = Block(table, data)
    return block.doc_ids, block.lengths, block.ids()


class Pieces(dict):
    """Token ids (packed) by space-led piece of text; a bounded memory of the tokenizers library's answers.

    Byte-level pre-tokens never span a single space between other characters, so a text without
    doubled white space is the concatenation of its space-led pieces; other texts are split by the
    vocabulary's own pattern.  Either way the library makes the ids: its model for a piece that is one
    run of letters (with punctuation after it, which is a pre-token of its own), else its whole encoder.
    Texts that hold an added token are encoded as they are.
    """

    #: Bytes that an entry takes beside its text and ids.
    ENTRY = 200

    def __init__(self, path: str, pattern: str, limit: int):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.double, self.split = re.compile(r"\s\s"), regex.compile(pattern).findall
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.packers = [struct.Struct(f"<{n}{self.code}").pack for n in range(32)]
        self.tokenize = self.tokenizer.model.tokenize
        self.held, self.limit = 0, limit
        self.led: dict[str, bytes] = {}  # the pieces that a space leads, without it
        # the printable stand-ins of bytes in byte-level vocabularies
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.stand = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, piece: str) -> bytes:
        return self._keep(self, piece, self._piece(piece))

    def after_space(self, word: str) -> bytes:
        return self._keep(self.led, word, self._piece(" " + word))

    def _keep(self, where: dict[str, bytes], piece: str, got: bytes) -> bytes:
        if self.held < self.limit:
            self.held += self.ENTRY + len(piece) + len(got)
            where[piece] = got
        return got

    def _piece(self, piece: str) -> bytes:
        word = piece[1:] if piece[:1] == " " else piece
        if word.isalpha():
            if piece.isascii():
                shown = piece if word is piece else self.stand[32] + word
            else:
                shown = "".join([self.stand[b] for b in piece.encode()])
            return self.pack([t.id for t in self.tokenize(shown)])
        stem = word.rstrip(".,;:!?)")
        if stem.isalpha():
            return (self[stem] if piece is word else self.led.get(stem) or self.after_space(stem)) + self[word[len(stem) :]]
        return self.whole(piece)

    def pack(self, ids: list[int]) -> bytes:
        n = len(ids)
        return self.packers[n](*ids) if n < 32 else struct.pack(f"<{n}{self.code}", *ids)

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def doubled(self, text: str) -> bool:
        """Whether white space follows white space; of printable characters, only the space is white."""
        if text.isascii():
            return "  " in text or any(c in text for c in "\t\n\v\f\r\x1c\x1d\x1e\x1f") and self.double.search(text) is not None
        return "  " in text if text.isprintable() else self.double.search(text) is not None

    def spaced(self, text: str) -> bool:
        """Whether the text is the concatenation of its space-led pieces."""
        return not self.doubled(text) and not any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        return b"".join([self[w] for w in self.split(text)])

    def encode_all(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text; of spaced texts every distinct word is looked up once."""
        plain = [i for i, t in enumerate(texts) if t and self.spaced(t)]
        out: list[np.ndarray] = [np.zeros(0, self.kind)] * len(texts)
        for i in set(range(len(texts))) - set(plain):
            out[i] = np.frombuffer(self.encode(texts[i]), self.kind)
        if not plain:
            return out
        listed = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        off = np.asarray(listed.offsets)
        words = listed.values.dictionary_encode()
        code = np.asarray(words.indices).astype(np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), pa.scalar(" ", pa.large_string()))
        distinct = joined[0].as_py().split(" ")  # no word has a space
        known = list(map(self.led.get, distinct))
        for i in [i for i, k in enumerate(known) if k is None]:
            known[i] = self.after_space(distinct[i])
        first = [texts[i].partition(" ")[0] for i in plain]  # no space leads these
        code[off[:-1]] = len(known) + np.arange(len(first))
        known += [self[w] if w else b"" for w in first]
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.kind.itemsize
        begin = np.cumsum(size) - size
        n = size[code]
        end = np.cumsum(n)
        at = np.repeat((begin[code] - (end - n)).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        ids = np.frombuffer(b"".join(known), self.kind)[at]
        cut = np.append(0, end)[off]
        for j, i in enumerate(plain):
            out[i] = ids[cut[j] : cut[j + 1]]
        return out


@lru_cache(maxsize=1)
def pieces(path: str, pattern: str, limit: int) -> Pieces:
    """A worker keeps its memory from task to task."""
    return Pieces(path, pattern, limit)


REMEMBERED["rans"] = pieces.cache_clear


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")


def tokenize(docs: DataFrame, path: str, pattern: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY, some: int = SOME) -> DataFrame:
    """``at, doc_id, ids, counts`` in ascending order of the id: ``at`` orders rows, ids are packed in 16 or 32 bits.

    The last row of each task has no ``at``; its ``counts`` are pairs of an id and how often the task met it.
    """
    schema = "at long, doc_id long, ids binary, counts binary"
    arrow = arrow_schema(schema)
    small_batches(docs.sparkSession)

    def run(batches):
        take_turn("rans")
        known = pieces(path, pattern, memory)
        tail = b"" if end_id is None else known.pack([end_id])
        counts = np.zeros(1 << 16, np.int64)
        rows: list[tuple] = []
        held = 0

        def flush():
            nonlocal counts
            ats, docs, texts = zip(*rows, strict=True)
            ids = known.encode_all(texts)
            got = np.bincount(np.concatenate(ids), minlength=len(counts))
            if end_id is not None:
                got[end_id] += len(ids)
            counts = got + np.pad(counts, (0, len(got) - len(counts)))
            cols = ats, docs, [x.tobytes() + tail for x in ids], [None] * len(ids)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for at, doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows.append((at, doc, text or ""))
                held += len(text or "")
                if held >= some:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()
        used = np.flatnonzero(counts)
        pairs = np.stack([used, counts[used]], axis=1).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((None, None, None, pairs), arrow, strict=True)], schema=arrow)

    rows = _ordered(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("at"), "doc_id", "text")
    return rows.mapInArrow(run, schema)


def frequencies(tokens: DataFrame) -> Table:
    """Exact counts of all ids from the tasks' own counts; the driver gets the vocabulary."""
    schema = "id long, n long"
    arrow = arrow_schema(schema)

    def run(batches):
        take_turn("blocks")
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                pairs = np.frombuffer(raw, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=arrow)

    rows = tokens.where("counts is not null").select("counts").mapInArrow(run, schema).groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    return Table([r["id"] for r in rows], [r["n"] for r in rows])


def write_blocks(tokens: DataFrame, table: Table, path: str, kind: np.dtype) -> None:
    """Encode ``at, doc_id, ids`` rows to blocks of about ``BLOCK`` ids; a longer document is a block of its own."""
    schema = "first long, docs long, tokens long, block binary"
    arrow = arrow_schema(schema)

    def run(batches):
        take_turn("blocks")
        ats: list[int] = []
        docs: list[int] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush():
            lengths = np.array([len(x) for x in ids], np.uint32)
            block = encode_block(table, docs, lengths, np.concatenate(ids).astype(np.uint32))
            row = [[ats[0]], [len(docs)], [int(lengths.sum())], [block]]
            for x in (ats, docs, ids):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for at, doc, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if ats and (at != ats[-1] + 1 or held >= BLOCK):
                    yield flush()
                    held = 0
                ats.append(at)
                docs.append(doc)
                ids.append(np.frombuffer(raw, kind))
                held += len(ids[-1])
        if ats:
            yield flush()

    tokens.where("at is not null").select("at", "doc_id", "ids").mapInArrow(run, schema).write.parquet(path)


def read_blocks(spark, path: str, table: Table) -> DataFrame:
    """From the files: doc_id, start (ids before it), n_tokens, ids_crc32, in the documents' order."""
    blocks = spark.read.parquet(path)
    starts = running_totals(blocks.select("first", "tokens"), [F.col("first")], "tokens", tag="rans-starts").select(F.col("first").alias("_first"), "before_total")
    schema = "first long, nth long, doc_id long, inner_start long, n_tokens long, ids_crc32 long"
    arrow = arrow_schema(schema)

    def run(batches):
        take_turn("blocks")
        for batch in batches:
            for first, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, lengths, ids = decode_block(table, raw.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                begins = ends - lengths
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(docs), first)), pa.array(np.arange(len(docs))), docs, pa.array(begins), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], schema=arrow
                )

    rows = blocks.select("first", "block").mapInArrow(run, schema)
    return rows.join(starts, F.col("first") == F.col("_first")).select("doc_id", (F.col("before_total") + F.col("inner_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, path: str | None = None, memory: int = MEMORY, some: int = SOME) -> DataFrame:
    """Tokenise, write the files (to ``path``, else in the shared folder) and read them back.

    ``memory`` and ``some`` bound what a worker holds: remembered pieces, and characters encoded at once.
    """
    import public_tokenizers

    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, public_tokenizers.path(vocabulary), public_tokenizers.PATTERN, end_id, memory=memory, some=some), "tokens", "snappy")
    table = frequencies(tokens)
    path = path or new_path(spark, "rans")
    write_blocks(tokens, table, path, Pieces(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN, 0).kind)
    discard(tokens)
    return read_blocks(spark, path, table)
