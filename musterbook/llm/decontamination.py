"""Benchmark passages in documents by the q-gram lemma and banded alignment.

Benchmark items are cut into overlapping segments. A region of a document within ``e`` edits
of a segment of length ``m`` shares at least ``m - q + 1 - q e`` of its q-grams, all on
diagonals (place in the document minus place in the segment) that differ by at most ``e``.
Hits are therefore counted in overlapping bands of diagonals; a band that reaches the
bound is verified by an alignment limited to the band.

The shortest leak is a verbatim run of ``RUN`` bytes at any offset of the item: every place of an
item is the start of an indexed q-gram, so such a run is as many hits in a row on one diagonal.
Copies with edits are found where they hold such a run or a whole segment (``SEGMENT`` bytes from
a multiple of ``STEP`` on) within ``RATE`` edits.

Characters are bytes of UTF-8 here, with A-Z lower-cased and ASCII white space equal. The
benchmark is the stated query set: it is read in blocks of at most ``BLOCK_BYTES``, each
broadcast and held against all documents.

Defined results: a NULL or empty text has no match; an item under ``LEAST`` bytes is one segment
with as many edits as the lemma allows; a NULL item, or one under ``Q`` bytes, which has no
q-gram, is not searched; equal items all match; repeated rows are judged alike; empty tables
give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterbook.llm.common import pieces, text_buffer

Q = 10
RATE = 0.08
SEGMENT = 96
STEP = 48
RUN = 64
LEAST = 32
BLOCK_BYTES = 4 << 20
MAP_BITS = 24
_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_STEP_COST = 1 << 12


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``Q`` bytes from each place on (the last ``Q`` - 1 places have none)."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    two = data[:-1].astype(np.uint64)
    two |= data[1:].astype(np.uint64) << _U(8)
    four = two[:-2] | (two[2:] << _U(16))
    eight = four[:-4] | (four[4:] << _U(32))
    out = eight[: len(data) - Q + 1] * _U(0x9E3779B97F4A7C15)
    out ^= two[8:] * _U(0xC2B2AE3D27D4EB4F) << _U(1)
    return out ^ (out >> _U(29))


class Segments:
    """Index of a block of benchmark items: their segments and the q-grams of these."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = RATE):
        self.item, texts = [], []
        # The number of each segment's item in the block, and where it starts there.
        self.number, self.start = [], []
        for number, (item, raw) in enumerate(items):
            folded = _FOLD[np.frombuffer(raw, np.uint8)]
            if len(folded) < Q:
                continue
            starts = [*range(0, max(len(folded) - SEGMENT, 0), STEP), max(len(folded) - SEGMENT, 0)]
            for start in starts:
                self.item.append(item)
                self.number.append(number)
                self.start.append(start)
                texts.append(folded[start : start + SEGMENT])
        self.item, self.number, self.start = (np.array(x, np.int64) for x in (self.item, self.number, self.start))
        self.length = np.array([len(t) for t in texts], np.int64)
        self.budget = (rate * self.length).astype(np.int64)
        short = self.length < LEAST
        self.budget[short] = np.minimum(self.budget[short], (self.length[short] - Q) // Q)
        self.need = np.maximum(self.length - Q + 1 - Q * self.budget, 1)
        self.width = 2 * (int(self.budget.max(initial=0)) + 1)
        self.bytes = np.full((len(texts), SEGMENT), 254, np.uint8)
        for k, t in enumerate(texts):
            self.bytes[k, : len(t)] = t
        grams = [gram_hashes(t) for t in texts]
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.hashes, first = np.unique(h[order], return_index=True)
        self.bounds = np.append(first, len(h))

    def hits(self, data: np.ndarray, offsets: np.ndarray, known: np.ndarray):
        """(text, segment, diagonal, place in ``data``) of every shared q-gram."""
        h = gram_hashes(data)
        at = np.flatnonzero(known[(h >> _U(64 - MAP_BITS)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return None
        row = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        text = np.searchsorted(offsets, at, "right") - 1
        real = (self.hashes[row] == h[at]) & (at + Q <= offsets[text + 1])
        at, row, text = at[real], row[real], text[real]
        n = self.bounds[row + 1] - self.bounds[row]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.bounds[row], n)
        at = np.repeat(at, n)
        return np.repeat(text, n), self.owner[entry], at - self.place[entry], at

    def known_map(self) -> np.ndarray:
        known = np.zeros(1 << MAP_BITS, bool)
        known[(self.hashes >> _U(64 - MAP_BITS)).astype(np.int64)] = True
        return known

    def regions(self, data: np.ndarray, offsets: np.ndarray, known: np.ndarray):
        """(text, segment, start, end, edits) of the verified regions and verbatim runs; offsets into ``data``."""
        found = self.hits(data, offsets, known)
        if found is None or not len(found[0]):
            return None
        text, segment, diagonal, at = found
        out = []
        shift = 1 << 20
        for half in (0, self.width // 2):
            band = (diagonal + shift + half) // self.width
            keys, counts = np.unique(np.column_stack([segment, band, text]), axis=0, return_counts=True)
            keys = keys[counts >= self.need[keys[:, 0]]]
            out.append(np.column_stack([keys[:, 2], keys[:, 0], keys[:, 1] * self.width - shift - half]))
        bands = np.concatenate(out)
        parts = [self.align(data, offsets, *bands.T)] if len(bands) else []
        parts.append(self.runs(text, segment, diagonal, at))
        return tuple(np.concatenate(columns) for columns in zip(*parts))

    def runs(self, text, segment, diagonal, at):
        """Verbatim runs of at least ``RUN`` bytes: q-gram hits of one item in a row on a diagonal of the item."""
        order = np.lexsort((at, diagonal - self.start[segment], self.number[segment], text))
        text, segment, at = text[order], segment[order], at[order]
        number, diagonal = self.number[segment], diagonal[order] - self.start[segment]
        # Where segments overlap, a q-gram hits twice.
        same = np.zeros(len(at), bool)
        same[1:] = (text[1:] == text[:-1]) & (number[1:] == number[:-1]) & (diagonal[1:] == diagonal[:-1])
        same[1:] &= at[1:] - at[:-1] <= 1
        first = np.flatnonzero(~same)
        last = np.append(first[1:], len(at)) - 1
        start, end = at[first], at[last] + Q
        first, start, end = (x[end - start >= RUN] for x in (first, start, end))
        return text[first], segment[first], start, end, np.zeros(len(first), np.int64)

    def align(self, data, offsets, text, segment, low):
        """Least edits of each segment inside its band of diagonals ``low`` .. ``low + width - 1``."""
        slack = int(self.budget.max(initial=0))
        wide = self.width + 2 * slack
        first = low - slack
        places = first[:, None] + np.arange(wide + SEGMENT)
        inside = (places >= offsets[text][:, None]) & (places < offsets[text + 1][:, None])
        window = np.where(inside, data[np.clip(places, 0, len(data) - 1)], 255)
        # A cell is edits * _STEP_COST + the diagonal at which the alignment began.
        ahead = np.arange(wide, dtype=np.int64) * _STEP_COST
        cells = np.tile(np.arange(wide, dtype=np.int64), (len(text), 1))
        final = cells.copy()
        for i in range(SEGMENT):
            below = np.full_like(cells, 1 << 40)
            below[:, :-1] = cells[:, 1:] + _STEP_COST
            differ = self.bytes[segment, i][:, None] != window[:, i : i + wide]
            cells = np.minimum(cells + differ * _STEP_COST, below)
            cells = np.minimum.accumulate(cells - ahead, axis=1) + ahead
            final = np.where((self.length[segment] == i + 1)[:, None], cells, final)
        best = final.argmin(axis=1)
        value = final[np.arange(len(text)), best]
        edits = value // _STEP_COST
        start = first + value % _STEP_COST
        end = first + best + self.length[segment]
        good = edits <= self.budget[segment]
        return tuple(x[good] for x in (text, segment, start, end, edits))


def benchmark_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = BLOCK_BYTES):
    """The items in blocks of at most ``size`` bytes (one longer item is a block of its own)."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long"), F.encode(text, "UTF-8"))
    block, total = [], 0
    for item, raw in rows.toLocalIterator():
        if block and total + len(raw) > size:
            yield block
            block, total = [], 0
        block.append((item, bytes(raw)))
        total += len(raw)
    if block:
        yield block


def _broadcast(docs: DataFrame, block):
    """The index as plain arrays, which unpickle on executors that lack this package."""
    return docs.sparkSession.sparkContext.broadcast(vars(Segments(block)))


def _received(shared) -> Segments:
    index = Segments([])
    vars(index).update(shared.value)
    return index


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """Per document and item that it holds: ``doc_id``, ``item_id``, ``start_byte``, ``end_byte`` and the
    least ``edits`` of a segment or run; start and end span all matched segments and runs."""
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, start_byte long, end_byte long, edits long"
    found = None
    for block in benchmark_blocks(benchmark, item_id):
        shared = _broadcast(docs, block)

        def run(batches, shared=shared):
            index = _received(shared)
            known = index.known_map()
            for batch in batches:
                for piece in pieces(batch, "text"):
                    data, offsets = text_buffer(piece.column("text"))
                    got = index.regions(_FOLD[data], offsets, known)
                    if got is None or not len(got[0]):
                        continue
                    row, segment, start, end, edits = got
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece.column("doc_id").take(pa.array(row)),
                            *[
                                pa.array(np.ascontiguousarray(x, np.int64))
                                for x in (index.item[segment], start - offsets[row], end - offsets[row], edits)
                            ],
                        ],
                        ["doc_id", "item_id", "start_byte", "end_byte", "edits"],
                    )

        part = whole.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return whole.sparkSession.createDataFrame([], schema)
    return found.groupBy("doc_id", "item_id").agg(
        F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"), F.min("edits").alias("edits")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The documents without a benchmark passage; no shuffle, each text is judged where it lies."""
    for block in benchmark_blocks(benchmark, item_id):
        shared = _broadcast(docs, block)

        def run(batches, shared=shared):
            index = _received(shared)
            known = index.known_map()
            for batch in batches:
                for piece in pieces(batch, text):
                    data, offsets = text_buffer(piece.column(text))
                    got = index.regions(_FOLD[data], offsets, known)
                    clean = np.ones(piece.num_rows, bool)
                    if got is not None:
                        clean[got[0]] = False
                    yield piece.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
