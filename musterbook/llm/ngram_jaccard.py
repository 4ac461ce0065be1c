"""Similarity join on word shingles by blocked sparse products.

A document's row of the incidence matrix holds the 52-bit hashes of its distinct shingles.
Equal rows are one class (128-bit fingerprint of the set), represented by their
least document. Two classes of Jaccard similarity ``t`` share a shingle among the first
``n - ceil(t n) + 1`` of each in any common order, so only these prefix entries enter the
product; the order is "seldom first", so shingles of common passages come last. They are dealt
into blocks of columns by hash.

An entry carries its place in that order. Two classes that need an overlap of ``o`` shingles share at
least ``k`` among the first ``n - o + k`` of each, since at most ``o - k`` common ones lie behind
the prefix that ends first. ``o`` follows from both sizes, so this is shorter than each
one's own prefix: classes with many shingles of their own meet in few columns or in none.

First pass: the least hashes of each class (a bottom-k sketch) are columns of a second, narrow
matrix. Inside its blocks each class is paired with the least one of its column and size:
pairs grow with the entries, not with their square. Pairs that share several columns are
verified and form preliminary components, together with equal rows. Second pass: the block product
of columns over classes of *different* components accumulates overlap counts per pair inside
these shorter prefixes, and pairs with fewer than ``k`` are dropped before verification.
Every pair over the threshold has as many, so it is verified or already inside one
component: the components are exact.

Verification is a product too: whole rows of the pairs' classes are multiplied
entry by entry, counting equal (pair, shingle) keys; there a hash keeps 40 bits, since only the rows of
one pair meet.

Columns that many classes of different components share would give a row for each pair of a group of
texts that are near each other, over the threshold or not. Such busy columns are tiled instead: the
classes of all busy columns with one leader (the least hash of an id there) are one set, dealt by hash into
parts of bounded weight, and each pair of parts is a tile that receives whole rows once. A tile multiplies
its sparse rows, compares the overlaps with the bounds and emits a spanning forest of its links:
links are linear in the rows of a tile, and no pair leaves it. A set of ``m`` parts sends each row to ``m - 1`` tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from musterbook.llm.common import fresh, mix, pack, pieces, store, text_buffer, unpack
from musterbook.llm.components import components

WORDS = 5
PERCENT = 80
COMMON = 1 << 20
# Entries of a stretch of text in which common shingles are counted.
STRETCH = 1 << 22
LAST = 2**63 - 1
HASH_BITS = 52
# Columns of a class in the first pass, and how many a pair must share there (each grid of sizes counts).
SKETCH = 16
SKETCH_SHARED = 6
# Bytes of a hash that whole rows carry to verification, where only the rows of one pair meet.
ROW_BYTES = 5
# ``k`` takes this part of the room between a pair's shorter prefixes and the entries at hand.
ROOM_PART = 16
# Columns with so many live entries are tiled.
BUSY = 64
# Bytes of a hash in the rows of a tile; entries of a part of a tile, where every row weighs at least ``LIGHTEST``; columns multiplied at once.
TILE_BYTES = 7
PART, LIGHTEST = 1 << 17, 512
STRIP = 4096
PIECE_TEXTS = 1 << (64 - HASH_BITS)
_U = np.uint64
_MASK = _U((1 << HASH_BITS) - 1)
_SKETCHED = _U(1 << 60)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
_BASE = 0xD6E8FEB86659FD93
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers 0 .. n - 1 of an odd base modulo 2**64; kept for the next piece of text."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 21), _U(base), np.uint64)
        known[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(known)
    return known[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, by prefix sums of a polynomial modulo 2**64."""
    up, down = _powers(_BASE, len(data)), _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (ASCII A-Z lower-cased), and the number of each word's text."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = (data != 32) & ((data < 9) | (data > 13))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    return span_hashes(data, starts, stops), text


def shingle_sets(batch: pa.RecordBatch, column: str, n_words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within a text, and row bounds (one more than texts).

    At most ``PIECE_TEXTS`` texts, so that text number and hash sort as one integer.
    """
    data, offsets = text_buffer(batch.column(column))
    words, text = word_hashes(data, offsets)
    n_texts = len(offsets) - 1
    counts = np.bincount(text, minlength=n_texts)
    # A text with fewer words is one shingle: it is padded with a mark.
    short = (counts > 0) & (counts < n_words)
    if short.any():
        extra = np.where(short, n_words - counts, 0)
        words = np.insert(words, np.repeat(np.cumsum(counts), extra), _U(0))
        text = np.repeat(np.arange(n_texts), counts + extra)
    if len(words) < n_words:
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    whole = text[n_words - 1 :] == text[: len(text) - n_words + 1]
    h = np.zeros(len(words) - n_words + 1, np.uint64)
    for k in range(n_words):
        h = mix(h * _U(3) + words[k : k + len(h)] + _U(k))
    keys = (text[: len(whole)][whole].astype(np.uint64) << _U(HASH_BITS)) | (h[whole] & _MASK)
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    sizes = np.bincount((keys >> _U(HASH_BITS)).astype(np.int64), minlength=n_texts)
    return keys & _MASK, np.concatenate([[0], np.cumsum(sizes)])


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _fingerprints(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for seed in (0x632BE59BD9B4E019, 0x9FB21C651E98DF25):
        sums = np.concatenate([[_U(0)], np.cumsum(mix(h ^ _U(seed)))])
        out.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return out[0], out[1]


def _one_per_class(h: np.ndarray, bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rows of the least document of each class of a piece, without empty sets."""
    f1, f2 = _fingerprints(h, bounds)
    order = np.lexsort((ids, f2, f1))
    order = order[np.diff(bounds)[order] > 0]
    new = np.ones(len(order), bool)
    new[1:] = (f1[order][1:] != f1[order][:-1]) | (f2[order][1:] != f2[order][:-1])
    return order[new]


def _entries(bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of some rows, and the place of each entry's row among them."""
    sizes = bounds[rows + 1] - bounds[rows]
    owner = np.repeat(np.arange(len(rows)), sizes)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(bounds[rows], sizes) + within, owner


def class_rows(docs: DataFrame, n_words: int = WORDS) -> DataFrame:
    """Two kinds of rows (common, id, n, f1, f2) in one pass over (id, text).

    Per document the size and the fingerprint of its shingle set; and per stretch of text each
    shingle that at least two of its classes hold (hash in ``id``, number of classes in ``n``).
    """

    def run(batches):
        held, total, seen = [], 0, set()
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 21, PIECE_TEXTS):
                h, bounds = shingle_sets(piece, "text", n_words)
                f1, f2 = _fingerprints(h, bounds)
                no = pa.array(np.zeros(piece.num_rows, bool))
                yield pa.RecordBatch.from_arrays(
                    [no, piece.column("id"), pa.array(np.diff(bounds)), _signed(f1), _signed(f2)], names
                )
                new = np.array([k for k in range(piece.num_rows) if f1[k] not in seen and not seen.add(f1[k])], np.int64)
                held.append(h[_entries(bounds, new)[0]])
                total += len(held[-1])
                if total >= STRETCH:
                    yield often(held)
                    held, total, seen = [], 0, set()
        if held:
            yield often(held)

    def often(held):
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        found, counts = found[counts >= 2], counts[counts >= 2]
        none, yes = pa.array(np.zeros(len(found), np.int64)), pa.array(np.ones(len(found), bool))
        return pa.RecordBatch.from_arrays([yes, _signed(found), pa.array(counts.astype(np.int64)), none, none], names)

    names = ["common", "id", "n", "f1", "f2"]
    return docs.mapInArrow(run, "common boolean, id long, n long, f1 long, f2 long")


def common_shingles(rows: DataFrame, most: int = COMMON) -> np.ndarray:
    """The most frequent shingles of ``class_rows``, the most frequent last: a table of bounded size.

    It only fixes the order of shingles, on which results do not depend. Classes count, so
    copies do not make a shingle common.
    """
    counted = rows.where("common").groupBy(F.col("id").alias("h")).agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "h").limit(most).select("h").toArrow()
    return top.column("h").to_numpy()[::-1].copy().view(np.uint64)


def packed_prefixes(
    docs: DataFrame, common: np.ndarray, buckets: int, n_words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """(bucket, entries): prefix and sketch entries of one document per class and piece of text, packed by block of columns."""
    by_hash = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[by_hash], by_hash.astype(np.int64)))

    def run(batches):
        hashes, ranks = shared.value
        known = np.zeros(1 << 24, bool)
        known[(hashes & _U((1 << 24) - 1)).astype(np.int64)] = True
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 21, PIECE_TEXTS):
                h, bounds = shingle_sets(piece, "text", n_words)
                ids = piece.column("id").to_numpy()
                rows = _one_per_class(h, bounds, ids)
                if not len(rows):
                    continue
                at, owner = _entries(bounds, rows)
                h = h[at]
                sizes = np.bincount(owner, minlength=len(rows))
                room = sizes - -(-percent * sizes // 100) + 1
                rank = np.full(len(h), -1, np.int64)
                maybe = np.flatnonzero(known[(h & _U((1 << 24) - 1)).astype(np.int64)])
                if len(maybe):
                    place = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                    hit = hashes[place] == h[maybe]
                    rank[maybe[hit]] = ranks[place[hit]]
                seldom = rank < 0
                before = np.cumsum(seldom) - seldom
                first = np.cumsum(sizes) - sizes
                position = before - before[first][owner]
                keep = seldom & (position < room[owner])
                # Common entries fill what room is left, the least common first.
                left = room - np.bincount(owner[seldom], minlength=len(rows))
                often = np.flatnonzero(~seldom)
                often = often[np.lexsort((rank[often], owner[often]))]
                n_often = np.bincount(owner[often], minlength=len(rows))
                place = np.arange(len(often)) - np.repeat(np.cumsum(n_often) - n_often, n_often)
                keep[often[place < left[owner[often]]]] = True
                position[often] = np.bincount(owner[seldom], minlength=len(rows))[owner[often]] + place
                # Within a row hashes ascend, so its first ones are its sketch.
                sketch = np.arange(len(h)) - first[owner] < SKETCH
                h = np.concatenate([h[keep], h[sketch] | _SKETCHED])
                owner = np.concatenate([owner[keep], owner[sketch]])
                position = np.concatenate([position[keep], np.zeros(int(sketch.sum()), np.int64)]).astype(np.int32)
                bucket = (mix(h) % _U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                h, owner, position = h[order], owner[order], position[order]
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                used = np.flatnonzero(np.diff(edges))
                blobs = []
                for k in used:
                    part = slice(edges[k], edges[k + 1])
                    blobs.append(pack(h[part], ids[rows][owner[part]], sizes[owner[part]].astype(np.int32), position[part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "entries"]
                )

    return docs.mapInArrow(run, "bucket int, entries binary")


def _led_pairs(h: np.ndarray, ids: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (leader, member) in each column: every entry with two leaders of its column and size class,
    the least by id and the least by the id's hash.

    Size classes are two ratios of the threshold wide, in two grids half a class apart, so
    entries of admissible sizes share a class in one grid at least.
    """
    scale = np.log(n) / np.log(100 / percent)
    leaders, members = [], []
    for grid, rank in ((g, r) for g in (0, 1) for r in (ids, mix(ids.view(np.uint64)))):
        size_class = ((scale + grid) // 2).astype(np.int64)
        order = np.lexsort((rank, size_class, h))
        start = np.ones(len(h), bool)
        start[1:] = (h[order][1:] != h[order][:-1]) | (size_class[order][1:] != size_class[order][:-1])
        lead = order[np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))]
        fit = (ids[lead] != ids[order]) & (100 * np.minimum(n[lead], n[order]) >= percent * np.maximum(n[lead], n[order]))
        leaders.append(lead[fit])
        members.append(order[fit])
    return np.concatenate(leaders), np.concatenate(members)


def column_blocks(packed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Two kinds of rows (pair, x, y, nx, ny, shared) from each block of columns.

    Entries (column, document, size, place in ``ny``) of columns with more than one document; and pairs of
    documents with their sizes and overlap counts, linear in the entries, for the first pass.
    """

    def run(batches):
        parts = [unpack(b.as_py(), np.uint64, np.int64, np.int32, np.int32) for batch in batches for b in batch.column("entries")]
        if not parts:
            return
        h, ids, n, place = (np.concatenate([p[k] for p in parts]) for k in range(4))
        del parts
        order = np.argsort(h, kind="stable")
        ordered = h[order]
        same = ordered[1:] == ordered[:-1]
        several = np.zeros(len(h), bool)
        several[1:] |= same
        several[:-1] |= same
        chosen = order[several]
        h, ids, n, place = h[chosen], ids[chosen], n[chosen].astype(np.int64), place[chosen].astype(np.int64)
        # Of different rows of one id and size the least place counts.
        order = np.lexsort((place, ids, n, h))
        h, ids, n, place = h[order], ids[order], n[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1]) | (n[1:] != n[:-1])
        h, ids, n, place = h[new], ids[new], n[new], place[new]
        sketched = h >= _SKETCHED
        entry = ~sketched
        none = np.zeros(int(entry.sum()), np.int64)
        yield from batches_of(np.zeros(len(none), bool), h[entry].view(np.int64), ids[entry], n[entry], place[entry], none)
        h, ids, n = h[sketched], ids[sketched], n[sketched]
        leader, member = _led_pairs(h, ids, n, percent)
        a, b, na, nb = ids[leader], ids[member], n[leader], n[member]
        low = a < b
        pairs, counts = np.unique(
            np.column_stack([np.where(low, a, b), np.where(low, b, a), np.where(low, na, nb), np.where(low, nb, na)]),
            axis=0,
            return_counts=True,
        )
        yield from batches_of(np.ones(len(pairs), bool), *pairs.T, counts.astype(np.int64))

    def batches_of(*columns):
        names = ["pair", "x", "y", "nx", "ny", "shared"]
        for a in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[a : a + (1 << 16)])) for c in columns], names)

    return packed.repartition("bucket").mapInArrow(run, "pair boolean, x long, y long, nx long, ny long, shared long")


def first_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs (a, b) that share several sketch columns. A pair that misses this is left to the second pass."""
    pairs = blocks.where("pair").groupBy(F.col("x").alias("a"), F.col("y").alias("b"), F.col("nx").alias("na"), F.col("ny").alias("nb"))
    counted = pairs.agg(F.sum("shared").alias("shared"))
    return counted.where(f"shared >= least({SKETCH_SHARED}, ceil(least(na, nb) / 2D))").select("a", "b")


def shared_columns(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Entries (h, id, n, place, component) of columns that several components share; with the column's number of entries and its leader.

    ``entries`` (x column, y document, nx size, ny place).
    """
    labelled = entries.join(found.select(F.col("node").alias("y"), "component"), "y", "left").select(
        F.col("x").alias("h"), F.col("y").alias("id"), F.col("nx").alias("n"), F.col("ny").alias("place"), F.coalesce("component", "y").alias("component")
    )
    columns = labelled.groupBy("h").agg(
        F.min("component").alias("lo"),
        F.max("component").alias("hi"),
        F.count(F.lit(1)).alias("entries"),
        F.min(F.xxhash64("id")).alias("leader"),
    )
    return labelled.join(columns.where("lo < hi").select("h", "entries", "leader"), "h")


def tiles(live: DataFrame) -> DataFrame:
    """(leader, id, part, parts): the documents of busy columns, those of one leader dealt into parts of bounded weight."""
    members = live.where(f"entries >= {BUSY}").groupBy("leader", "id").agg(F.greatest(F.max("n"), F.lit(LIGHTEST)).alias("weight"))
    parts = members.groupBy("leader").agg(F.ceil(F.sum("weight") / PART).alias("parts"))
    return members.join(parts, "leader").select("leader", "id", F.pmod(F.xxhash64(F.lit("part"), "id"), "parts").alias("part"), "parts")


def spanning_forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, node) that join the nodes of each component of a symmetric boolean matrix."""
    todo = np.ones(len(linked), bool)
    roots, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for root in range(len(linked)):
        if not todo[root]:
            continue
        todo[root] = False
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & todo)
            todo[front] = False
            nodes.append(front)
            roots.append(np.full(len(front), root))
    return np.concatenate(roots), np.concatenate(nodes)


def tile_links(table: pa.Table, percent: int) -> pa.Table:
    """A spanning forest (a, b) of the links among the rows (id, entries) of a tile, by a product of sparse rows in strips of columns."""
    ids = table.column("id").to_numpy()
    raw, offsets = text_buffer(table.column("entries"))
    sizes = np.diff(offsets) // TILE_BYTES
    h, owner = _widened(raw, TILE_BYTES), np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    same = h[1:] == h[:-1]
    several = np.zeros(len(h), bool)
    several[1:] |= same
    several[:-1] |= same
    h, owner = h[several], owner[several]
    new = np.ones(len(h), np.int64)
    new[1:] = h[1:] != h[:-1]
    column = np.cumsum(new) - 1
    both = np.zeros((len(ids), len(ids)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, STRIP):
        a, b = np.searchsorted(column, (first, first + STRIP))
        strip = np.zeros((len(ids), STRIP), np.float32)
        strip[owner[a:b], column[a:b] - first] = 1
        both += strip @ strip.T
    roots, nodes = spanning_forest((both > 0) & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)))
    differ = ids[roots] != ids[nodes]
    return pa.table({"a": ids[roots[differ]], "b": ids[nodes[differ]]})


def tiled_links(dealt: DataFrame, docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that join what the documents of ``tiles``, given as a written table, join by similarity."""
    rows = dealt.join(whole_rows(docs, dealt.select("id").distinct(), n_words, TILE_BYTES), "id")
    # One part meets itself; of several, each meets every other one.
    others = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.expr("array_remove(sequence(0L, parts - 1), part)"))
    spread = rows.select("leader", "id", "entries", "part", F.explode(others).alias("other")).select(
        "leader", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "id", "entries"
    )

    def product(table):
        return tile_links(table.select(["id", "entries"]), percent)

    return spread.groupBy("leader", "lo", "hi").applyInArrow(product, "a long, b long")


def later_pairs(live: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of different components that share columns of ``shared_columns``, none of them busy, with enough overlap to qualify.

    Each block of columns is multiplied with itself, members of one component left out, and its overlap counts
    are summed per pair. A pair that shares a busy column too may miss the bound here; it meets in a tile.
    """

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        h, ids, n, place, component = (table.column(c).to_numpy() for c in ("h", "id", "n", "place", "component"))
        order = np.lexsort((component, h))
        h, ids, n, place, component = h[order], ids[order], n[order], place[order], component[order]
        # An entry meets all entries of later components in its column.
        edge = np.ones(len(h), bool)
        edge[:-1] = (h[1:] != h[:-1]) | (component[1:] != component[:-1])
        after = _next_true(edge)
        edge[:-1] = h[1:] != h[:-1]
        end = _next_true(edge)
        todo = end - after
        at = 0
        while at < len(h):
            upto = max(at + 1, int(np.searchsorted(np.cumsum(todo[at:]), 1 << 20, "right")) + at)
            left = np.repeat(np.arange(at, upto), todo[at:upto])
            ends = np.cumsum(todo[at:upto])
            right = np.arange(len(left)) - np.repeat(ends - todo[at:upto], todo[at:upto]) + after[left]
            at = upto
            fit = (100 * n[left] >= percent * n[right]) & (100 * n[right] >= percent * n[left]) & (ids[left] != ids[right])
            left, right = left[fit], right[fit]
            need, k = _bounds(n[left], n[right], percent)
            fit = (place[left] < n[left] - need + k) & (place[right] < n[right] - need + k)
            left, right = left[fit], right[fit]
            low = ids[left] < ids[right]
            x, y = np.where(low, left, right), np.where(low, right, left)
            pairs, counts = np.unique(np.column_stack([ids[x], ids[y], n[x], n[y]]), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(c)) for c in (*pairs.T, counts.astype(np.int64))], ["a", "b", "na", "nb", "shared"]
            )

    counted = live.where(f"entries < {BUSY}").select("h", "id", "n", "place", "component").repartition("h").mapInArrow(run, "a long, b long, na long, nb long, shared long")
    overlap = counted.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    need = f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}"
    least = f"1 + ({need} - ({percent} * greatest(na, nb) + 99) div 100) div {ROOM_PART}"
    return overlap.where(f"shared >= {least}").select("a", "b")


def _bounds(na: np.ndarray, nb: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlap that two sizes need, and how much of it lies in the first ``n - need + k`` entries of both."""
    need = -(-percent * (na + nb) // (100 + percent))
    return need, 1 + (need + (-percent * np.maximum(na, nb) // 100)) // ROOM_PART


def _next_true(flags: np.ndarray) -> np.ndarray:
    """For each place, one past the first true flag at or after it (the last flag is true)."""
    ends = np.flatnonzero(flags) + 1
    return ends[np.searchsorted(ends, np.arange(len(flags)), "right")]


def _widened(raw: np.ndarray, width: int) -> np.ndarray:
    entry = np.zeros((len(raw) // width, 8), np.uint8)
    entry[:, :width] = raw.reshape(-1, width)
    return entry.view(np.uint64).ravel()


def whole_rows(docs: DataFrame, wanted: DataFrame, n_words: int, width: int) -> DataFrame:
    """(id, entries): the shingle hashes, of ``width`` bytes each, of the documents whose id is in ``wanted``."""

    def rows(batches):
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 21, PIECE_TEXTS):
                h, bounds = shingle_sets(piece, "text", n_words)
                raw = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
                sets = [raw[width * i : width * j] for i, j in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(sets, pa.binary())], ["id", "entries"])

    # One plan at every size: the ids grow with the documents.
    return docs.join(wanted.hint("merge"), "id", "left_semi").mapInArrow(rows, "id long, entries binary")


def verified(pairs: DataFrame, docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b), given as a written table, whose similarity reaches the threshold, by a product of whole rows."""
    sets = whole_rows(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), n_words, ROW_BYTES)

    def product(batches):
        for batch in batches:
            for piece in pieces(batch, "ea", 1 << 20, PIECE_TEXTS):
                keys, sizes = [], []
                for name in ("ea", "eb"):
                    raw, offsets = text_buffer(piece.column(name))
                    sizes.append(np.diff(offsets) // ROW_BYTES)
                    owner = np.repeat(np.arange(piece.num_rows, dtype=np.uint64), sizes[-1])
                    keys.append((owner << _U(8 * ROW_BYTES)) | _widened(raw, ROW_BYTES))
                merged = np.concatenate(keys)
                merged.sort()
                equal = merged[1:][merged[1:] == merged[:-1]] >> _U(8 * ROW_BYTES)
                both = np.bincount(equal.astype(np.int64), minlength=piece.num_rows)
                linked = (both > 0) & (100 * both >= percent * (sizes[0] + sizes[1] - both))
                yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b")], ["a", "b"]).filter(pa.array(linked))

    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("entries").alias("ea")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("entries").alias("eb")), "b"
    )
    return full.select("a", "b", "ea", "eb").mapInArrow(product, "a long, b long")


def tree_links(found: DataFrame) -> DataFrame:
    return found.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def similar_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id``, the least document reachable by links.

    Defined results: a text without words (or NULL) has no shingles and is linked with nothing; with fewer
    words than a shingle, its whole sequence is its one shingle; a NULL id takes part as the greatest
    id and is NULL again in the result; rows of one id are one node that holds the links of all of
    them; an empty table gives no rows.
    """
    whole = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.col(text).alias("text"))
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = store(class_rows(whole, n_words), "classes")
    rows = both.where("not common")
    blocks = store(column_blocks(packed_prefixes(whole, common_shingles(both), buckets, n_words, percent), percent), "columns")
    # Copies of a class meet at its least document.
    least = rows.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("least"))
    copies = rows.join(least, ["n", "f1", "f2"]).where("id != least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    first = verified(store(first_pairs(blocks), "pairs"), whole, n_words, percent)
    found = store(components(first.unionByName(copies), "links"), "found")
    live = store(shared_columns(blocks.where("not pair"), found), "live")
    tiled = tiled_links(store(tiles(live), "tiles"), whole, n_words, percent)
    second = verified(store(later_pairs(live, percent), "pairs"), whole, n_words, percent)
    linked = components(tree_links(found).unionByName(second).unionByName(tiled), "components")
    out = rows.select("id", "n").join(linked.withColumnRenamed("node", "id"), "id", "left")

    def back(column):
        return F.when(column != LAST, column)

    return out.select(
        back(F.col("id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        back(F.coalesce("component", "id")).alias("component_id"),
    )


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, its least; of rows that repeat an id, the one with the least text."""
    name, count, rank = fresh(docs, "kept_id"), fresh(docs, "kept_rows"), fresh(docs, "kept_rank")
    kept = (
        similar_components(docs, doc_id, text)
        .where("doc_id <=> component_id")
        .groupBy(F.col("doc_id").alias(name))
        .agg(F.count("*").alias(count))
    )
    chosen = docs.join(kept, F.col(doc_id).eqNullSafe(F.col(name)))
    repeated = Window.partitionBy(doc_id).orderBy(text)
    again = chosen.where(F.col(count) > 1).withColumn(rank, F.row_number().over(repeated)).where(F.col(rank) == 1)
    return chosen.where(F.col(count) == 1).select(*docs.columns).unionByName(again.select(*docs.columns))


def one_row_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of similar texts: the one of least id, NULL last.

    Every row is a node of its own, so rows that repeat an id, or have none, meet only where their texts are
    similar; a text without words is similar to nothing and kept. Rows of one id in a group are chosen
    by a hash of their text. The row numbers are written once with the rows, in the shared folder.
    """
    row, group, best = fresh(docs, "row_number"), fresh(docs, "row_group"), fresh(docs, "row_chosen")
    rows = store(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = similar_components(rows, row, text).select(F.col("doc_id").alias(row), F.col("component_id").alias(group))
    order = F.struct(
        F.col(doc_id).isNull().alias("none"),
        F.col(doc_id).alias("id"),
        F.xxhash64(text).alias("text"),
        F.col(row).alias("row"),
    )
    chosen = (
        rows.select(row, order.alias(best)).join(found, row).groupBy(group).agg(F.min(best).alias(best)).select(F.col(f"{best}.row").alias(row))
    )
    return rows.join(chosen, row, "left_semi").select(*docs.columns)
