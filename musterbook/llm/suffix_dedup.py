"""Repeated byte strings across documents: interval trees over partitioned suffix arrays.

Every string of ``MIN_BYTES`` bytes has a key, the least hash of its ``GRAM``-byte substrings. Equal
strings have equal keys, and neighbouring strings mostly share theirs, so a document is cut
into segments of consecutive strings with one key, and the suffixes of the corpus are
partitioned by key without a global sort.

1. The different keys of each document, sorted and stored as differences, are packed into blocks by
   key; a key that only one document has is dropped. A key that several documents of one piece of text
   have is settled there: one document stands for them, so a hot key is one row per piece.
2. A document that gets keys back is cut again, its segments with these keys go with their bytes to
   the key's block, and a block builds an enhanced suffix array of its strings. Segments of equal bytes in one piece are settled there,
   too: the least document stands for them.
3. A stack scan over the common prefixes lists the intervals of the tree with a prefix of
   ``MIN_BYTES`` or more; those whose left neighbours differ are the maximal repeats, given
   with all occurrences, and each occurrence knows the least document of its repeat.

A string lies in one segment of one key, so every repeated string is found inside an interval
of its block. Only hashes decide equality of whole segments (64 bits, with their length). A
document is named by the 64-bit hash of its id and text; keys travel with 48 bits of it, and those returned to a wrong
document do no harm. Two documents with equal 48 bits (one pair in 2.8e14) that alone share a key are taken for one.

Defined results: a NULL text is empty; a NULL id counts as greater than all others; rows of one id
never remove from each other; repeated rows are treated alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterbook.llm.common import mix, pack_small, pieces, text_buffer, unpack
from musterbook.llm.ngram_jaccard import span_hashes

MIN_BYTES = 50
GRAM = 20
MOST_STRINGS = 64
LAST = 2**63 - 1
PLAIN, SETTLED, STANDS = 0, 1, 2
CHUNK = 20_000
MOST_LISTED = 1 << 18
_U = np.uint64


def window_keys(data: np.ndarray, min_bytes: int = MIN_BYTES, gram: int = GRAM) -> np.ndarray:
    """Key of the string of ``min_bytes`` bytes at each place."""
    if len(data) < min_bytes:
        return np.zeros(0, np.uint64)
    two = data[:-1].astype(np.uint64)
    two |= data[1:].astype(np.uint64) << _U(8)
    four = two[:-2] | (two[2:] << _U(16))
    eight = four[:-4] | (four[4:] << _U(32))
    n = len(data) - gram + 1
    h = eight[:n] * _U(0x9E3779B97F4A7C15)
    h ^= (eight[8 : 8 + n] * _U(0xC2B2AE3D27D4EB4F)) >> _U(7)
    h ^= four[gram - 4 : gram - 4 + n] * _U(0x165667B19E3779F9)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    # Least of the last (min_bytes - gram + 1) hashes, by windows of doubled width.
    width, need = 1, min_bytes - gram + 1
    while 2 * width <= need:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (need - width)], h[need - width :]) if need > width else h


def segments(data: np.ndarray, offsets: np.ndarray, min_bytes: int = MIN_BYTES):
    """(key, text, start in data, number of strings) of each run of strings with one key."""
    keys = window_keys(data, min_bytes)
    sizes = np.maximum(np.diff(offsets) - min_bytes + 1, 0)
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(offsets[:-1], sizes)
    if not len(at):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    keys = keys[at]
    new = np.ones(len(at), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    # Very long runs (periodic text) are cut: each string still lies in one segment.
    parts = -(-n // MOST_STRINGS)
    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    run = np.repeat(np.arange(len(first)), parts)
    count = np.minimum(n[run] - part * MOST_STRINGS, MOST_STRINGS)
    return keys[first][run], text[first][run], at[first][run] + part * MOST_STRINGS, count


def _group(*columns: np.ndarray) -> np.ndarray:
    """Number of the group of equal values of each row, groups in order of the columns."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), np.int64)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    return group


def _least(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id of each group."""
    out = np.full(int(group.max(initial=-1)) + 1, LAST, np.int64)
    np.minimum.at(out, group, ids)
    return out


def _most(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.full(int(group.max(initial=-1)) + 1, -LAST, np.int64)
    np.maximum.at(out, group, ids)
    return out


def _segments_of(piece: pa.RecordBatch, min_bytes: int):
    """``segments`` of the texts of a piece, with bounded work arrays."""
    text, at = 0, 0
    for part in pieces(piece, "text"):
        data, offsets = text_buffer(part.column("text"))
        key, number, start, n = segments(data, offsets, min_bytes)
        yield key, number + text, start + at, n
        text += part.num_rows
        at += len(data)


def _planes(values: np.ndarray) -> np.ndarray:
    """The bytes of all values by their rank in the value: high bytes of small numbers lie together and compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).ravel()


def _unplaned(planes: np.ndarray, kind) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def shared_keys(docs: DataFrame, buckets: int, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(tag, key) of the keys that more than one document has. ``docs`` is (id, fp, tag, text)."""

    def cut(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PIECE, batch.num_rows):
                key, text = (np.concatenate(c) for c in list(zip(*_segments_of(piece, min_bytes)))[:2])
                if not len(key):
                    continue
                key = _block_keys(key, buckets)
                # Stable, so the documents of one key stay in order and a repeated one follows itself.
                order = np.argsort(key, kind="stable")
                key, text = key[order], text[order]
                new = np.r_[True, key[1:] != key[:-1]]
                different = new | np.r_[True, text[1:] != text[:-1]]
                key, fps = key[different], piece.column("tag").to_numpy()[text[different]]
                head = np.flatnonzero(new[different])
                several = np.minimum.reduceat(fps, head) < np.maximum.reduceat(fps, head)
                settled = np.repeat(several, np.diff(np.append(head, len(key))))
                # One document of a settled key stands in the key's block; all go on from any block.
                stands = head[several]
                rows = np.r_[np.arange(len(key)), stands]
                flag = np.r_[np.where(settled, SETTLED, PLAIN), np.full(len(stands), STANDS)].astype(np.uint8)
                bucket = key[rows] >> 32
                place = np.where(flag == SETTLED, (mix(fps[rows].view(np.uint64)) % _U(buckets)).astype(np.int64), bucket)
                yield _keys_dealt(place, key[rows], flag, fps[rows])

    def sift(batches):
        parts = [unpack(b.as_py(), *KEY_TYPES) for batch in batches for b in batch.column("packed")]
        if not parts:
            return
        columns = [(np.cumsum(_unplaned(k, np.int64)), flag, _unplaned(np.r_[fps, np.zeros((8 - TAG_BYTES) * len(flag), np.uint8)], np.int64)) for k, flag, fps in parts]
        key, flag, fps = (np.concatenate(c) for c in zip(*columns))
        mine = np.flatnonzero(flag != SETTLED)
        mine = mine[np.argsort(key[mine])]
        shared = flag == SETTLED
        if len(mine):
            head = np.flatnonzero(np.r_[True, key[mine][1:] != key[mine][:-1]])
            found = np.minimum.reduceat(fps[mine], head) < np.maximum.reduceat(fps[mine], head)
            found |= np.maximum.reduceat(flag[mine], head) == STANDS
            shared[mine] = np.repeat(found, np.diff(np.append(head, len(mine)))) & (flag[mine] == PLAIN)
        yield from _batches([fps[shared], key[shared]], ["tag", "key"])

    packed = docs.mapInArrow(cut, "bucket int, packed binary").repartitionById(buckets, F.col("bucket"))
    return packed.mapInArrow(sift, "tag long, key long")


def _block_keys(key: np.ndarray, buckets: int) -> np.ndarray:
    """Block number (high half) and 32 more bits of each key."""
    key = mix(key)
    return ((key % _U(buckets)).astype(np.int64) << 32) | (key >> _U(32)).astype(np.int64)


def _keys_dealt(place: np.ndarray, key: np.ndarray, flag: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
    """One row (bucket, packed keys) for each place; keys ascend and are stored as differences."""
    order = np.lexsort((key, place))
    place, key, flag, fps = (c[order] for c in (place, key, flag, fps))
    edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
    blobs = [pack_small(_planes(np.diff(key[a:b], prepend=0)), flag[a:b], _planes(fps[a:b])[: TAG_BYTES * (b - a)]) for a, b in zip(edges, edges[1:])]
    return pa.RecordBatch.from_arrays([pa.array(place[edges[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "packed"])


KEY_TYPES = (np.uint8, np.uint8, np.uint8)
PIECE = 8 << 20
# Blocks for each shuffle partition.
BLOCKS = 2
# Bytes of the name by which a document's keys travel and by which it gets back keys and spans.
TAG_BYTES = 6


def _strings_received(batches):
    """Bytes, id, fp, start, size and first id of the segments of a task; nothing if there are none."""
    parts = [unpack(b.as_py(), *[np.uint8] * 6) for batch in batches for b in batch.column("packed")]
    if parts:
        wide = [[c if k in (0, 4) else _unplaned(c, np.int64) for k, c in enumerate(part)] for part in parts]
        del parts
        yield [np.concatenate(c) for c in zip(*wide)]


def _segment_hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of segments that lie one after the other, a bounded stretch of ``data`` at a time."""
    out = np.empty(len(at), np.uint64)
    stretch = at // (1 << 20)
    edges = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1], True])
    for a, b in zip(edges, edges[1:]):
        low, high = int(at[a]), int(at[b - 1] + size[b - 1])
        out[a:b] = span_hashes(data[low:high], at[a:b] - low, at[a:b] + size[a:b] - low)
    return out


def _batches(columns: list[np.ndarray], names: list[str], most: int = 1 << 16):
    for a in range(0, len(columns[0]), most):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[a : a + most])) for c in columns], names)


def _united(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Occurrences (id, fp, start, length, first) with those of a document that touch joined."""
    ids, fps, start, length, first = columns
    if not len(ids):
        return columns
    # One number for the document and the place in it, so one sort; a hash that stands for two ids takes a slower way.
    named, document = np.unique(fps, return_inverse=True)
    id_of = np.empty(len(named), np.int64)
    id_of[document] = ids
    if (id_of[document] != ids).any():
        document = _group(ids, fps)
    order = np.argsort((document << 32) | start)
    ids, fps, start, length, first, document = (c[order] for c in (ids, fps, start, length, first, document))
    same = np.r_[False, document[1:] == document[:-1]]
    # Ends grow monotonically inside a document when each document starts above the last one's ends.
    lift = document * (int((start + length).max()) + 1)
    reach = np.maximum.accumulate(start + length + lift)
    head = np.r_[True, ~same[1:] | (start[1:] + lift[1:] > reach[:-1])]
    heads = np.flatnonzero(head)
    ends = reach[np.r_[heads[1:] - 1, len(ids) - 1]] - lift[heads]
    return [ids[heads], fps[heads], start[heads], ends - start[heads], np.minimum.reduceat(first, heads)]


def _with_text(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """One number for a key and the text of a piece that has it; a clash only takes one segment more."""
    return mix(key.view(np.uint64)) + text.astype(np.uint64) * _U(0x9E3779B97F4A7C15)


def _bytes_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    return data[at]


def maximal_repeats(
    docs: DataFrame, shared: DataFrame, buckets: int, min_bytes: int = MIN_BYTES, later_only: bool = False
) -> DataFrame:
    """Occurrences (id, fp, start, length, first_id) of all maximal repeats of the segments with ``shared`` keys.

    ``docs`` is (id, fp, tag, text), ``shared`` is (tag, key). ``first_id`` is the least document that holds the repeated string.
    With ``later_only`` occurrences in the first document are left out and the others of one
    document are united inside each block (``first_id`` is then the least of the united ones).
    """
    listed = shared.groupBy("tag").agg(F.collect_list("key").alias("found"))
    joined = docs.join(listed, "tag", "left").where("found is not null")

    def fill(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PIECE, batch.num_rows):
                data, offsets = text_buffer(piece.column("text"))
                ids, fps = (piece.column(c).to_numpy() for c in ("id", "fp"))
                found = piece.column("found")
                owner = np.repeat(np.arange(piece.num_rows), pa.compute.list_value_length(found).to_numpy())
                wanted = np.sort(_with_text(found.flatten().to_numpy(), owner))
                taken = []
                for key, text, at, n in _segments_of(piece, min_bytes):
                    key = _block_keys(key, buckets)
                    mine = _with_text(key, text)
                    mine = wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine
                    taken.append([c[mine] for c in (key, text, at, n)])
                key, text, at, n = (np.concatenate(c) for c in zip(*taken))
                size = n + min_bytes - 1
                start = at - offsets[text]
                content = _segment_hashes(data, at, size)
                group = _group(content, size)
                least = _least(group, ids[text])[group]
                later = ids[text] > least
                bucket = np.where(later, (mix(fps.view(np.uint64)) % _U(buckets)).astype(np.int64)[text], key >> 32)
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1], True]) if len(order) else np.zeros(1, int)
                blobs = []
                for a, b in zip(edges, edges[1:]):
                    rows = order[a:b]
                    with_bytes = np.where(later[rows], 0, size[rows])
                    blobs.append(
                        pack_small(
                            _bytes_of(data, at[rows], with_bytes),
                            *[_planes(x) for x in (ids[text[rows]], fps[text[rows]], start[rows])],
                            size[rows].astype(np.uint8),
                            _planes(np.where(later[rows], least[rows], LAST)),
                        )
                    )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[order][edges[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "packed"]
                )

    def occurrences(batches):
        for data, ids, fps, start, size, first in _strings_received(batches):
            size = size.astype(np.int64)
            later = first < LAST
            yield ids[later], fps[later], start[later], size[later], first[later]
            rows = np.flatnonzero(~later)
            ids, fps, start, size = ids[rows], fps[rows], start[rows], size[rows]
            at = np.cumsum(size) - size
            for row, offset, length, least in block_repeats(data, at, size, ids, min_bytes):
                yield ids[row], fps[row], start[row] + offset, length, least

    def scan(batches):
        names = ["id", "fp", "start", "length", "first_id"]
        held, total = [], 0
        for columns in occurrences(batches):
            if not later_only:
                yield from _batches(list(columns), names)
                continue
            held.append([c[columns[0] > columns[4]] for c in columns])
            total += len(held[-1][0])
            if total > 1 << 20:
                held = [_united([np.concatenate(c) for c in zip(*held)])]
                total = 0
        if held:
            yield from _batches(_united([np.concatenate(c) for c in zip(*held)]), names)

    packed = joined.select("id", "fp", "text", "found").mapInArrow(fill, "bucket int, packed binary")
    return packed.repartitionById(buckets, F.col("bucket")).mapInArrow(scan, "id long, fp long, start long, length long, first_id long")


def block_repeats(data: np.ndarray, at: np.ndarray, size: np.ndarray, ids: np.ndarray, min_bytes: int = MIN_BYTES):
    """Yield arrays (segment, offset in it, length, least id) of the occurrences of a block's maximal repeats."""
    if not len(at):
        return
    group = _group(_segment_hashes(data, at, size), size)
    least, most = _least(group, ids), _most(group, ids)
    # Equal segments are an interval of their whole length; its left neighbours are unknown, so it counts as maximal.
    whole = (least < most)[group]
    yield np.flatnonzero(whole), np.zeros(int(whole.sum()), np.int64), size[whole], least[group][whole]
    members = np.argsort(group, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(group))])
    distinct = members[bounds[:-1]]
    # Only keys with several different segments need the array; their strings share prefixes of min_bytes.
    keys = window_key_of(data, at[distinct], min_bytes)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    busy = np.zeros(len(order), bool)
    busy[1:] |= same
    busy[:-1] |= same
    order = order[busy]
    if not len(order):
        return
    count = size[distinct[order]] - min_bytes + 1
    total = np.cumsum(count)
    turn = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    cut = [0]
    for t in turn[1:]:
        if total[t - 1] - (total[cut[-1] - 1] if cut[-1] else 0) >= CHUNK:
            cut.append(int(t))
    for a, b in zip(cut, [*cut[1:], len(order)]):
        chosen = order[a:b]
        yield from _array_repeats(data, at, size, distinct[chosen], chosen, members, bounds, ids, least, min_bytes)


def window_key_of(data: np.ndarray, at: np.ndarray, min_bytes: int) -> np.ndarray:
    """Key of the string at each place."""
    out = np.empty(len(at), np.uint64)
    for a in range(0, len(at), 20_000):
        rows = at[a : a + 20_000]
        flat = _bytes_of(data, rows, np.full(len(rows), min_bytes))
        out[a : a + len(rows)] = window_keys(flat, min_bytes)[::min_bytes]
    return out


def _array_repeats(data, at, size, rows, groups, members, bounds, ids, least, min_bytes):
    """Repeats of the strings of some distinct segments, an array of a bounded number of strings at a time.

    Strings that differ in their first ``min_bytes`` bytes share no interval, so a busy key is cut between these.
    """
    flat = _bytes_of(data, at[rows], size[rows])
    base = np.cumsum(size[rows]) - size[rows]
    count = size[rows] - min_bytes + 1
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), count)
    offset = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
    place = base[owner] + offset
    lead = span_hashes(flat, place, place + min_bytes)
    order = np.argsort(lead, kind="stable")
    new = np.r_[True, lead[order][1:] != lead[order][:-1], True]
    alone = new[:-1] & new[1:]
    order, turn = order[~alone], np.flatnonzero(new[:-1][~alone])
    if not len(order):
        return
    last = np.append(turn[1:], len(order))
    # Groups in order until an array has CHUNK strings.
    part = last // CHUNK
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    for a, b in zip(cuts, cuts[1:]):
        low, high = turn[a], last[b - 1]
        chosen = order[low:high]
        number = np.repeat(np.arange(b - a), last[a:b] - turn[a:b])
        yield from _interval_repeats(
            flat, place[chosen], owner[chosen], offset[chosen], number, size[rows], rows, groups, members, bounds, ids, least, min_bytes
        )


def _interval_repeats(flat, place, owner, offset, number, size, rows, groups, members, bounds, ids, least, min_bytes):
    """Enhanced suffix array of strings, whose ``number`` names their first ``min_bytes`` bytes, and the scan of its tree."""
    tail = size[owner] - offset - min_bytes
    wide = int(tail.max())
    columns = np.arange(wide, dtype=np.int32)
    matrix = np.zeros((len(place), 4 + wide), np.uint8)
    matrix[:, :4] = number.astype(">u4").view(np.uint8).reshape(-1, 4)
    inside = columns < tail[:, None]
    # 255 is no byte of UTF-8, so 0 marks the end.
    matrix[:, 4:][inside] = flat[((place + min_bytes)[:, None] + columns)[inside]] + np.uint8(1)
    suffixes = np.argsort(matrix.view(f"S{4 + wide}").ravel(), kind="stable")
    matrix, place, owner, offset, tail, number = (x[suffixes] for x in (matrix, place, owner, offset, tail, number))
    differ = matrix[1:, 4:] != matrix[:-1, 4:]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), wide) if wide else np.zeros(len(differ), np.int64)
    common = np.minimum(common, np.minimum(tail[1:], tail[:-1])) + min_bytes
    common[number[1:] != number[:-1]] = 0
    before = np.where(offset > 0, flat[np.maximum(place - 1, 0)].astype(np.int64), -1 - np.arange(len(offset)))
    lowest = least[groups][owner]
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    found = np.array(list(tree_intervals(common, min_bytes)), np.int64).reshape(-1, 3)
    depth, low, high = found[changes[found[:, 1]] != changes[found[:, 2]]].T
    # Intervals nest, so their occurrences are listed a bounded number at a time.
    copies = np.append(0, np.cumsum((bounds[groups + 1] - bounds[groups])[owner]))
    part = np.cumsum(copies[high + 1] - copies[low]) // MOST_LISTED
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
    for a, b in zip(cuts, cuts[1:]):
        d, lo, hi = depth[a:b], low[a:b], high[a:b]
        n = hi - lo + 1
        edges = np.cumsum(n) - n
        suffix = np.arange(n.sum()) - np.repeat(edges, n) + np.repeat(lo, n)
        first = np.repeat(np.minimum.reduceat(lowest[suffix], edges), n)
        d, g = np.repeat(d, n), groups[owner[suffix]]
        n = bounds[g + 1] - bounds[g]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[g], n)
        yield members[entry], np.repeat(offset[suffix], n), np.repeat(d, n), np.repeat(first, n)


def tree_intervals(common: np.ndarray, least: int):
    """Intervals (prefix length, first, last) of the common-prefix tree with at least ``least`` in common."""
    deep = np.flatnonzero(common >= least)
    if not len(deep):
        return
    starts = np.flatnonzero(np.r_[True, np.diff(deep) > 1])
    for a, b in zip(starts, [*starts[1:], len(deep)]):
        stack: list[tuple[int, int]] = []
        first = int(deep[a])
        values = [*common[first : int(deep[b - 1]) + 1].tolist(), 0]
        for i, value in enumerate(values, first):
            left = i
            while stack and stack[-1][0] > value:
                depth, left = stack.pop()
                yield depth, left, i
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, left))


def _tag():
    return F.col("fp").bitwiseAND(F.lit((1 << 8 * TAG_BYTES) - 1)).alias("tag")


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES, with_kept: bool = True
) -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and (``with_kept``) the ``kept`` bytes.

    Removed is each byte of a string of ``min_bytes`` bytes that starts in a smaller document, too.
    """
    # A block is unpacked whole, so it is half of a shuffle partition, and a task of its own. A piece sends at most one
    # row to each: more blocks than tasks would make rows without spreading the work.
    buckets = BLOCKS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"),
        F.xxhash64(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), F.col(text)).alias("fp"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    whole = whole.select("id", "fp", _tag(), "text")
    shared = shared_keys(whole, buckets, min_bytes)
    repeats = maximal_repeats(whole, shared, buckets, min_bytes, later_only=True)
    # Both lists come from the same rows, so their places agree.
    spans = repeats.groupBy(_tag()).agg(
        F.collect_list("fp").alias("owners"), F.collect_list(F.expr("start << 32 | length")).alias("spans")
    )

    def apply(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows = [
                    (None if doc == LAST else doc, *cut(fp, content.encode(), owner, span))
                    for doc, fp, content, owner, span in zip(
                        *(piece.column(c).to_pylist() for c in ("id", "fp", "text")), piece.column("owners"), piece.column("spans")
                    )
                ]
                columns = list(zip(*rows))[: len(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    def cut(fp, raw, owners, spans):
        own, packed = (x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64) for x in (owners, spans))
        packed = packed[own == fp]
        start, length = packed >> 32, packed & 0xFFFFFFFF
        if not len(start):
            return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw
        order = np.argsort(start, kind="stable")
        start = start[order]
        end = np.maximum.accumulate(start + length[order])
        head = np.r_[True, start[1:] > end[:-1]]
        edges = list(zip(start[head].tolist(), end[np.r_[head[1:], True]].tolist()))
        ends = [0, *(b for _, b in edges)]
        kept = b"".join([raw[a:b] for a, b in zip(ends, [*(a for a, _ in edges), len(raw)])])
        return len(raw), len(raw) - len(kept), len(edges), hashlib.sha256(kept).hexdigest(), kept

    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_kept
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds)]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return whole.join(spans, "tag", "left").select("id", "fp", "text", "owners", "spans").mapInArrow(apply, schema)
