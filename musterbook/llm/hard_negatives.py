"""Hard negatives by angular triangle filtering.

A vector's components become whole numbers, and its angles to a few reference directions are stored
with it. On the sphere the triangle inequality bounds the angle of two vectors by those angles:
``|s - t| <= angle <= s + t`` for the angles s and t to any reference. With the norms this is an
interval for the score, widened by more than the rounding of its parts; only where it
overlaps the window of scores that an anchor still looks for, the whole-numbered inner product is
taken. The result does not depend on the references, they only decide how much is skipped.

* Vectors are sorted by their nearest reference and the angle to it and written as blocks of
  ``BLOCK`` rows, each with its ranges of angles and norms. A block is first tested as a whole against
  every anchor; inside, the rows in question are one stretch of the sorted angles.
* Anchors are the stated query set: they meet all blocks in chunks of bounded size (``CHUNK_BYTES``), one broadcast
  each. Tasks keep the first few rows of each anchor as they go, which narrows its window,
  and return those; a window function takes the first few of all tasks.
* First run: positives, of the anchor's label. Second run: negatives of each (anchor, positive), in the
  window that the positive's score opens.
* Reference directions are chosen farthest-first among at most ``SAMPLE`` rows.

Scores are exact: products of norms bound them, in double precision below 2^53 and in 64-bit integers beyond.

Results on odd input: rows with a NULL id, label, vector or component, or one that is not finite, take no part, nor
do those whose whole-numbered components have squares adding up to 2^62 or more (their scores would not fit a
long); shorter vectors, empty ones too, count as ending in zeros; repeated rows are rows of their own, so
another row with the anchor's id can be its positive, and rows tied in score and id are interchangeable;
an anchor without another row of its label, or a positive of negative score, gives no rows; an empty table gives none.
Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from musterbook.llm.common import pack, store, unpack

SCALE = 256
QUERIES = 100
POSITIVES = NEGATIVES = 5
LOWEST, HIGHEST = 80, 100
RELABELLED, LABELS = 7, 10
REFERENCES = 12
SAMPLE = 2048
BLOCK = 1024
CHUNK_BYTES = 32 << 20
# Rounding of cosines and of angles is far smaller than these.
COSINE_MARGIN, ANGLE_MARGIN = 1e-9, 1e-6
NONE = np.iinfo(np.int64).min


def taking_part(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that count, with the labels of every seventh id moved on."""
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    moved = F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(finite).withColumn("label", moved)


def matrix_of(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole-numbered components, rows filled up with zeros, and which rows are small enough to take part."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    full = np.zeros((len(lengths), width))
    full[np.arange(width) < lengths[:, None]] = flat
    with np.errstate(over="ignore"):
        small = (full * full).sum(1) < 2.0**62
    return np.where(small[:, None], full, 0).astype(np.int32), small


def references(sample: np.ndarray, most: int = REFERENCES) -> np.ndarray:
    """Unit vectors of the sample, each the farthest from those before it."""
    norms = np.sqrt((sample.astype(float) ** 2).sum(1))
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(most, len(unit)) and nearest.min() < 1 - COSINE_MARGIN:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def angles_to(vectors: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles in radians; those of a zero vector count as 0, its scores are 0 by its norm."""
    cosines = vectors @ directions.T / np.where(norms > 0, norms, 1)[:, None]
    return np.where(norms[:, None] > 0, np.arccos(np.clip(cosines, -1, 1)), 0)


def encoder(width: int, directions: np.ndarray):
    def encode(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            whole, small = matrix_of(batch.column("vector"), width)
            whole = whole[small]
            norms = np.sqrt((whole.astype(float) ** 2).sum(1))
            angles = angles_to(whole.astype(float), norms, directions)
            home = angles.argmin(1) if angles.shape[1] else np.zeros(len(whole), np.int64)
            nearest = angles.min(1) if angles.shape[1] else np.zeros(len(whole))
            row = (part << 40) + seen + np.arange(len(whole))
            seen += len(whole)
            kept = batch.filter(pa.array(small))
            yield pa.RecordBatch.from_arrays(
                [
                    kept.column("vec_id"),
                    kept.column("label"),
                    *map(pa.array, (row.astype(np.int64), home.astype(np.int32), nearest, norms)),
                    pa.array([v.tobytes() for v in whole], pa.binary()),
                    pa.array([a.tobytes() for a in angles], pa.binary()),
                ],
                names=["vec_id", "label", "row", "home", "angle", "norm", "vector", "angles"],
            )

    return encode


CODED = "vec_id long, label long, row long, home int, angle double, norm double, vector binary, angles binary"


def unpacked(rows: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "row", "home", "angle", "norm")}
    for name, kind in (("vector", np.int32), ("angles", np.float64)):
        out[name] = np.frombuffer(b"".join(rows.column(name).to_pylist()), kind).reshape(rows.num_rows, -1)
    return out


def to_blocks(batches):
    """Blocks of rows in their order; a task's last block may be short."""
    held: list[pa.RecordBatch] = []

    def block(rows: pa.Table):
        of = unpacked(rows.combine_chunks().to_batches()[0])
        low, high = of["angles"].min(0), of["angles"].max(0)
        blob = pack(*(of[c] for c in FIELDS), low, high)
        return pa.RecordBatch.from_arrays([pa.array([rows.num_rows], pa.int64()), pa.array([blob], pa.binary())], names=["rows", "block"])

    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= BLOCK:
            table = pa.Table.from_batches(held)
            yield block(table.slice(0, BLOCK))
            held = table.slice(BLOCK).to_batches()
    if sum(b.num_rows for b in held):
        yield block(pa.Table.from_batches(held))


FIELDS = ["vec_id", "label", "row", "home", "angle", "norm", "vector"]
KINDS = [np.int64, np.int64, np.int64, np.int32, np.float64, np.float64, np.int32, np.float64, np.float64]


def from_block(blob: bytes, rows: int) -> dict[str, np.ndarray]:
    *values, low, high = unpack(blob, *KINDS)
    return dict(zip(FIELDS, values)) | {"vector": values[-1].reshape(rows, -1), "low": low, "high": high}


def ratio(score: np.ndarray, least: np.ndarray, most: np.ndarray, loose: float) -> np.ndarray:
    """score / product of norms at the end of the range that gives the least (loose < 0) or the largest quotient."""
    divisor = np.where((score > 0) == (loose < 0), most, least)
    with np.errstate(divide="ignore", invalid="ignore"):
        quotient = score / divisor
    never = np.where((score > 0) & (loose < 0), np.inf, loose)
    return np.where(divisor > 0, quotient, never)


class Search:
    """The first ``most`` rows of each anchor and window, over the blocks that a task sees.

    ``low`` and ``high`` (anchors x windows) bound the scores in question, both included; ``same`` asks for rows
    of the anchor's label (other than the anchor itself), else for rows of other labels.
    """

    def __init__(self, anchors: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray, same: bool, most: int):
        self.anchors, self.low, self.high, self.same, self.most = anchors, low, high, same, most
        self.score = np.full((*low.shape, most), NONE)
        self.vec_id = np.zeros((*low.shape, most), np.int64)
        self.scored = 0

    def add(self, block: dict[str, np.ndarray]) -> None:
        wanted = np.maximum(self.low, self.score[:, :, -1])
        open_ = wanted <= self.high
        least = np.where(open_, wanted, np.iinfo(np.int64).max).min(1).astype(float)
        most = np.where(open_, self.high, NONE).max(1).astype(float)
        norm = self.anchors["norm"]
        small, large = norm * block["norm"].min(), norm * block["norm"].max()
        # The angle may be at most ``near`` and has to be at least ``far``.
        cosine = ratio(least, small, large, -np.inf) - COSINE_MARGIN
        near = np.where(cosine > 1, -1.0, np.arccos(np.clip(cosine, -1, 1)) + ANGLE_MARGIN)
        far = np.arccos(np.clip(ratio(most, small, large, np.inf) + COSINE_MARGIN, -1, 1)) - ANGLE_MARGIN
        angles = self.anchors["angles"]
        meets = (angles - near[:, None] <= block["high"]) & (angles + near[:, None] >= block["low"])
        meets &= angles + block["high"] >= far[:, None]
        active = np.flatnonzero(meets.all(1) & (near >= 0) & open_.any(1))
        home = int(block["home"][0])
        one_home = (block["home"] == home).all() and angles.shape[1] > 0
        for at in range(0, len(active), 256):
            some = active[at : at + 256]
            first, last = 0, len(block["row"])
            if one_home:
                own = angles[some, home]
                first = int(np.searchsorted(block["angle"], np.maximum(own - near[some], far[some] - own).min(), "left"))
                last = int(np.searchsorted(block["angle"], (own + near[some]).max(), "right"))
            if first < last:
                self.take(block, slice(first, last), some)

    def take(self, block: dict[str, np.ndarray], rows: slice, some: np.ndarray) -> None:
        vectors, own = block["vector"][rows], self.anchors["vector"][some]
        exact = block["norm"][rows].max() * self.anchors["norm"][some].max() < 2.0**52
        kind = np.float64 if exact else np.int64
        score = (own.astype(kind) @ vectors.T.astype(kind)).astype(np.int64)
        self.scored += score.size
        fits = (self.anchors["label"][some][:, None] == block["label"][rows]) == self.same
        if self.same:
            fits &= self.anchors["row"][some][:, None] != block["row"][rows]
        low = np.maximum(self.low[some], self.score[some, :, -1])
        found = [np.nonzero(fits & (score >= low[:, [k]]) & (score <= self.high[some][:, [k]])) for k in range(low.shape[1])]
        target = np.concatenate([some[a] * low.shape[1] + k for k, (a, _) in enumerate(found)])
        if not len(target):
            return
        value = np.concatenate([score[f] for f in found])
        vec_id = np.concatenate([block["vec_id"][rows][r] for _, r in found])
        touched = np.unique(target)
        kept_score, kept_id = self.score.reshape(-1, self.most), self.vec_id.reshape(-1, self.most)
        target = np.concatenate([target, np.repeat(touched, self.most)])
        value = np.concatenate([value, kept_score[touched].ravel()])
        vec_id = np.concatenate([vec_id, kept_id[touched].ravel()])
        order = np.lexsort((vec_id, ~value, target))
        target, value, vec_id = target[order], value[order], vec_id[order]
        place = np.arange(len(target)) - np.searchsorted(target, target)
        first = place < self.most
        kept_score[target[first], place[first]] = value[first]
        kept_id[target[first], place[first]] = vec_id[first]

    def found(self) -> pa.RecordBatch:
        anchor, window, place = np.nonzero(self.score != NONE)
        values = (self.anchors["row"][anchor], window.astype(np.int64), self.score[anchor, window, place], self.vec_id[anchor, window, place])
        return pa.RecordBatch.from_arrays(list(map(pa.array, values)), names=["anchor", "slot", "score", "vec_id"])


def searcher(shared, same: bool, most: int):
    def search(batches):
        state = Search(*shared.value, same, most)
        for batch in batches:
            for rows, blob in zip(batch.column("rows").to_pylist(), batch.column("block")):
                state.add(from_block(blob.as_py(), rows))
        yield state.found()

    return search


def first_rows(blocks: DataFrame, anchors: dict, low: np.ndarray, high: np.ndarray, same: bool, most: int) -> DataFrame:
    """(anchor, slot, place, score, vec_id): the first ``most`` rows of each window over all blocks, written once."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast((anchors, low, high))
    local = blocks.mapInArrow(searcher(shared, same, most), "anchor long, slot long, score long, vec_id long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    out = store(local.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most), "first")
    shared.destroy()
    return out


def hard_negatives(
    embeddings: DataFrame,
    every: int = QUERIES,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive."""
    spark = embeddings.sparkSession
    rows = taking_part(embeddings)
    size = rows.agg(F.max(F.size("vector")).alias("width")).first()
    width = max(1, size["width"] or 1)
    # At most SAMPLE rows and 2 MB, by a hash of the id.
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(64, min(SAMPLE, (1 << 18) // width))).select("vector").toArrow()
    sample, small = matrix_of(some.column("vector"), width)
    directions = references(sample[small])

    coded = store(rows.mapInArrow(encoder(width, directions), CODED), "vectors")
    count = coded.count()
    parts = max(-(-count // (1 << 18)), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // 4096)), 1)
    order = ["home", "angle", "vec_id", "row"]
    sorted_ = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = store(sorted_.mapInArrow(to_blocks, "rows long, block binary"), "blocks")

    queries = coded.where(F.col("vec_id") % every == 0)
    asked = queries.count()
    chunks = -(-asked * (width * 4 + 8 * len(directions) + 64 + 16 * positives * negatives) // chunk_bytes)
    out = None
    for chunk in range(max(1, chunks)):
        own = queries.where(F.pmod(F.xxhash64("row"), F.lit(max(1, chunks))) == chunk)
        table = own.orderBy(*order).toArrow().combine_chunks().to_batches()
        if not table:
            continue
        anchors = unpacked(table[0])
        shape = (len(anchors["row"]), 1)
        found = first_rows(blocks, anchors, np.full(shape, NONE + 1), np.full(shape, np.iinfo(np.int64).max), True, positives)
        best = found.select("anchor", "place", "score", F.col("vec_id").alias("positive_id"))
        # At most ``positives`` rows per anchor of the chunk.
        told = best.select("anchor", "place", "score").toArrow()
        low = np.full((shape[0], positives), 1)
        high = np.zeros((shape[0], positives), np.int64)
        by_row = np.argsort(anchors["row"])
        anchor = by_row[np.searchsorted(anchors["row"], told.column("anchor").to_numpy(), sorter=by_row)]
        slot, score = told.column("place").to_numpy() - 1, told.column("score").to_numpy()
        low[anchor, slot] = [-(-lowest * s // 100) for s in score.tolist()]
        high[anchor, slot] = [highest * s // 100 for s in score.tolist()]
        mined = first_rows(blocks, anchors, low, high, False, negatives)
        names = own.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        joined = (
            mined.select("anchor", (F.col("slot") + 1).alias("place"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(best.withColumnRenamed("score", "positive_score"), ["anchor", "place"])
            .join(names, "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
        )
        out = joined if out is None else out.unionByName(joined)
    if out is None:
        schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        out = spark.createDataFrame([], schema)
    return out
