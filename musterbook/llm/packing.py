"""Pack token sequences into windows by non-negative least squares over a histogram of lengths.

* Every text is encoded once, in Arrow batches, and written with its ids (little-endian
  32-bit) to the shared folder; every later step takes bytes out of that column.
* A document's whole windows are sequences of their own; what is left of each document,
  shorter than a window, is counted by length: a histogram of at most ``window`` numbers,
  whatever the size of the corpus.
* On that histogram: enumerate shallow combinations (two lengths, or three) that fill a
  window exactly, solve for the repeat counts that fit the histogram best without being
  negative, round them down to what the histogram still has, and let the greedy pass place the
  rest: longest first, end to end, a document cut where its window ends. The last window is cut into
  sequences whose lengths are powers of two, which need no padding.
* A row finds its place from its number among the rows of its length: tasks number
  their own rows as they encode, and running sums over (length, task) add the start. The plan has at most
  two or three entries per combination and is joined by length. No group of rows is gathered.

Results on odd input: a NULL text counts as empty, an empty text is the closing id alone;
repeated rows, ids and NULL ids are packed like any other row (a row is known by its place, not by its id);
very long texts are cut into windows; no documents give no pieces; further columns are not read. A task
holds the ids of about 4 MB of text, or of one longer text, at a time.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from musterbook.llm.common import pieces, store

WINDOW = 2048
CLOSING = 1
# Combinations of three lengths that are tried for each length.
TRIPLES = 12
STEPS = 400
# Fixed value: how byte-level encodings of this kind split a text into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Encoding


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: visible ones for themselves, the others from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def merge_ranks(told: dict) -> dict[bytes, int] | None:
    """Rank of every token of a tokenizer file, if it is a plain byte-level one whose ids follow its merges; else None."""
    model, split = told["model"], told["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    rare = [model.get(k) for k in ("unk_token", "dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
    if told["normalizer"] or not plain or model["type"] != "BPE" or any(rare):
        return None
    letters, vocabulary = byte_of_letter(), model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocabulary.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    added = {t["content"] for t in told["added_tokens"]}
    return {bytes(letters[c] for c in token): k for token, k in vocabulary.items() if token not in added}


class Encoder:
    """Ids as the tokenizer file gives them, without special tokens around the text.

    Where the file is a plain byte-level encoding, its vocabulary goes through the faster of the two public
    encoders; texts that hold an added token, or white space too long for that one, and all texts of other
    files go through ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.whole = Tokenizer.from_file(path)
        self.added = [t["content"] for t in told["added_tokens"]]
        self.fast = None
        if ranks := merge_ranks(told):
            import tiktoken

            self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and not any(a in text for a in self.added):
            try:
                return self.fast.encode_to_numpy(text)
            except ValueError:  # white space beyond the reach of its pattern
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str, closing: int, window: int):
    """Rows (doc_id, ids, n, rest, part, place, whole) of a task; ``place`` numbers its rows of one
    ``rest``, ``whole`` counts the full windows before the row."""

    def encode(batches):
        ids_of = Encoder(path)
        end = np.array([closing], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen, windows = np.zeros(window, np.int64), 0
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 22):
                ids = [ids_of(t.as_py() or "").astype("<u4").tobytes() + end for t in piece.column("text")]
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                rest, full = n % window, n // window
                order = np.argsort(rest, kind="stable")
                ordered = rest[order]
                place = np.empty(len(n), np.int64)
                place[order] = np.arange(len(n)) - np.searchsorted(ordered, ordered) + seen[ordered]
                seen += np.bincount(rest, minlength=window)
                whole = windows + np.cumsum(full) - full
                windows += int(full.sum())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(ids, pa.binary()), *map(pa.array, (n, rest, np.full(len(n), part, np.int64), place, whole))],
                    names=["doc_id", "ids", "n", "rest", "part", "place", "whole"],
                )

    return encode


def encoded(docs: DataFrame, path: str | None = None, closing: int = CLOSING, window: int = WINDOW) -> DataFrame:
    """Every document with its ids, written once; places follow the order in which tasks read their rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids binary, n long, rest long, part long, place long, whole long"
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return store(read.mapInArrow(encoder(path or byte_bpe_path(), closing, window), schema), "tokens")


# The plan


def combinations(histogram: np.ndarray, window: int, triples: int = TRIPLES) -> np.ndarray:
    """Rows of three lengths that fill the window, 0 where two do; every length occurs in the histogram.

    Of the triples only the ``triples`` best supported ones of each shortest length are taken.
    """
    held = np.flatnonzero(histogram[:window])
    held = held[held > 0]
    pairs = held[(2 * held <= window) & (histogram[np.clip(window - held, 0, window - 1)] > 0) & (held < window)]
    rows = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], 1)]
    for a in held[3 * held <= window]:
        b = held[(held >= a) & (2 * held <= window - a)]
        support = np.minimum(histogram[b], histogram[window - a - b])
        best = np.argsort(-support, kind="stable")[:triples]
        best = best[support[best] > 0]
        rows.append(np.stack([np.full(len(best), a), b[best], window - a - b[best]], 1))
    return np.concatenate(rows).astype(np.int64)


def non_negative_least_squares(rows: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 with the least sum of squared differences between use and histogram.

    Accelerated projected gradient; the step follows from the largest row and column sums. Index 0
    stands for no length and is never counted.
    """
    size = len(histogram)
    real = rows > 0

    def use(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(rows[:, j], x * real[:, j], size) for j in range(3))

    bound = use(np.ones(len(rows))).max(initial=1.0) * 3
    x = np.zeros(len(rows))
    y, t = x, 1.0
    goal = histogram.astype(float)
    for _ in range(steps if len(rows) else 0):
        off = use(y) - goal
        off[0] = 0
        new = np.maximum(y - (off[rows] * real).sum(1) / bound, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


@dataclass
class Plan:
    """``entries`` (length, first, until, sequence, offset): rows ``first`` to ``until`` of a length take that
    offset in one sequence each, from ``sequence`` on. ``rest`` (length, first, start): rows from ``first`` on lie end to end from
    token ``start`` of the rest. ``joints``: inner ends of the last sequences, counted in tokens of the rest."""

    entries: list[tuple[int, int, int, int, int]]
    rest: list[tuple[int, int, int]]
    rest_sequence: int
    joints: list[int]
    whole_windows: int
    repeats: int


def plan_windows(histogram: np.ndarray, whole_windows: int, window: int = WINDOW) -> Plan:
    """Sequences of all remainders; ``histogram[k]`` documents have k ids left beyond their whole windows."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    rows = combinations(left, window)
    solved = non_negative_least_squares(rows, left)
    taken = np.zeros(len(left), np.int64)
    entries, sequence = [], whole_windows
    for index in np.lexsort((np.arange(len(rows)), -solved)):
        lengths, uses = np.unique(rows[index][rows[index] > 0], return_counts=True)
        repeats = int(min(np.floor(solved[index] + 0.5), (left[lengths] // uses).min()))
        if repeats <= 0:
            continue
        offset = 0
        for length in rows[index][rows[index] > 0].tolist():
            entries.append((length, int(taken[length]), int(taken[length]) + repeats, sequence, offset))
            taken[length] += repeats
            offset += length
        left[lengths] -= uses * repeats
        sequence += repeats
    rest, start = [], 0
    for length in range(len(left) - 1, 0, -1):
        if left[length]:
            rest.append((length, int(taken[length]), start))
            start += length * int(left[length])
    joints, at, over = [], start - start % window, start % window
    for bit in reversed(range(window.bit_length())):
        if over >> bit & 1:
            at += 1 << bit
            joints.append(at)
    return Plan(entries, rest, sequence, joints[:-1], whole_windows, sequence - whole_windows)


def plan_table(spark: SparkSession, plan: Plan) -> DataFrame:
    """One row per length: its entries in order, and where its rest begins."""
    entries: dict[int, list] = {}
    for length, first, until, sequence, offset in plan.entries:
        entries.setdefault(length, []).append((first, until, sequence, offset))
    rest = {length: (first, start) for length, first, start in plan.rest}
    rows = [
        (length, sorted(entries.get(length, [])), *rest.get(length, (None, None)))
        for length in sorted(entries.keys() | rest.keys())
    ]
    schema = (
        "rest long, entries array<struct<first: long, until: long, sequence: long, offset: long>>, rest_first long, rest_start long"
    )
    return spark.createDataFrame(rows, schema)


# Pieces


def rest_sequence(position: Column, plan: Plan, window: int) -> Column:
    """Sequence of a token of the rest: its window, and behind the first joint one more for each joint."""
    last = [F.when(position >= joint, 1).otherwise(0) for joint in plan.joints]
    return F.lit(plan.rest_sequence) + F.floor(position / F.lit(window)).cast("long") + sum(last, F.lit(0)).cast("long")


def rest_begin(position: Column, plan: Plan, window: int) -> Column:
    """First token of the sequence that a token of the rest lies in."""
    begin = position - F.pmod(position, F.lit(window))
    behind = [F.when(position >= joint, F.lit(joint).cast("long")) for joint in plan.joints]
    return F.greatest(begin, *behind) if behind else begin


def pack_documents(
    docs: DataFrame, path: str | None = None, closing: int = CLOSING, window: int = WINDOW
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): every piece of every document.

    ``ids`` holds the piece's ids as little-endian 32-bit numbers. All sequences have ``window`` ids but for the
    last ones, whose lengths are falling powers of two.
    """
    spark = docs.sparkSession
    tokens = encoded(docs, path, closing, window)
    by_task = store(
        tokens.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.floor(F.col("n") / window)).cast("long").alias("windows")),
        "lengths",
    )
    # At most ``window`` rows, whatever the input.
    counted = by_task.groupBy("rest").agg(F.sum("rows").alias("rows"), F.sum("windows").alias("windows")).collect()
    histogram = np.zeros(window, np.int64)
    for row in counted:
        histogram[row["rest"]] = row["rows"]
    plan = plan_windows(histogram, sum(r["windows"] for r in counted), window)

    before = Window.partitionBy("rest").orderBy("part")
    starts = by_task.select("part", "rest", (F.sum("rows").over(before) - F.col("rows")).alias("rows_before"))
    of_task = by_task.groupBy("part").agg(F.sum("windows").alias("windows"))
    # A row per task of the encoding.
    earlier = of_task.select("part", (F.sum("windows").over(Window.orderBy("part")) - F.col("windows")).alias("windows_before"))
    placed = (
        tokens.join(starts.join(earlier, "part"), ["part", "rest"])
        .join(F.broadcast(plan_table(spark, plan)), "rest", "left")
        .withColumn("number", F.col("rows_before") + F.col("place"))
    )
    found = F.get(F.filter("entries", lambda e: (e["first"] <= F.col("number")) & (F.col("number") < e["until"])), F.lit(0))
    full = (F.col("n") - F.col("rest")).cast("long")
    position = F.col("rest_start") + (F.col("number") - F.col("rest_first")) * F.col("rest")
    end = F.col("position") + F.col("rest")

    def piece(start: Column, length: Column, sequence: Column, offset: Column) -> Column:
        named = zip(("start", "length", "sequence_id", "offset"), (start, length, sequence, offset))
        return F.struct(*[value.cast("long").alias(name) for name, value in named])

    zero = F.lit(0)
    count = F.floor(F.col("full") / window).cast("long")
    numbers = F.filter(F.sequence(zero.cast("long"), count), lambda k: k < count)
    windows = F.transform(
        numbers, lambda k: piece(k * window, F.lit(window), F.col("windows_before") + F.col("whole") + k, zero)
    )
    sequence = F.col("entry")["sequence"] + F.col("number") - F.col("entry")["first"]
    whole = F.array(piece(F.col("full"), F.col("rest"), sequence, F.col("entry")["offset"]))
    marks = [F.col("position") - F.pmod(F.col("position"), F.lit(window)) + window, *[F.lit(j).cast("long") for j in plan.joints]]
    inner = F.filter(F.array(*marks), lambda m: (m > F.col("position")) & (m < end))
    bounds = F.array_sort(F.array_distinct(F.concat(F.array("position", end), inner)))
    cut = F.transform(
        F.arrays_zip(F.slice("bounds", 1, F.size("bounds") - 1).alias("a"), F.slice("bounds", 2, F.size("bounds") - 1).alias("b")),
        lambda x: piece(
            F.col("full") + x["a"] - F.col("position"),
            x["b"] - x["a"],
            rest_sequence(x["a"], plan, window),
            x["a"] - rest_begin(x["a"], plan, window),
        ),
    )
    none = F.array().cast("array<struct<start: long, length: long, sequence_id: long, offset: long>>")
    last = F.when(F.col("rest") == 0, none).when(F.col("entry").isNotNull(), whole).otherwise(cut)
    rows = (
        placed.withColumn("entry", found)
        .withColumns({"full": full, "position": F.when(F.col("entry").isNull() & (F.col("rest") > 0), position)})
        .withColumn("bounds", F.when(F.col("position").isNotNull(), bounds))
        .select("doc_id", "ids", F.col("n").alias("doc_tokens"), F.inline(F.concat(windows, last)))
    )
    own = F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return rows.select("doc_id", "start", "length", own.alias("ids"), "doc_tokens", "sequence_id", "offset")
