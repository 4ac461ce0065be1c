"""Divergence of sources within a language, by ranking cells of equal counts.

Terms that a source holds ``n`` times and its language ``c`` times all have the same
value, so terms are grouped into cells ``(n, c)`` first. Values are computed once per
cell, cells of one value are merged and ranked by the cumulative number of their terms,
and only the cells above the cut are expanded to terms again, in UTF-8 order.

* Documents become counts inside their tasks (Arrow batches); from there on everything is
  an aggregate, a join or a window over the counts. A hot source or word arrives as
  one row per batch and is added up before the first exchange.
* Sources are compared over all kept terms, also those that only one of them or none has.
  Shared terms come from a join of the counts on (lang, term), and are reduced to cells
  right behind it; the others follow from each source's histogram of counts by
  signed multiplicities: a shared cell ``(a, b)`` takes its terms out of ``(a, 0)`` and
  ``(0, b)``, and the rest of the vocabulary lies in ``(0, 0)``.
* The cut needs the 200 highest values of a source and, among the terms of one value, the
  first 200: both are rank limits that tasks apply before they exchange.

Results on odd input: NULL text, language or source read as the empty text; a text without
letters has no terms but its source is still reported; repeated rows count as documents
of their own; without kept terms all values of a pair are 0 and there are no term rows;
no documents give no rows. Further columns are not read. Texts are taken whole; a task holds
the words of about 8 MB of text, or of one longer text, at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterbook.llm.common import pieces, store, text_buffer

LEAST_DOCUMENTS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
COUNTS = "lang string, source string, term string, n long, d long"
EACH = ["lang", "source"]


def letters() -> np.ndarray:
    """Byte table: A-Z lower-cased, other ASCII than letters a space, the rest as it is."""
    byte = np.arange(256)
    small = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    return np.where((small < 128) & ~((small >= 97) & (small <= 122)), 32, small).astype(np.uint8)


def count_terms(batches):
    """Per batch and (lang, source): occurrences and documents of every term."""
    table = letters()
    for whole in batches:
        for batch in pieces(whole, "text", 1 << 23, 1 << 16):
            data, offsets = text_buffer(batch.column("text"))
            plain = pa.py_buffer(table[data])
            texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), plain)
            lists = pc.ascii_split_whitespace(texts)
            words = lists.flatten()
            document = pc.list_parent_indices(lists).to_numpy()
            kept = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
            coded = words.filter(pa.array(kept)).dictionary_encode()
            if not len(coded):
                continue
            term, document = coded.indices.to_numpy().astype(np.int64), document[kept].astype(np.int64)
            group = pa.StructArray.from_arrays(
                [batch.column(c).cast(pa.large_string()) for c in EACH], names=EACH
            )
            names, group_of = distinct_rows(group)
            many = len(coded.dictionary)
            pair, n = np.unique(group_of[document] * many + term, return_counts=True)
            once = np.unique(document * many + term)
            _, d = np.unique(group_of[once // many] * many + once % many, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    *(names.field(i).take(pa.array(pair // many)).cast(pa.string()) for i in (0, 1)),
                    coded.dictionary.take(pa.array(pair % many)).cast(pa.string()),
                    pa.array(n.astype(np.int64)),
                    pa.array(d.astype(np.int64)),
                ],
                names=[*EACH, "term", "n", "d"],
            )


def distinct_rows(group: pa.StructArray) -> tuple[pa.StructArray, np.ndarray]:
    """Distinct (lang, source) of a batch, and for each row which one it has."""
    codes = [group.field(i).dictionary_encode() for i in (0, 1)]
    width = max(1, len(codes[1].dictionary))
    number = codes[0].indices.to_numpy().astype(np.int64) * width + codes[1].indices.to_numpy()
    _, first, back = np.unique(number, return_index=True, return_inverse=True)
    return group.take(pa.array(first)), back.reshape(-1).astype(np.int64)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of each term of a source."""
    empty = F.lit("")
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("text", *EACH)])
    return read.mapInArrow(count_terms, COUNTS).groupBy(*EACH, "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The counts of terms that enough documents of the language hold, with the language's count ``c``.

    ``first`` marks one row of each (lang, term). A window group has a row per source.
    """
    of_term = Window.partitionBy("lang", "term")
    marked = term_counts(docs).select(
        "*",
        F.sum("n").over(of_term).alias("c"),
        F.sum("d").over(of_term).alias("documents"),
        (F.row_number().over(of_term.orderBy("source")) == 1).alias("first"),
    )
    return marked.where(F.col("documents") >= least).drop("d", "documents")


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every occurring (lang, source) with its words ``total``, its terms ``held``, and its language's ``all_total`` and ``v``."""
    found = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in EACH]).distinct()
    own = kept.groupBy(*EACH).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"), F.count_if("first").alias("new"))
    whole = own.groupBy("lang").agg(F.sum("total").alias("all_total"), F.sum("new").alias("v"))
    joined = found.join(own.drop("new"), EACH, "left").join(whole, "lang", "left")
    return joined.na.fill(0, ["total", "held", "all_total", "v"])


def share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + v)), exact: the product is taken as a decimal."""
    product = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    whole = (total + v).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", product, F.nullif(whole, F.lit(0)))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q). Shares are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_part(kept: DataFrame, sizes: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """The first ``top`` terms of each source by value; cells first, terms of the cells above the cut last."""
    cells = kept.groupBy(*EACH, "n", "c").agg(F.count(F.lit(1)).alias("terms")).join(sizes, EACH)
    shares = cells.select(
        *EACH, "n", "c", "terms",
        share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        share(F.col("c"), F.col("all_total"), F.col("v")).alias("q"),
    )
    valued = shares.where("p > q").select(*EACH, "n", "c", "terms", divergence(F.col("p"), F.col("q")).alias("value"))
    merged = valued.groupBy(*EACH, "value").agg(F.sum("terms").alias("terms"))
    by_value = Window.partitionBy(*EACH).orderBy(F.desc("value"))
    # A value has at least one term, so the cut lies among the ``top`` highest values.
    highest = merged.withColumn("place", F.row_number().over(by_value)).where(F.col("place") <= top)
    above = highest.select(*EACH, "value", (F.sum("terms").over(by_value) - F.col("terms")).alias("before"))
    shown = valued.join(above.where(F.col("before") < top), [*EACH, "value"]).select(*EACH, "n", "c", "value", "before")
    terms = kept.join(shown, [*EACH, "n", "c"])
    in_order = Window.partitionBy(*EACH, "value").orderBy("term")
    ranked = terms.withColumn("place", F.row_number().over(in_order)).where(F.col("place") <= top)
    ranked = ranked.withColumn("rank", (F.col("before") + F.col("place")).cast("int")).where(F.col("rank") <= top)
    return ranked.select(*EACH, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def pair_cells(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, terms) with a < b: how many kept terms a holds x times and b y times.

    Signed rows of one cell add up to its number of terms.
    """
    counts = kept.select("lang", "term", "source", "n")
    left = counts.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("x"))
    right = counts.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("y"))
    key = ["lang", "a", "b"]
    shared = left.join(right, ["lang", "term"]).where("a < b").groupBy(*key, "x", "y").agg(F.count(F.lit(1)).alias("terms"))
    zero = F.lit(0).cast("long")
    signed = F.array(
        F.struct("x", "y", "terms"),
        F.struct("x", zero.alias("y"), (-F.col("terms")).alias("terms")),
        F.struct(zero.alias("x"), "y", (-F.col("terms")).alias("terms")),
        F.struct(zero.alias("x"), zero.alias("y"), F.col("terms").alias("terms")),
    )
    both = shared.select(*key, F.inline(signed))
    first = sizes.select("lang", F.col("source").alias("a"), F.col("held").alias("held_a"), "v")
    second = sizes.select("lang", F.col("source").alias("b"), F.col("held").alias("held_b"))
    pairs = first.join(second, "lang").where("a < b")
    rest = pairs.select(*key, zero.alias("x"), zero.alias("y"), (F.col("v") - F.col("held_a") - F.col("held_b")).alias("terms"))
    histogram = counts.groupBy(*EACH, "n").agg(F.count(F.lit(1)).alias("terms"))
    one = histogram.select("lang", F.col("source").alias("a"), F.col("n").alias("x"), zero.alias("y"), "terms")
    other = histogram.select("lang", F.col("source").alias("b"), zero.alias("x"), F.col("n").alias("y"), "terms")
    ends = pairs.select(*key)
    alone = ends.join(one, ["lang", "a"]).select(*key, "x", "y", "terms")
    alone = alone.unionByName(ends.join(other, ["lang", "b"]).select(*key, "x", "y", "terms"))
    rows = both.unionByName(rest).unionByName(alone)
    return rows.groupBy(*key, "x", "y").agg(F.sum("terms").alias("terms")).where("terms != 0")


def pair_part(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each source every other source of its language, by the summed value of all kept terms."""

    def side(name: str) -> DataFrame:
        return sizes.select("lang", F.col("source").alias(name), F.col("total").alias(f"total_{name}"))

    v = sizes.groupBy("lang").agg(F.max("v").alias("v"))
    cells = pair_cells(kept, sizes).join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"]).join(v, "lang")
    shares = cells.select(
        "lang", "a", "b", "terms",
        share(F.col("x"), F.col("total_a"), F.col("v")).alias("p"),
        share(F.col("y"), F.col("total_b"), F.col("v")).alias("q"),
    )
    summed = shares.groupBy("lang", "a", "b").agg(
        F.sum(F.col("terms") * divergence(F.col("p"), F.col("q"))).alias("ab"),
        F.sum(F.col("terms") * divergence(F.col("q"), F.col("p"))).alias("ba"),
    )
    both = summed.select(
        "lang",
        F.inline(
            F.array(
                F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")),
                F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value")),
            )
        ),
    )
    # Pairs without a single kept term in their language have no cell.
    names = sizes.select(*EACH)
    every = names.join(names.withColumnRenamed("source", "item"), "lang").where("source != item")
    valued = every.join(both, [*EACH, "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    by_value = Window.partitionBy(*EACH).orderBy(F.desc("value"), "item")
    return valued.select(*EACH, F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` and ``term`` rows of every source of every language."""
    kept = store(kept_terms(docs, least), "terms")
    sizes = store(group_sizes(docs, kept), "sources")
    return pair_part(kept, sizes).unionByName(term_part(kept, sizes, top))
