"""Mixing sources to target weights by drawing fixed-length blocks.

The documents of a source, in a fixed pseudorandom order, form one stream of words that is
cut into blocks of ``BLOCK`` words. Every output shard draws how many blocks it takes of
each source; over all shards the counts of a source are one multinomial draw whose total
is the number of blocks nearest to the source's target. A shard's share of a source is
a range of slots; a slot is mapped to a block by a pseudorandom permutation of the source's
block numbers (a new one each time all blocks have been used). Documents are cut into pieces at the
block borders, the pieces of a block are put together, and blocks meet the draws by block
number: ``mixed_blocks`` has the words of every shard and slot, and what is taken of a
document is counted on the words of these rows.

Nothing goes to the driver and no source is one group: offsets within a source are sums over
1024 hashed groups first and running sums inside a group then. Only the per-source table
(one row per source) passes through a single task.

Defined results: a NULL text has size 0; size 0 takes 0; a NULL source is a source of its own,
last in order; repeated rows are separate documents; an empty table gives an empty result. The
draw depends on the rows alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterbook.llm.common import SPACE

BLOCK = 128
SHARD_BLOCKS = 4096
GROUPS = 1024
ROUNDS = 20
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
SEED = 20240117
CHUNK = 4096


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("+"), source), F.lit("-"))


def _bucket() -> Column:
    """Group of a document. Never NULL, and said so: a join on it would else filter by the counted words a second time."""
    return F.coalesce(F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "size"), F.lit(GROUPS)), F.lit(0).cast("long"))


def _counted(docs: DataFrame) -> DataFrame:
    """``words`` with one space between two of them (empty for NULL), and their number ``size``.

    Columns are made one after the other, so each is computed once.
    """
    plain = F.coalesce(F.btrim("words", F.lit(SPACE)), F.lit(""))
    for white in SPACE[1:]:
        plain = F.replace(plain, F.lit(white), F.lit(" "))
    words = F.col("words")
    # Most texts have no run of white space, and a search for a fixed string is far cheaper than a pattern.
    single = F.when(F.contains(words, F.lit("  ")), F.regexp_replace(words, " {2,}", " ")).otherwise(words)
    gaps = F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit("")))
    size = F.when(words == "", 0).otherwise(gaps + 1).cast("long")
    return docs.withColumn("words", plain).withColumn("words", single).withColumn("size", size)


def document_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: ``doc_id``, its size in words, the key of its source and its group there."""
    texts = docs.select(
        F.col(doc_id).alias("doc_id"), _source_key(F.col(source).cast("string")).alias("source_key"), F.col(text).alias("words")
    )
    return _counted(texts).select(
        "doc_id", "size", "source_key", _bucket().alias("bucket")
    )


def targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, block: int = BLOCK
) -> DataFrame:
    """Per source: size, target, number of blocks and number of slots. ``sizes`` has ``source_key`` and ``size``, of documents or sums.

    Sources by code point share ``share`` times all sizes by weight, each at most ``most`` times its
    size. Filling by weight stops at the caps in order of cap / weight, so the level is found
    by running sums: the sources before it are at their caps, the others at level times weight.
    """
    every = Window.partitionBy(F.lit(0))
    per_source = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    # "-" (NULL) goes behind every "+..." here.
    in_order = every.orderBy((F.col("source_key") == "-").asc(), "source_key")
    weighed = per_source.withColumn("number", F.row_number().over(in_order)).withColumn(
        "weight",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") - 1) % len(weights) + 1),
    )
    filling = every.orderBy(F.col("source_size") / F.col("weight"), "number")
    cap = most * F.col("source_size")
    levels = (
        weighed.withColumn("pool", share * F.sum("source_size").over(every))
        .withColumn("full", F.coalesce(F.sum(cap).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("pool") - F.col("full")) / F.col("open"))
        .withColumn("place", F.row_number().over(filling))
        # The first source that does not fill fixes the level.
        .withColumn("at", F.min(F.when(cap > F.col("level") * F.col("weight"), F.struct("place", "level"))).over(every))
    )
    target = F.when(F.col("at").isNull() | (F.col("place") < F.col("at.place")), cap).otherwise(
        F.col("at.level") * F.col("weight")
    )
    blocks = F.ceil(F.col("source_size") / block)
    return levels.select("source_key", "source_size", target.cast("double").alias("target")).select(
        "*",
        blocks.alias("blocks"),
        # The last block is shorter, so slots are counted in blocks of the mean length.
        F.when(F.col("source_size") == 0, F.lit(0).cast("long"))
        .otherwise(F.floor(F.col("target") * blocks / F.col("source_size") + 0.5))
        .alias("slots"),
    )


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shard_counts(sources: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """Blocks that each shard draws of each source, and the first of its slots there."""
    every = Window.partitionBy(F.lit(0))
    shards = F.greatest(F.ceil(F.sum("slots").over(every) / shard_blocks), F.lit(1))
    chunks = (
        sources.withColumn("shards", shards)
        .where("slots > 0")
        .select("source_key", "blocks", "slots", "shards", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK})")).alias("chunk"))
        # Chunks are short rows and long work: an explicit number of partitions is not coalesced.
        .repartition(_partitions(sources), "source_key", "chunk")
    )
    draws = chunks.select(
        "source_key",
        "blocks",
        "shards",
        F.explode(F.expr(f"sequence(chunk * {CHUNK}, least((chunk + 1) * {CHUNK}, slots) - 1)")).alias("draw"),
    ).select("source_key", "blocks", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "source_key", "draw"), "shards").alias("shard"))
    counts = draws.groupBy("source_key", "blocks", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first_slot", F.coalesce(F.sum("n").over(before), F.lit(0)))


def pivots(size: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """The pivots of the rounds of a permutation of 0 .. size - 1: one list for all that it permutes."""
    return F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.pmod(F.xxhash64(F.lit("pivot"), *key, r), size))


def permuted(index: Column, size: Column, *key: Column, rounds: int = ROUNDS, known: Column | None = None) -> Column:
    """Image of ``index`` under a keyed permutation of 0 .. size - 1 (swap-or-not rounds).

    Each round pairs x with k - x and swaps the pair or not by a hashed bit of its larger member.
    ``known`` are the ``pivots`` of this size and key, where a row has them.
    """

    def step(x, r):
        k = F.pmod(F.xxhash64(F.lit("pivot"), *key, r), size) if known is None else F.get(known, r - 1)
        pair = F.pmod(k - x, size)
        bit = F.xxhash64(F.lit("bit"), *key, r, F.greatest(x, pair)).bitwiseAND(F.lit(1).cast("long"))
        return F.when(bit == 1, pair).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, step)


def drawn_blocks(counts: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per slot: shard, source, slot, and the block it takes."""
    last = "first_slot + n - 1"
    chunks = counts.select(
        "shard", "source_key", "blocks", "first_slot", "n", F.explode(F.expr(f"sequence(first_slot div {CHUNK}, ({last}) div {CHUNK})")).alias("chunk")
    ).repartition(_partitions(counts), "source_key", "chunk", "shard")
    # Slots of one turn share their permutation, so its pivots are computed before the slots are listed.
    first, final = f"greatest(first_slot, chunk * {CHUNK})", f"least({last}, (chunk + 1) * {CHUNK} - 1)"
    turns = chunks.select(
        "shard", "source_key", "blocks", F.expr(first).alias("low"), F.expr(final).alias("high"),
        F.explode(F.expr(f"sequence({first} div blocks, {final} div blocks)")).alias("turn"),
    )
    key = (F.lit(seed), F.col("source_key"), F.col("turn"))
    listed = "sequence(greatest(low, turn * blocks), least(high, (turn + 1) * blocks - 1))"
    slots = turns.select("*", pivots(F.col("blocks"), *key).alias("known")).select(
        "shard", "source_key", "blocks", "turn", "known", F.explode(F.expr(listed)).alias("slot")
    )
    block = permuted(F.expr("slot % blocks"), F.col("blocks"), *key, known=F.col("known"))
    # Never NULL, and said so: a join on it would else filter by the whole permutation a second time.
    return slots.select("shard", "source_key", "slot", F.coalesce(block, F.lit(-1).cast("long")).alias("block"))


def _source(source_key: Column) -> Column:
    return F.when(source_key != "-", F.substring(source_key, 2, 2**31 - 1))


def _dealt(
    docs: DataFrame, doc_id: str, text: str, source: str, weights: tuple[float, ...], share: float, block: int, seed: int
) -> tuple[DataFrame, DataFrame]:
    """The blocks with their pieces, a row for every slot that takes them (or one without a slot); and the table of sources.

    A piece has its document's start in the source, ``doc_id``, ``size`` and number (for size 0), its
    place in the block's order and its ``words``, joined by spaces.
    """
    texts = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(text)).alias("text_hash"),
        F.col(text).alias("words"),
        _source_key(F.col(source).cast("string")).alias("source_key"),
    )
    sizes = document_sizes(docs, doc_id, text, source)
    totals = sizes.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("source_key", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_key", "bucket").orderBy(
        F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "size", "text_hash"
    )
    counted = _counted(texts).withColumn("bucket", _bucket())
    placed = (
        counted.withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
        .withColumn("number", F.when(F.col("size") == 0, F.row_number().over(inside)))
        .join(bases, ["source_key", "bucket"])
        .withColumn("start", F.col("base") + F.col("before"))
    )

    def cut(words):
        def piece(b):
            first = F.greatest(F.col("start"), b * block) - F.col("start")
            last = F.least(F.col("start") + F.col("size"), (b + 1) * block) - F.col("start")
            part = F.slice(words, (first + 1).cast("int"), (last - first).cast("int"))
            return F.struct(b.alias("block"), F.array_join(part, " ").alias("words"))

        return F.transform(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})"), piece)

    # Documents of size 0 have no place in a block: each is a block of its own below 0.
    alone = F.struct((-1 - F.col("number") * GROUPS - F.col("bucket")).cast("long").alias("block"), F.lit("").alias("words"))
    pieces = placed.select(
        "source_key",
        "start",
        "doc_id",
        "size",
        "number",
        F.explode(F.when(F.col("size") > 0, F.get(F.transform(F.array(F.split("words", " ")), cut), 0)).otherwise(F.array(alone))).alias("part"),
    ).select("source_key", "start", "doc_id", "size", "number", "part.block", "part.words")
    blocks = (
        pieces.repartition("source_key", "block")
        .groupBy("source_key", "block")
        # A block has at most as many pieces as words.
        .agg(F.collect_list(F.struct("start", "doc_id", "size", "number", "words")).alias("pieces"))
    )
    # From the sums that the offsets need, too: the texts are counted once for both.
    sources = targets(totals.select("source_key", F.col("words").alias("size")), weights, share, block=block)
    drawn = drawn_blocks(shard_counts(sources, seed=seed), seed).select("source_key", "block", "shard", "slot")
    # Drawn blocks grow with the words: never broadcast.
    return blocks.join(drawn.hint("merge"), ["source_key", "block"], "left"), sources


def mixed_blocks(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """The mix: ``shard``, ``source``, ``slot`` (numbered per source), ``block`` and its ``words`` in order, joined by spaces."""
    dealt, _ = _dealt(docs, doc_id, text, source, weights, share, block, seed)
    words = F.array_join(F.transform(F.array_sort(F.transform("pieces", lambda p: F.struct(p["start"], p["words"]))), lambda p: p["words"]), " ")
    return dealt.where("slot is not null").select("shard", _source(F.col("source_key")).alias("source"), "slot", "block", words.alias("words"))


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    block: int = BLOCK,
    seed: int = SEED,
    with_parts: bool = False,
) -> DataFrame:
    """Per document: ``doc_id``, ``size``, ``source_size``, ``target`` and the words ``taken``, counted on the mixed pieces.

    ``with_parts`` adds ``source`` and ``parts``: the shard, slot and words of every piece that the mix takes.
    """
    dealt, sources = _dealt(docs, doc_id, text, source, weights, share, block, seed)
    pieces = dealt.select("source_key", "block", "shard", "slot", F.explode("pieces").alias("p")).select(
        "source_key", "block", "shard", "slot", "p.*"
    )
    n_words = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
    taken = [F.sum(F.when(F.col("slot").isNotNull(), n_words).otherwise(0)).cast("long").alias("taken")]
    added = []
    if with_parts:
        part = F.when(F.col("slot").isNotNull() & (F.col("size") > 0), F.struct("slot", "block", "shard", "words"))
        taken.append(F.sort_array(F.collect_list(part)).alias("parts"))
        added = [_source(F.col("source_key")).alias("source"), "parts"]
    # Documents of size 0 all stand before a block's first word; their number and block keep them apart.
    alone = F.when(F.col("size") == 0, F.col("block")).alias("alone")
    per_doc = pieces.groupBy("source_key", "start", "doc_id", "size", "number", alone).agg(*taken)
    return per_doc.join(sources.select("source_key", "source_size", "target"), "source_key").select(
        "doc_id", "size", "source_size", "target", "taken", *added
    )
