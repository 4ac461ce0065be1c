"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Lower-cased code points, framed by spaces, give n-grams of two lengths, hashed into ``BUCKETS``
columns. Every task counts its texts into one dense vector per language; the vectors are
summed by Spark and written. The smoothed log-probability matrix (languages by buckets) is broadcast in blocks of
``BLOCK`` languages, a bounded size each. Texts are scored in batches: the matrix rows of a batch's n-grams
are gathered and summed per text; with more than one block, the best language and the sum of all
likelihoods pass from block to block.

Defined results: ``und`` with score 0 for a NULL text, one without a letter, or a model
without training rows; rows without a language are not learned from; ties go to the least
language by code point; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterbook.llm.common import fresh, id_remainder, mix, pieces, store

LENGTHS = (2, 4)
BUCKETS = 1 << 15
SMOOTHING = 0.1
BLOCK = 512
CHUNK = 1 << 12
_U = np.uint64


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a batch of texts, and the bounds of each text (one more than texts)."""
    framed = [f"   {t.lower()}   " if t else "" for t in texts.to_pylist()]
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in framed], np.int64)
    ends = np.cumsum(sizes)
    parts = np.repeat(np.arange(len(framed)), sizes)
    found, owner = [], []
    for n in LENGTHS:
        if len(points) < n:
            continue
        h = np.zeros(len(points) - n + 1, np.uint64)
        for k in range(n):
            h = (h * _U(0x100000001B3)) ^ points[k : k + len(h)]
        whole = parts[n - 1 :] == parts[: len(h)]
        found.append(mix(h[whole] + _U(n)) % _U(BUCKETS))
        owner.append(parts[: len(h)][whole])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(framed) + 1, np.int64)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(framed)))])
    return np.concatenate(found)[order].astype(np.int64), bounds


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def count_ngrams(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, bucket, n, texts): n-gram counts, and in bucket -1 the number of texts."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                grams, bounds = ngrams(piece.column("text"))
                names = np.array(piece.column("lang").to_pylist(), object)
                owner = np.repeat(np.arange(len(names)), np.diff(bounds))
                for name in set(names):
                    mine = names == name
                    new = np.bincount(grams[mine[owner]], minlength=BUCKETS)
                    counts[name] = counts[name] + new if name in counts else new
                    texts[name] = texts.get(name, 0) + int(mine.sum())
                    if len(counts) == BLOCK:
                        yield from rows(counts, texts)
                        counts, texts = {}, {}
        yield from rows(counts, texts)

    def rows(counts, texts):
        for name, vector in counts.items():
            used = np.flatnonzero(vector)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (len(used) + 1), pa.string()),
                    pa.array(np.append(used, -1).astype(np.int32)),
                    pa.array(np.append(vector[used], texts[name]).astype(np.int64)),
                ],
                ["lang", "bucket", "n"],
            )

    return (
        docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
        .mapInArrow(run, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", block: int = BLOCK) -> Iterator[tuple[list[str], np.ndarray]]:
    """Blocks of languages in order, and their log-probabilities (bucket by language); the last row is the prior."""
    counted = store(count_ngrams(docs.where(F.col(lang).isNotNull() & has_letter(F.col(text))), lang, text), "ngrams")
    texts = {r.lang: r.n for r in counted.where("bucket = -1").collect()}  # one row per language
    langs, total = sorted(texts), sum(texts.values())
    for first in range(0, len(langs), block):
        names = langs[first : first + block]
        # Code points order like UTF-8 bytes. At most ``block`` languages times buckets.
        table = counted.where(F.col("bucket") >= 0).where(F.col("lang").between(names[0], names[-1])).toArrow()
        place = {name: k for k, name in enumerate(names)}
        column = np.array([place[name] for name in table.column("lang").to_pylist()], np.int64)
        matrix = np.full((BUCKETS + 1, len(names)), SMOOTHING)
        matrix[table.column("bucket").to_numpy(), column] += table.column("n").to_numpy()
        matrix = np.log(matrix / matrix[:-1].sum(axis=0))
        matrix[-1] = np.log(np.array([texts[name] for name in names]) / total)
        yield names, matrix.astype(np.float32)


def predict(docs: DataFrame, model: Iterable[tuple[list[str], np.ndarray]], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (posterior probability); such columns give way."""
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    known, top, rest = (fresh(docs, c) for c in ("has_letter", "best_likelihood", "all_likelihoods"))
    kept = docs.select(*[F.col(f"`{c}`") for c in own])
    scored = kept.withColumns(
        {known: has_letter(F.col(f"`{text}`")), "lang_pred": F.lit("und"), top: F.lit(float("-inf")), rest: F.lit(0.0)}
    )
    for block in model:
        scored = scored.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(block), text, known, top, rest), scored.schema)
    # ``rest`` is the sum of all likelihoods over the best one.
    score = F.when(F.col(rest) > 0, 1 / F.col(rest)).otherwise(F.lit(0.0))
    return scored.select(*[F.col(f"`{c}`") for c in own], "lang_pred", score.alias("score"))


def _scorer(shared, text: str, known: str, top: str, rest: str):
    """A function over batches that compares one block of languages with the best so far."""

    def run(batches):
        langs, matrix = shared.value
        prior = matrix[-1].astype(np.float64)
        for batch in batches:
            for piece in pieces(batch, text, 1 << 20):
                lettered = piece.column(known).to_numpy(zero_copy_only=False).astype(bool)
                if not lettered.any():
                    yield piece
                    continue
                pred = np.array(piece.column("lang_pred").to_pylist(), object)
                most, total = (piece.column(c).to_numpy().copy() for c in (top, rest))
                grams, bounds = ngrams(piece.column(text))
                totals = np.tile(prior, (piece.num_rows, 1))
                filled = np.flatnonzero(np.diff(bounds))
                for k in range(len(langs)):
                    gathered = matrix[:, k][grams].astype(np.float64)
                    totals[filled, k] += np.add.reduceat(gathered, bounds[filled])
                totals = totals[lettered]
                best = totals.argmax(axis=1)
                here = totals[np.arange(len(totals)), best]
                before = most[lettered]
                above = np.maximum(here, before)
                pred[lettered] = np.where(here > before, np.array(langs, object)[best], pred[lettered])
                total[lettered] = total[lettered] * np.exp(before - above) + np.exp(totals - above[:, None]).sum(axis=1)
                most[lettered] = above
                new = {"lang_pred": pa.array(pred, pa.string()), top: pa.array(most), rest: pa.array(total)}
                names = piece.schema.names
                yield pa.RecordBatch.from_arrays([new.get(c, piece.column(c)) for c in names], names)

    return run


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``; learned on what is not held out."""
    held_out = id_remainder(F.col(doc_id), 5) == 0
    model = fit(docs.where(~held_out), lang, text)
    return predict(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model).select(
        "doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score"
    )
