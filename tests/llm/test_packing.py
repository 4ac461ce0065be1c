"""Packing: encoding in stretches, the solver, and the pieces put together again."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest_llm import FOLDER, LONG, ODD
from musterbook.llm import packing
from musterbook.llm.queries import op12_pack_windows

TOKENIZER = Tokenizer.from_file(packing.byte_bpe_path())


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


ENCODER = packing.Encoder(packing.byte_bpe_path())


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("ab'st1. \n\t\r\x0b\x0c\x1c\x85\u00a0\u2003é中😀_-"), max_size=24))
def test_ids_are_those_of_the_tokenizer(text):
    assert ENCODER(text).tolist() == ids_of(text)[:-1]


def test_ids_of_odd_texts():
    assert ENCODER.fast is not None
    runs = [" " * 2_000_000 + "x", "a" * 50_000, "." * 300_000 + " x", "\n" * 1_500_000]
    for text in ["", "  ", "<|endoftext|> a<|endoftext|>", "<|endoftext", "don't  we'll\n\n\nx", LONG, *runs]:
        assert ENCODER(text).tolist() == ids_of(text)[:-1]


def test_other_files_go_through_the_tokenizer():
    path = packing.byte_bpe_path().replace("byte_bpe_50k", "word_bpe_49k")
    encoder = packing.Encoder(path)
    assert encoder.fast is None
    own = Tokenizer.from_file(path).encode("Some words, 12", add_special_tokens=False).ids
    assert encoder("Some words, 12").tolist() == own


def test_solver_against_enumeration():
    """The residual of the solution is no worse than that of any whole-numbered one nearby."""
    histogram = np.zeros(16, np.int64)
    histogram[[2, 4, 5, 6, 10, 11, 12]] = [9, 30, 14, 10, 7, 14, 25]
    rows = packing.combinations(histogram, 16)
    assert {tuple(sorted(r)) for r in rows.tolist()} >= {(0, 4, 12), (0, 5, 11), (0, 6, 10), (2, 4, 10), (5, 5, 6)}
    x = packing.non_negative_least_squares(rows, histogram, 4000)
    matrix = np.zeros((16, len(rows)))
    for j, row in enumerate(rows):
        for length in row[row > 0]:
            matrix[length, j] += 1
    slope = matrix.T @ (matrix @ x - histogram)
    assert (x >= 0).all() and slope.min() > -0.05 and abs(slope @ x) < 0.5


def test_plan_uses_each_row_once():
    rng = np.random.default_rng(3)
    histogram = rng.integers(0, 40, 2048)
    histogram[7] = 100_000
    plan = packing.plan_windows(histogram, 5)
    for length in range(1, 2048):
        own = sorted((a, b) for k, a, b, _, _ in plan.entries if k == length)
        assert [a for a, _ in own] == [0, *(b for _, b in own[:-1])][: len(own)]
        covered = own[-1][1] if own else 0
        rest = [first for k, first, _ in plan.rest if k == length]
        assert rest == ([covered] if covered < histogram[length] else [])
    placed = sum(b - a for _, a, b, _, _ in plan.entries)
    assert placed > 0.8 * (histogram[1:].sum() - histogram[7])


def put_together(rows, expected, window):
    """Rows (doc_id, start, length, ids, doc_tokens, sequence_id, offset) against the ids of each text."""
    sequences, documents = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], ids))
        documents.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
    padding, short = 0, []
    for parts in sequences.values():
        at = 0
        for offset, ids in sorted(parts):
            assert offset == at
            at += len(ids)
        assert at <= window
        if at & (at - 1):
            padding += window - at
        elif at < window:
            short.append(at)
    assert padding == 0 and len(set(short)) == len(short)
    assert sorted(sequences) == list(range(len(sequences)))
    # Rows of one id may be several documents: their pieces follow each other from 0 to the end.
    left = {}
    for doc_id, texts in expected.items():
        left[doc_id] = sorted(texts)
    for doc_id, parts in documents.items():
        pool = sorted(left.pop(doc_id))
        total = sum(len(ids) for _, ids, _ in parts)
        assert total == sum(map(len, pool))
        if len(pool) == 1:
            joined = [i for _, ids, _ in sorted(parts) for i in ids]
            assert joined == pool[0] and {n for _, _, n in parts} == {len(pool[0])}
        else:
            assert sorted(i for _, ids, _ in parts for i in ids) == sorted(i for ids in pool for i in ids)
    assert not left


@pytest.mark.parametrize("window", [16, 64, 2048])
def test_odd_rows_round_trip(make_docs, window):
    rng = random.Random(window)
    rows = [*ODD, *[(100 + k, " ".join("word" for _ in range(rng.randrange(40)))) for k in range(120)]]
    expected = {}
    for doc_id, text in rows:
        expected.setdefault(doc_id, []).append(ids_of(text))
    put_together(packing.pack_documents(make_docs(rows), window=window).collect(), expected, window)


def test_one_document_and_none(make_docs):
    assert packing.pack_documents(make_docs([])).collect() == []
    put_together(packing.pack_documents(make_docs([(1, None)])).collect(), {1: [[1]]}, 2048)
    exact = "a " * 2047
    (row,) = packing.pack_documents(make_docs([(1, exact[:-1])])).where("length = 2048").collect() or [None]
    assert row is None or row["offset"] == 0


def test_query_on_the_documents(spark, real_docs):
    _, rows = real_docs
    texts = {r[0]: ids_of(r[1]) for r in rows}
    found = op12_pack_windows(spark, FOLDER).collect()
    for r in found:
        own = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and r["doc_tokens"] == len(texts[r["doc_id"]])
    assert sum(r["length"] for r in found) == sum(map(len, texts.values()))
    whole = packing.pack_documents(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    put_together(whole.collect(), {k: [v] for k, v in texts.items()}, 2048)
    # Few documents are cut beyond what their length asks for.
    pieces = len(found) - sum((len(v) - 1) // 2048 + 1 for v in texts.values())
    assert pieces < 0.2 * len(texts)
