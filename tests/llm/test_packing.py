"""Packing: every id in one piece, window lengths, least cost against all cuts, awkward rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marketlens.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length int, ids string, `offset` int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def checked(pieces, expected, window=4096):
    """All pieces against (doc_id, ids) in any order; returns padding and ids."""
    documents, sequences = {}, {}
    for p in pieces:
        documents.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    for rows in sequences.values():
        at = 0
        for p in sorted(rows, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= window
    lengths = [sum(p["length"] for p in rows) for rows in sequences.values()]
    for doc_id, ids in expected:
        rows = sorted(documents[doc_id, len(ids)], key=lambda p: p["start"])
        at = 0
        for p in rows:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(part)
            at += p["length"]
        assert at == len(ids)
    assert sum(map(len, documents.values())) == len(pieces)
    return sum(0 if n & (n - 1) == 0 else window - n for n in lengths), sum(lengths)


def test_query_holds_every_id_once_with_little_padding(spark, small_dir, tokenizer):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in docs]
    found = queries.op13_packing(spark, small_dir)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    padding, ids = checked([r.asDict() for r in found.collect()], expected)
    assert padding < 0.005 * ids


def test_words_are_encoded_as_the_library_does(tokenizer):
    texts = [
        "Plain text. It's ok, we'll see 12 3.5!", "\x1cA\x1fB \x85C\xa0D", "Σίσυφος ΟΔΥΣΣΕΥΣ İstanbul ẞ", "é ́x \ńy", "<|startoftext|>Hi<|ENDOFTEXT|> there<|endoftext|>.",
        "日本語 テキスト　全角 ok", "a b​c﻿d", "\v\f\r\n\t ", "", "x" * 500, "👍🏽 ok­-", "ﬁ Ⅷ ½ ² ͅ",
    ]
    with open(PATH, encoding="utf-8") as file:
        encoder = packing.WordEncoder(file.read(), 2)
    for text in texts * 2:
        words = encoder.numbers(encoder.words(text))
        got = [i for w in words for i in encoder.ids[encoder.ends[w] : encoder.ends[w + 1]]]
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, text


def least_cost(places, penalties, window):
    cost = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        options = []
        for i in range(j):
            n = places[j] - places[i]
            if n <= window and cost[i] is not None:
                options.append(cost[i] + (0 if n & (n - 1) == 0 else window - n) + penalties[j] + packing.CHARGE)
        cost[j] = min(options)
    return cost[-1]


def test_cuts_have_the_least_cost():
    rng = random.Random(2)
    for window in (16, 64):
        for _ in range(30):
            places = np.cumsum([0] + [rng.randint(1, window if rng.random() < 0.2 else 5) for _ in range(60)])
            penalties = np.array([0] + [rng.choice([0, 2, 16]) for _ in range(60)])
            cuts = packing.best_cuts(places, penalties, window)
            lengths = np.diff(places[[0, *cuts]])
            assert cuts[-1] == len(places) - 1 and (lengths <= window).all()
            padding = sum(0 if n & (n - 1) == 0 else window - n for n in lengths.tolist())
            assert padding + penalties[cuts].sum() + packing.CHARGE * len(cuts) == least_cost(places.tolist(), penalties.tolist(), window)


@pytest.mark.parametrize("horizon", [50, 1 << 18])
def test_awkward_rows(spark, tokenizer, horizon):
    long = " ".join(f"word{i % 97}" for i in range(9000))
    rows = [(None, None), (None, ""), (1, " \t\n"), (1, "Two words."), (1, "Two words."), (2, long), (None, long + "."), (3, "日本 <|endoftext|>. ok"), (4, "a. " * 3000)]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).coalesce(1)
    found = [r.asDict() for r in packing.pack(df, PATH, horizon=horizon).collect()]
    expected = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows]
    for p in found:
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
    # stored order is kept: pieces in the order of sequences and offsets are the stream
    stream = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in sorted(found, key=lambda p: (p["sequence_id"], p["offset"]))])
    assert stream.tolist() == [i for ids in expected for i in ids]
    lengths = {}
    for p in found:
        lengths[p["sequence_id"]] = lengths.get(p["sequence_id"], 0) + p["length"]
    assert max(lengths.values()) <= 4096
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in lengths.values())
    assert padding < 0.02 * len(stream)


def test_unique_sequences_over_partitions(spark, tokenizer):
    rows = [(i, f"Text {i}. " * (i % 300)) for i in range(200)]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(7)
    expected = [(i, [*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for i, t in rows]
    padding, ids = checked([r.asDict() for r in packing.pack(df, PATH).collect()], expected)
    assert padding == 0 or padding < 0.01 * ids


def test_empty_table_and_window(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert packing.pack(df, PATH).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(df, PATH, window=3000)


def test_tasks_of_a_process_share_the_words_they_looked_up():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        model = file.read()
    packing.ENCODERS.clear()
    one = packing.shared_encoder(model, 2)
    texts = ["two words, two", "Odd-ones 12 <|x|> été", "two more words."]

    def ids(encoder, text):
        return encoder.ids_of(encoder.numbers(encoder.words(text)))[0].tolist()

    first = [ids(one, text) for text in texts]
    packing.ENCODERS[model, 2] = one  # as a task that ends well does
    again = packing.shared_encoder(model, 2)
    assert not packing.ENCODERS and again is one and "words," in again.known
    assert [ids(again, text) for text in reversed(texts)][::-1] == first
    assert first == [one.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    packing.ENCODERS[model, 2] = again
    assert packing.shared_encoder(model, 3) is not one and not packing.ENCODERS  # only one is kept
