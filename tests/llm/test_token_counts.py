"""Token counts of all prefixes against the library, prefix by prefix."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import token_counts, token_records

from ..conftest import DATA

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "e", "the", "ing", " ", "  ", "\n", "\t", "'", "'re", "'s", "'ll", "é", "日本", "語", "😀", "1", "23", ".", "-----", "<|endoftext|>", "<|endof", "|>", "　", "\x1c", "\x85", "ø", "A", "=", "\r\n", " '", "re", "ª", "²"]
ODD = [None, "", " ", "\n", "word", "one two\n", "two  spaces \n", "they're 'll", "a" * 3000, " " * 500 + "x", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "日本語 text　", "same", "same"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(PATH)


@pytest.mark.parametrize("seed", range(4))
def test_every_prefix(counter, library, seed):
    rng = random.Random(seed)
    for _ in range(400):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 14)))
        assert counter.counts(text).tolist() == [library(text[:i]) for i in range(len(text) + 1)], repr(text)


def test_white_space_and_marks_of_all_kinds(counter, library):
    for c in map(chr, [*range(1, 0x300), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF]):
        for text in (f"a{c}{c}a", f" {c} c", f"'{c}e", f"a{c} b"):
            assert counter.counts(text).tolist() == [library(text[:i]) for i in range(len(text) + 1)], repr(text)


def frame(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, counts string")


def test_questions_need_no_tokenizer(spark, library):
    done = token_counts.with_counts(frame(spark), PATH)
    assert done.columns == ["doc_id", "text", "counts"]
    for budget in (0, 1, 3, 40):
        rows = done.select("text", token_counts.n_tokens().alias("n"), token_counts.longest_prefix(budget).alias("p"), token_counts.truncated(budget).alias("cut"), token_counts.count_of_prefix(4).alias("four")).collect()
        assert len(rows) == len(ODD)
        for r in rows:
            text = r["text"] or ""
            fits = [i for i in range(len(text) + 1) if i < 60 and library(text[:i]) <= budget or i >= 60 and i in (r["p"], r["p"] + 1, len(text)) and library(text[:i]) <= budget]
            assert (r["n"], r["p"], r["cut"], r["four"]) == (library(text), max(fits), text[: max(fits)], library(text[:4]))
    with pytest.raises(ValueError):
        token_counts.longest_prefix(-1)


@pytest.mark.parametrize("budget", [1, 7, 100])
def test_pieces_within_a_budget(spark, library, budget):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(frame(spark).select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = token_counts.pieces(token_counts.with_counts(docs, PATH), budget).orderBy("doc_id", "piece_number").collect()
    joined: dict = {}
    for r in got:
        joined.setdefault(r["doc_id"], []).append(r)
    for d, own in joined.items():
        assert "".join(r["piece"] for r in own) == texts[d]
        assert [r["piece_number"] for r in own] == list(range(len(own)))
        assert all(r["piece_tokens"] <= budget or " " not in r["piece"][1:].strip() or "  " in r["piece"] for r in own)
    assert {d for d, t in texts.items() if t} == set(joined)
    for r in random.Random(1).sample(got, 300):
        assert library(r["piece"]) == r["piece_tokens"]


def test_query_against_whole_texts(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in token_counts.op13_token_counts(spark, DATA).collect():
        text = texts.pop(r["doc_id"])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), library(text), library(text) > 512)
        assert library(text[: r["chars_in_limit"]]) <= 512 and (not r["over_limit"]) == (r["chars_in_limit"] == len(text))
    assert not texts


def test_edge_tables(spark, tmp_path):
    frame(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert token_counts.op13_token_counts(spark, str(tmp_path)).count() == 0


def test_records_of_texts_that_end_in_white_space(library):
    encode = token_records._encoder(PATH)
    for text in filter(None, ODD):
        assert len(encode(text)) // 4 == library(text)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
