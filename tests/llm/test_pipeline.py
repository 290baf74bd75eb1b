"""The corpus pipeline stage by stage."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers

from ..conftest import DATA
from .test_operators import brute_groups, brute_mix


def test_stages(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "mixing", "sentencepiece"]
    told = stages["language_id"](spark, docs, DATA)
    assert told.columns == docs.columns and told.count() >= 0.98 * docs.count()
    rows = sorted(((r["doc_id"], r["text"]) for r in told.collect()))
    single = stages["near_dedup"](spark, told, DATA)
    want = {int(c) for *_, c in brute_groups(rows, 5, 80)}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(want)
    mixed = stages["mixing"](spark, single, DATA)
    assert mixed.columns == docs.columns
    import zlib

    from rosterlake.llm.mixing import WEIGHTS

    kept = brute_mix(single.collect(), lambda r: (f"domain{zlib.crc32(r['source'].encode()) % 3}", r["lang"], r["source"]), WEIGHTS, 0.75, 1, 6)
    assert {r["doc_id"] for r in mixed.collect()} == {d for d, _ in kept}
    other = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    done = stages["sentencepiece"](spark, mixed, DATA).collect()
    assert len(done) == len(text)
    assert all(r["ids"] == other.encode(text[r["doc_id"]]) and r["parity"] and r["round_trip"] for r in done)


def test_empty_and_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.limit(30).union(docs.limit(3)).union(spark.createDataFrame([(None, None, None, None, None), (5, "", "en", None, 0), (None, "abc", None, "s", 3)], docs.schema))
    for source in (odd, docs.filter("false")):
        d = source
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, DATA)
        assert d.count() <= source.count()
