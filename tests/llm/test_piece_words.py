"""Words of a batch are looked at once each; odd spaces, byte pieces and markers give what the other library gives."""

from __future__ import annotations

import public_tokenizers

from rosterlake.llm.piece_codec import Codec


def test_different_words_of_a_batch():
    codec = Codec(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["one two one", "two one", "", "odd  space one", "tail ", "\tone　x y", "▁mark \U0001f600\U0001f600 z"]
    took = [codec.whole(t) for t in texts]
    cut, new = codec._cut(texts[:2], took[:2])
    assert cut == [["one", "two", "one"], ["two", "one"]] and new == {"one", "two"}
    got = codec.encode(texts)
    assert [i.tolist() for i, _, _ in got] == [codec.reference.encode(t) for t in texts]
    assert [(p, r) for _, p, r in got] == [(True, "▁" not in t) for t in texts]
    assert codec._cut(texts[:2], took[:2])[1] == set()
