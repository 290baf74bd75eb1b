"""Words of ASCII letters go to the byte-level model as they are; all words keep the library's ids."""

from __future__ import annotations

from array import array

import public_tokenizers

from rosterlake.llm import token_records


class Asked(dict):
    seen: list

    def __getitem__(self, key):
        self.seen.append(key)
        return super().__getitem__(key)


def test_ascii_words_are_not_rewritten(monkeypatch):
    from tokenizers import Tokenizer

    table = Asked(token_records._AS_TEXT)
    table.seen = []
    monkeypatch.setattr(token_records, "_AS_TEXT", table)
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, library = token_records.byte_bpe(path), Tokenizer.from_file(path)
    for chunk in ("word", " Word", " word,", " été", "çà", " a.\nB"):
        table.seen.clear()
        assert ids(chunk) == array("I", library.encode(chunk, add_special_tokens=False).ids).tobytes()
        assert not chunk.isascii() or set(table.seen) <= {32}
