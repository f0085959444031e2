"""What a worker of op7 remembers, and how it splits texts at white space."""

import public_tokenizers

from ladderworks.llm import bpe_automaton


def test_words_that_come_again_are_encoded_once(monkeypatch):
    """Texts of 100,000 words in turn had each word encoded anew every time."""
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        model = bpe_automaton.WordBpe(f.read())
    text = " ".join(f"w{k}" for k in range(100_000))
    first = model.encode(text)
    monkeypatch.setattr(model.automaton, "encode", None)
    assert model.encode(text) == first


def test_splits_at_white_space_alone(tmp_path):
    """str.split takes four separators for white space that Unicode's White_Space hasn't; every character is held against the library."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        model = bpe_automaton.WordBpe(f.read())
    library = Tokenizer.from_file(path)
    for c in [chr(k) for k in range(0x250)] + list(" ᠎  ​    ⁠　﻿Σ"):
        for text in (f"One{c}two", f"{c}İx É{c} word{c}{c}word"):
            ids, decoded = model.encode(text)
            want = library.encode(text, add_special_tokens=False)
            assert ids == b"".join(i.to_bytes(4, "little") for i in want.ids), repr(text)
            assert decoded == library.decode(want.ids, skip_special_tokens=False), repr(text)
