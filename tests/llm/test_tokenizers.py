import json
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ladderworks.llm import bpe_automaton, token_counts
from ladderworks.llm.bpe_automaton import TokenAutomaton, WordBpe
from ladderworks.llm.token_counts import PieceVocabulary

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABETS = ["etaoinshrdlucmfw", "ab", "the", "漢字かカ한글的一是不了人我", "aàéß漢 \n▁_", "abcdefghi'’sStT 019½.,;-🙂"]


@pytest.fixture(scope="module")
def vocabulary():
    with open(PIECES, "rb") as f:
        return PieceVocabulary(f.read())


def test_long_runs_are_counted_as_the_library_does(vocabulary):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(3)
    for letters in ALPHABETS[:5]:
        text = "".join(r.choice(letters) for _ in range(60000))
        began = time.process_time()
        n = int(vocabulary.counts(vocabulary.pre_tokens(text)).sum())
        assert time.process_time() - began < 4 and n == len(library.encode(text))


def test_both_kinds_of_rounds_agree(vocabulary, monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice(a) for _ in range(r.randint(1, 90))) for a in ALPHABETS for _ in range(300)]
    want = vocabulary.counts(texts).tolist()
    monkeypatch.setattr(token_counts, "_LINKED", 1)
    assert vocabulary.counts(texts).tolist() == want


def test_tables_that_start_anew_change_nothing(monkeypatch):
    r = random.Random(7)
    with open(WORDS, "rb") as f:
        source = f.read()
    library = Tokenizer.from_file(WORDS)
    texts = [" ".join("".join(r.choice(a) for _ in range(r.randint(0, 20))) for _ in range(8)) for a in ALPHABETS for _ in range(60)]
    monkeypatch.setattr(bpe_automaton, "_STATES", 40)
    monkeypatch.setattr(bpe_automaton, "_PIECES", 30)
    model = WordBpe(source)
    for text in [*texts, *texts[:50], "x" * 60000]:
        ids, decoded = model.encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded == library.decode(want, skip_special_tokens=False)


def test_added_tokens_of_any_spelling():
    with open(WORDS) as f:
        spec = json.load(f)
    spec["added_tokens"].append({"id": 49408, "content": "[sep]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    model, library = WordBpe(json.dumps(spec).encode()), Tokenizer.from_str(json.dumps(spec))
    for text in ("a [sep] b[sep]<|endoftext|>", "[sep", ""):
        assert np.frombuffer(model.encode(text)[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_automaton_against_merging_by_rank():
    r = random.Random(11)
    for _ in range(40):
        vocab = {**{c: i for i, c in enumerate("abc")}, **{c + "</w>": 3 + i for i, c in enumerate("abc")}}
        merges = []
        for _ in range(12):
            u, v = (r.choice(list(vocab)) for _ in range(2))
            if not u.endswith("</w>") and u + v not in vocab:
                vocab[u + v] = len(vocab)
                merges.append((u, v))
        own, rank = TokenAutomaton(vocab, merges), {m: k for k, m in enumerate(merges)}
        for _ in range(60):
            word = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
            parts = [*word[:-1], word[-1] + "</w>"]
            while pairs := [(rank[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]:
                k = min(pairs)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert own.encode(word.encode()) == [vocab[p] for p in parts]
