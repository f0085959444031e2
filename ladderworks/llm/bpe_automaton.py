"""Byte-pair encoding and decoding with a tokenization automaton compiled from the merges.

The automaton's arcs carry tokens; a path spells a text in exactly one way, the way that the merges would. It grows
by one gadget for each merge (u, v), in order of priority. The gadget looks at the state that u-arcs lead to: that
state is copied without its v-arc, the u-arcs go to the copy, and every state with a u-arc gets an arc for the merged
token to where v led. A copy shares all but one arc with its original, so a state is held as (token, version): the
state that the token's arcs led to after so many merges. That takes one table row for each merge, and the arcs of any
state follow from the rows.

For encoding, the token arcs are spelled out into a deterministic automaton over symbols. Its state is the set of arcs that
are being spelled, each with the token before it, and the token that ends the prefix read so far. There is exactly one such
token, so a word is encoded by one transition for each symbol and a walk back over the tokens' lengths. The table of
transitions is filled in from the token automaton as words need them, and starts anew when it has ``_STATES`` states.
Decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import getitem

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderworks.llm.frames import packed, row_field, trimmed, unpacked

WORD_END = "</w>"
#: Unicode's White_Space, stated because regex libraries differ on the ASCII separators.
_WHITE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
#: What str.split takes for white space besides.
_SEPARATORS = re.compile("[\\x1c-\\x1f]")
#: What a worker holds at most: twice so many known pieces of text (of at most ``_PIECE`` characters each), pairs of tokens, states.
_PIECES, _PIECE = 1 << 17, 64
_PAIRS = 1 << 17
_STATES = 1 << 17


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible, else the next from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class TokenAutomaton:
    """States (token, version) and their arcs."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        self.labels = {i: s for s, i in vocab.items()}
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.removed_at: dict[tuple[int, int], int] = {}
        for when, (u, v) in enumerate(merges, 1):
            a, b, made = vocab[u], vocab[v], vocab[u + v]
            self.removed_at.setdefault((a, b), when)
            if made not in self.born:
                self.born[made], self.parts[made] = when, (a, b)
        self.end = len(merges)
        self.width = max(vocab.values(), default=0) + 2
        self.table: dict[int, bool] = {}
        self.live: dict[int, bool] = {}
        self._spell_out()
        self._restart()

    def _lacks(self, token: int, version: int, arc: int) -> bool:
        """Whether a gadget took the arc from the state, or from the state that it was copied from."""
        while True:
            when = self.removed_at.get((token, arc))
            if when is not None and when <= version:
                return True
            if token not in self.parts:
                return False
            version = min(version, self.born[token] - 1)
            token = self.parts[token][1]

    def has_arc(self, token: int, version: int, arc: int) -> bool:
        while True:
            if self._lacks(token, version, arc):
                return False
            if arc not in self.parts:
                return True
            if not self.reached(arc):
                return False
            when = self.born[arc]
            while self.born.get(token, 0) >= when:
                version = min(version, self.born[token] - 1)
                token = self.parts[token][1]
            version = min(version, when)
            arc = self.parts[arc][0]

    def reached(self, token: int) -> bool:
        """Whether the gadget of the token's merge found the path of its two parts."""
        if token not in self.parts:
            return True
        if token not in self.live:
            a, b = self.parts[token]
            self.live[token] = self.reached(a) and self.reached(b) and self.has_arc(a, self.born[token] - 1, b)
        return self.live[token]

    def follows(self, token: int, arc: int) -> bool:
        key = token * self.width + arc
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= _PAIRS:
                self.table.clear()
            found = self.table[key] = self.has_arc(token, self.end, arc)
        return found

    def _spell_out(self) -> None:
        """The trie of the arcs' bytes: children by node, and the token that a node ends, within a word or at its end."""
        values = {c: b for b, c in enumerate(byte_symbols())}
        self.children: list[dict[int, int]] = [{}]
        self.inner: list[int | None] = [None]
        self.final: list[int | None] = [None]
        self.size: dict[int, int] = {}
        for text, token in self.vocab.items():
            symbols = text.removesuffix(WORD_END)
            if not symbols or any(c not in values for c in symbols):
                continue
            node = 0
            for c in symbols:
                node = self.children[node].setdefault(values[c], len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.inner.append(None)
                    self.final.append(None)
            (self.final if text.endswith(WORD_END) else self.inner)[node] = token
            self.size[token] = len(symbols)

    def _restart(self) -> None:
        """The table of transitions with its start state alone: nothing is spelled but from the root, after no token."""
        self.start = _State(self, (0,), -1)
        self.states = {self.start.spelled: self.start}

    def advance(self, state: _State, byte: int, tokens: list[int | None]) -> tuple[list[int], int]:
        """The arcs still being spelled after the byte, and the token that ends there, or -1.

        An arc is its node in the trie times ``width``, plus the token before it; that is counted from 1, and 0 is none.
        """
        left, token = [], -1
        for arc in state.spelled:
            node, before = divmod(arc, self.width)
            node = self.children[node].get(byte, -1)
            if node < 0:
                continue
            if self.children[node]:
                left.append(node * self.width + before)
            made = tokens[node]
            if made is not None and token < 0 and (self.follows(before - 1, made) if before else self.reached(made)):
                token = made
        return left, token

    def encode(self, word: bytes) -> list[int]:
        """Tokens of one word; its last byte carries the word end."""
        if not word:
            return []
        if len(self.states) >= _STATES:
            self._restart()
        path = list(accumulate(word[:-1], getitem, initial=self.start))
        token = path[-1].end(word[-1])
        out, at = [token], len(path) - self.size[token]
        while at > 0:
            state = path[at]
            out.append(state.token)
            at -= state.size
        out.reverse()
        return out


class _State(dict):
    """A state of the deterministic automaton: the next state by byte, filled in on first use."""

    __slots__ = ("automaton", "ends", "size", "spelled", "token")

    def __init__(self, automaton: TokenAutomaton, spelled: tuple[int, ...], token: int):
        self.automaton, self.spelled, self.token, self.size = automaton, spelled, token, automaton.size.get(token, 0)
        self.ends: dict[int, int] | None = None

    def __missing__(self, byte: int) -> _State:
        own = self.automaton
        left, token = own.advance(self, byte, own.inner)
        if token >= 0:  # the next token starts here, after this one
            left.insert(0, token + 1)
        key = tuple(left)
        to = own.states.get(key)
        if to is None:
            to = own.states[key] = _State(own, key, token)
        self[byte] = to
        return to

    def end(self, byte: int) -> int:
        """The token that ends a word with the byte."""
        if self.ends is None:
            self.ends = {}
        found = self.ends.get(byte)
        if found is None:
            found = self.ends[byte] = self.automaton.advance(self, byte, self.automaton.final)[1]
        return found


class WordBpe:
    """A tokenizer file with word-end BPE: added tokens, normal form, word pattern, automaton."""

    def __init__(self, source: bytes, labelled: bool = True):
        self.labelled = labelled
        spec = json.loads(source)
        model = spec["model"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = TokenAutomaton(model["vocab"], merges)
        self.split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(self.split.replace("\\s", "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000")).findall
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def normal(self, text: str) -> str:
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def piece(self, text: str) -> tuple[bytes, str]:
        """The ids of a text without white space, as bytes, and its labels. No word goes over white space."""
        found = self.older.get(text)
        if found is None:
            encode = self.automaton.encode
            ids = [i for w in self.find(self.normal(text)) for i in encode(w.encode())]
            found = struct.pack(f"<{len(ids)}I", *ids), self.decode(ids) if self.labelled else ""
        if len(text) <= _PIECE:
            if len(self.known) >= _PIECES:
                self.older, self.known = self.known, {}
            self.known[text] = found
        return found

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels; this kind of file has no decoder, so they are set side by side with spaces."""
        names = self.automaton.labels
        return " ".join([names[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, str]:
        """The text's ids as little-endian 32-bit integers, and the decoded text."""
        parts = self.specials.split(text) if any(s in text for s in self.added) else [text]
        found: list[tuple[bytes, str]] = []
        for k, part in enumerate(parts):
            if k % 2:
                found.append((struct.pack("<I", self.added[part]), part))
            else:
                known, piece = self.known.get, self.piece
                found += [known(p) or piece(p) for p in (_WHITE.split(part) if _SEPARATORS.search(part) else part.split()) if p]
        return b"".join([ids for ids, _ in found]), " ".join([labels for ids, labels in found if ids])


_models: dict[str, WordBpe] = {}


def _model(held, name: str, labelled: bool) -> WordBpe:
    """One model at a time is held in a worker."""
    key = f"{name} {labelled}"
    if key not in _models:
        _models.clear()
        _models[key] = WordBpe(held.value, labelled)
    return _models[key]


def _encode(batches: Iterator[pa.RecordBatch], held, name: str, decode: bool) -> Iterator[pa.RecordBatch]:
    trimmed()
    model = _model(held, name, decode)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            coded = [model.encode(t or "") for t in part.column("_text").to_pylist()]
            columns = {"_row": part.column("_row"), "ids": pa.array([c[0] for c in coded], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns | ({"decoded": pa.array([c[1] for c in coded], pa.string())} if decode else {}))


def encode_texts(docs: DataFrame, model_path: str, text_col: str = "text", decode: bool = True) -> DataFrame:
    """The documents without their text, and ``ids`` (little-endian unsigned 32-bit integers in one binary), ``n_tokens``
    and, with ``decode``, ``decoded`` (what decoding the ids gives). No special tokens are added; those that stand in a text
    are encoded as such. The tokenizer file (a few MB) is broadcast.

    * Null and empty texts have no ids; their decoded text is empty.
    * Whole texts are encoded, whatever their length; repeated rows each have their own result.
    * An empty table gives an empty table. Input columns of the names of the results are replaced.
    """
    with open(model_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([row_field(docs, text_col), T.StructField("ids", T.BinaryType())] + ([T.StructField("decoded", T.StringType())] if decode else []))
    coded = packed(docs, text_col).mapInArrow(lambda batches: _encode(batches, held, model_path, decode), schema)
    new = {"ids": F.col("ids"), "n_tokens": (F.octet_length("ids") / 4).cast("long")}
    return unpacked(coded, docs, text_col, None, **new | ({"decoded": F.col("decoded")} if decode else {}))


def decode_ids(frame: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """The frame with ``decoded``: the labels of the ids in ``ids_col``. Null ids give null."""
    with open(model_path, "rb") as f:
        held = frame.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([*(f for f in frame.schema.fields if f.name != "decoded"), T.StructField("decoded", T.StringType())])

    def run(batches):
        model = _model(held, model_path, True)
        names = model.automaton.labels | {i: s for s, i in model.added.items()}
        for batch in batches:
            texts = [None if x is None else " ".join(names[i] for i in np.frombuffer(x, "<u4").tolist()) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return frame.mapInArrow(run, schema)
