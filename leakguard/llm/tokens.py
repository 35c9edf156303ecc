"""Encoding whole texts with a ``tokenizers`` file, remembering the ids of words.

A text is cut before single spaces that stand between visible characters.  No
token of a tokenizer that treats a space as the start of a word (byte-level BPE)
or drops white space crosses such a place, so the ids of the pieces, one after the
other, are the ids of the text.  Pieces repeat, so most are looked up.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

from pyspark import cloudpickle

from leakguard.llm import worker
from leakguard.llm.worker import worker_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(worker)

# Memory of the pieces that a worker remembers, in bytes: two generations of this size, and
# as much again for words.  A smaller one costs time only.  A piece is taken as ``_ENTRY``
# bytes, which is what words need; none of more than ``_LONGEST`` characters is remembered,
# so the memory has a bound whatever the texts hold.
MEMORY = 112 << 20
_ENTRY, _LONGEST = 210, 64
_SAFE_CUT = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")
# Letters with punctuation behind them are a token each under the splitting rule of
# either known kind; a single line end between such parts is a third or dropped.
_MARKS = ".,!?;:"
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


_LETTERS = dict(enumerate(_byte_letters()))
_SPACE, _LINE = _LETTERS[0x20], _LETTERS[0x0A]


def _plain_rule(path: str) -> tuple[str, bool] | None:
    """(what stands for the space before a word, whether letters are lowered) if
    plain pieces can go straight to the model."""
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    if conf["model"]["type"] != "BPE" or conf["model"].get("dropout"):
        return None
    split, norm = conf["pre_tokenizer"] or {}, conf["normalizer"]
    if split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and norm is None:
        return _SPACE, False
    parts = [x["type"] for x in split.get("pretokenizers", [])]
    norms = [x["type"] for x in (norm or {}).get("normalizers", [])]
    if parts == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"]:
        if split["pretokenizers"][0]["invert"] and not split["pretokenizers"][1]["use_regex"]:
            return "", True
    return None


def _safe(piece: str) -> bool:
    """Whether a cut before a single space is allowed on either side of ``piece``."""
    if not piece:
        return False
    first, last = piece[0], piece[-1]
    return ("!" <= first <= "~" or first.isalnum()) and ("!" <= last <= "~" or last.isalnum())


class _Pieces(dict):
    """Ids of pieces behind a space; ``unsafe`` is set when one may not stand alone."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.old, self.unsafe = learn, {}, False

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.learn(piece)
            if ids is None:
                self.unsafe = True
                return b""
        if len(piece) <= _LONGEST:
            self[piece] = ids
        return ids

    def age(self, memory: int) -> None:
        """Forget pieces not seen for two generations."""
        if len(self) * _ENTRY > memory:
            self.old = dict(self)
            self.clear()


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = memory
        self.pieces = _Pieces(self._behind_space)
        self.words: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.rule = _plain_rule(path)
        self.line = b"" if self.rule is None or self.rule[1] else self._model(_LINE)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, shown: str) -> bytes:
        """Ids of one token of the splitting rule, written in byte letters."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _part(self, part: str, before: str, seen: dict[str, bytes]) -> bytes | None:
        """Ids of letters with punctuation behind them; None for anything else."""
        word = part.rstrip(_MARKS)
        ids = seen.get(word)
        if ids is None:
            if not word.isalpha() or not (word.isascii() or _LATIN.fullmatch(word)):
                return None
            shown = word.lower() if self.rule[1] else word
            if not shown.isascii():
                shown = shown.encode().decode("latin-1").translate(_LETTERS)
            ids = seen[word] = self._model(before + shown)
        if len(word) == len(part):
            return ids
        marks = part[len(word) :]
        if marks not in self.marks:
            self.marks[marks] = self._model(marks)
        return ids + self.marks[marks]

    def _behind_space(self, piece: str) -> bytes | None:
        """Ids of a piece behind a space; None if it may not stand alone."""
        if self.rule:
            before = self.rule[0]
            if "\n" in piece:
                first, *rest = piece.split("\n")
                parts = [self._part(first, before, self.words), *(self._part(x, "", self.bare) for x in rest)]
                if None not in parts:
                    return self.line.join(parts)
            else:
                ids = self._part(piece, before, self.words)
                if ids is not None:
                    return ids
        return self._whole(" " + piece) if _safe(piece) else None

    def encode(self, text: str) -> bytes:
        pieces = self.pieces
        first, *rest = text.split(" ")
        pieces.unsafe = False
        ids = b"".join(map(pieces.__getitem__, rest))
        if pieces.unsafe:
            first, *rest = _SAFE_CUT.split(text)
            ids = b"".join([pieces[p] if p in pieces else self._whole(" " + p) for p in rest])
        start = self._part(first, "", self.bare) if self.rule else None
        return (self._whole(first) if start is None else start) + ids

    def age(self) -> None:
        self.pieces.age(self.memory)
        if (len(self.words) + len(self.bare)) * _ENTRY > self.memory:
            self.words, self.bare, self.marks = {}, {}, {}


def encode_all(path: str, texts: Iterable[str], memory: int = MEMORY) -> Iterator[bytes]:
    """Ids of each text in order, as little-endian unsigned 32-bit bytes."""
    state = worker_state()
    key = ("encoder", path)
    encoder = state.get(key)
    if encoder is None:
        state.clear()  # one encoder at a time
        encoder = state[key] = PieceEncoder(path)
    encoder.memory = memory
    for text in texts:
        encoder.age()
        yield encoder.encode(text)


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file in the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)
