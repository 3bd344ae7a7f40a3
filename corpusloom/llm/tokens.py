"""Token ids of whole texts from a public vocabulary file.

The tokenizer drops white space and case, so what stands between white space is
encoded on its own and remembered, as running text repeats its words.  Ids are the same as those of the whole text.
"""

from __future__ import annotations

import re
from itertools import islice
from struct import pack

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
#: Words kept before the memory starts anew.
REMEMBERED = 400_000
#: A run of letters that neither compose nor change under lower-casing (a-z, ß to ÿ), then punctuation.
RUN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")
#: Opens a special token, which counts only as written.
SPECIAL = b"<|"


def default_path() -> str:
    return public_tokenizers.path(WORD_BPE)


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class _Marks(dict):
    """The ids of runs of punctuation."""

    def __init__(self, ids):
        super().__init__()
        self.ids = ids

    def __missing__(self, run: bytes) -> bytes:
        if len(self) > 10_000:
            self.clear()
        self[run] = found = self.ids(run.decode())
        return found


class WordEncoder(dict):
    """Encodes texts with a vocabulary of word ends, as little-endian uint32 bytes.

    As a dictionary it holds the ids of lower-cased words; a word that is missing
    is encoded on its first use.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize  # takes one run of letters, written as byte letters
        self.letters = dict(enumerate(_byte_letters()))
        self.marks = _Marks(self._ids)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        parts = RUN.fullmatch(word)
        if parts is None:
            ids = self._ids(word.decode())
        elif parts[2]:
            ids = self[parts[1]] + self.marks[parts[2]]
        else:
            run = word.decode() if word.isascii() else word.decode("latin-1").translate(self.letters)
            tokens = self.merge(run)
            ids = pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        self[word] = ids
        return ids

    def _forget(self) -> None:
        """Drop the older half of the words once there are too many."""
        if len(self) > REMEMBERED:
            newer = list(islice(self.items(), len(self) // 2, None))
            self.clear()
            self.update(newer)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, four bytes an id; a null text has none."""
        out, find = [], self.__getitem__
        for text in texts:
            raw = (text or "").encode("utf-8", "replace")
            out.append(self._ids(raw.decode()) if SPECIAL in raw else b"".join(map(find, raw.lower().split())))
            self._forget()
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, read once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
