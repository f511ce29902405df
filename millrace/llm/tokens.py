"""Token ids of whole texts by a tokenizer file, one dictionary lookup a word.

The tokenizers here never merge across a space, line feed or tab (their pre-tokenisation drops white
space), so a text's ids are those of its space-separated parts in order. A part is encoded once by the library and then
comes from a bounded cache.
"""

from __future__ import annotations

import itertools
import os
import re
from array import array

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
#: Cached parts per worker, about 40 MB; beyond that the oldest quarter stays, where frequent words are.
MOST_PARTS = 200_000
#: Parts longer than this do not stay in the cache.
LONG_PART = 64
#: Letters, then punctuation: the two never share a token, and these letters are in normal form and
#: have one lower case, so the normaliser has nothing else to do.
_PLAIN = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,!?;:|#$%&*]*)").fullmatch
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level symbols: visible bytes stand for themselves, the others follow from 256 on.
_SYMBOL = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _VISIBLE)}


class _Known(dict):
    """Ids by part; a part asked for the first time is encoded there and then.

    Plain words go to the merge model as lower-case stems, which many parts share; all else passes
    through the whole tokenizer.
    """

    def __init__(self, tokenizer: Tokenizer, items=()) -> None:
        super().__init__(items)
        self.tokenizer, self.tokenize = tokenizer, tokenizer.model.tokenize

    def __missing__(self, part: str) -> bytes:
        if part.isascii() and part.isalpha():
            stem, tail = part.lower(), ""
        else:
            found = _PLAIN(part)
            if not found:
                ids = array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
                if len(part) <= LONG_PART:
                    self[part] = ids
                return ids
            stem, tail = found[1].lower(), found[2]
        ids = self.get(stem)
        if ids is None:
            symbols = stem if stem.isascii() else stem.encode().decode("latin-1").translate(_SYMBOL)
            ids = array("I", [x.id for x in self.tokenize(symbols)]).tobytes()
            if len(stem) <= LONG_PART:
                self[stem] = ids
        if tail:
            ids += self[tail]
        if len(part) <= LONG_PART:
            self[part] = ids
        return ids


#: A text on which the shortcuts are tried: letters of all plain kinds, tails, cases, white space.
PROBE = " ".join([*(f"{chr(a)}{chr(b)}{c}" for a, b, c in zip([*range(65, 91), *range(192, 215), *range(216, 247), *range(248, 256)], [*range(97, 123)] * 4, itertools.cycle([*".,!?;:|#$%&*", "", "!!", ".,"]))), "Straße  word\n\tWORD x1 don't ", "internationalisation"])


class Encoder:
    """ids as little-endian unsigned 32-bit bytes.

    A tokenizer file for which the shortcuts do not hold (one that merges across white space, keeps
    case or normalises otherwise) is refused with a ValueError.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.cache = _Known(self.tokenizer, {"": b""})
        if ids(self.encode([PROBE])[0]).tolist() != self.tokenizer.encode(PROBE, add_special_tokens=False).ids:
            raise ValueError(f"{path}: parts between white space do not give the ids of the whole text")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > MOST_PARTS:
            self.cache = _Known(self.tokenizer, itertools.islice(self.cache.items(), MOST_PARTS // 4))
        known = self.cache.__getitem__
        return [b"".join(map(known, (t or "").replace("\n", " ").replace("\t", " ").split(" "))) for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file; a bare name is looked up among the public tokenizers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path if os.sep in path else public_tokenizers.path(path))
    return _ENCODERS[path]


def ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")
