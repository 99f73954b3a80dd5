"""Token ids of whole texts by the ``tokenizers`` library.

A pre-token of a byte-level tokenizer never goes on from a visible character into white
space, so a text may be encoded piece by piece, cut before each run of white space.
Pieces repeat, so each Python worker keeps the ids of those that it has seen. New ones that
begin with white space and end without are put together for one call of the library, as it
would cut there anyway, and the ids are dealt out by the bytes that each token stands for. A text with white
space other than blank, tab and line ends is encoded in one go. The tests compare both
ways on whole tables.

The operators call the library as it is: a string of a special token in a text is that
token. It holds no white space, so the cut stays exact.
"""

from __future__ import annotations

import gc
import os
import re
from array import array

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 0
#: Pieces that a worker remembers (about 250 bytes each).
REMEMBERED = 800_000
#: New pieces of a call.
JOINED = 1000

_SPACE = " \n\t\r"
_PIECE = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: White space and format characters but blank, tab, line feed and carriage return.
_UNUSUAL = re.compile("[\x0b\x0c\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u2060\u3000\ufeff\x1c-\x1f\u2000-\u200f]")


class Encoder:
    """Encodes batches of texts; one per Python worker and vocabulary file.

    Without ``special``, strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not special
        self._ids: dict[str, bytes] = {}
        self.wide = self._tokenizer.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self._code = "I" if self.wide else "H"
        # Bytes of each token: in a byte-level vocabulary one character stands for one byte.
        names = self._tokenizer.get_vocab(with_added_tokens=True)
        self._bytes = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self._bytes[i] = len(name)
        for i, added in self._tokenizer.get_added_tokens_decoder().items():
            self._bytes[i] = len(added.content.encode())

    def whole(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text: two bytes an id, four for vocabularies above 65,536."""
        collecting = gc.isenabled()
        gc.disable()  # millions of strings and no cycles: collections would only cost time
        try:
            return self._batch(texts)
        finally:
            if collecting:
                gc.enable()

    def _batch(self, texts: list[str | None]) -> list[bytes]:
        cut = [None if t and _UNUSUAL.search(t) else _PIECE.findall(t or "") for t in texts]
        known = self._ids
        if len(known) > REMEMBERED:
            known.clear()
        new = set().union(*(c for c in cut if c)).difference(known)
        alone = [p for p in new if p[0] not in _SPACE or p[-1] in _SPACE]
        for at in range(0, len(alone), 4000):
            some = alone[at : at + 4000]
            ids = [e.ids for e in self._tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            known.update(zip(some, [array(self._code, i).tobytes() for i in ids]))
        new.difference_update(alone)
        after_space = list(new)
        for at in range(0, len(after_space), JOINED):
            self._learn(after_space[at : at + JOINED])
        look = known.__getitem__
        return [self.whole(t).tobytes() if c is None else b"".join(map(look, c)) for t, c in zip(texts, cut)]


    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces that all begin with white space and end without."""
        text = "".join(pieces)
        found = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids = np.array(found, self.dtype)
        ends = np.cumsum(list(map(len, pieces if text.isascii() else [p.encode() for p in pieces])))
        reached = np.cumsum(self._bytes[ids])
        places = np.searchsorted(reached, ends) + 1
        if places[-1] > len(ids) or not np.array_equal(reached[places - 1], ends):
            raise ValueError("a token spans white space: the vocabulary is not of the kind that is expected")
        data, size = ids.tobytes(), self.dtype.itemsize
        places = (places * size).tolist()
        self._ids.update(zip(pieces, [data[a:b] for a, b in zip([0, *places], places)]))


_encoders: dict[str, Encoder] = {}


def vocabulary(name: str = BYTE_BPE) -> str:
    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, special=True)
    return _encoders[path]


def blocks(texts: list[str | None], size: int = 4_000_000):
    """Slices of a batch of about ``size`` characters, one text at least."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and held + n > size:
            yield start, i
            start, held = i, 0
        held += n
    if texts:
        yield start, len(texts)
