"""Token ids of whole texts by a public tokenizer file, with the ids of frequent words kept.

A text is cut at white space. Every tokenizer file used here treats white space as a boundary that no
token crosses, so the ids of a text are the ids of its chunks in turn. A chunk that is letters only is
one unit for the model; others go through the whole tokenizer.
"""

from __future__ import annotations

import json
import os

import numpy as np

#: Chunks kept for each of two generations; the older one is dropped when the newer is full.
KEEP = 500_000
_LOADED: dict[str, WordIds] = {}


class WordIds(dict):
    """chunk -> its ids as little-endian bytes. One for each tokenizer file and Python worker."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
        #: The shortcuts hold for tokenizers that lower-case, drop white space and split letters from the rest.
        self.plain = "Lowercase" in steps and '"invert": true' in steps and "[^\\\\s\\\\p{L}\\\\p{N}]+" in steps
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.old: dict[str, bytes] = {}
        from tokenizers.pre_tokenizers import ByteLevel

        self.letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self.marks = {c: self._full(c) for c in ".,"} if self.plain else {}

    def _full(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            if chunk.isalpha():
                unit = chunk if chunk.isascii() else self.letters.pre_tokenize_str(chunk)[0][0]
                ids = np.asarray([t.id for t in self.model.tokenize(unit)], dtype=self.dtype).tobytes()
            elif chunk[-1] in ".," and chunk[:-1].isalpha():
                ids = self[chunk[:-1]] + self.marks[chunk[-1]]
            else:
                ids = self._full(chunk)
        if len(chunk) <= 64:
            if len(self) >= KEEP:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; a null counts as empty."""
        if not text:
            return b""
        if not self._regular(text):
            return self._full(text)
        return b"".join(map(self.__getitem__, text.lower().split()))

    def _regular(self, text: str) -> bool:
        """Whether lower-casing and cutting at white space first leads to the same ids."""
        if not self.plain or any(s in text for s in self.special):
            return False
        if text.isascii():
            return "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f")
        import unicodedata

        return "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1fΣİͅ") and unicodedata.is_normalized("NFC", text)


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
