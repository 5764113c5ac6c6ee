"""Exact token counts and ids at the speed of a dictionary.

A public tokenizer splits a text before it merges, and it always splits where a visible character is
followed by white space. So the ids of a text are those of its chunks (leading white space and the
visible characters after it), one after the other, and each distinct chunk needs the tokenizer once
per Python worker. Texts where that is not certain (white space outside ASCII, strings that may be
special tokens) go to the tokenizer whole.
"""

from __future__ import annotations

import hashlib
import re
import struct

#: Distinct chunks that a Python worker remembers: the first it meets, among which the frequent ones are.
#: About 230 bytes each. Chunks beyond them are encoded each time a text has them.
MEMO_ENTRIES = 1_200_000

_CHUNK = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: White space and invisible characters outside the chunk rule, as code point ranges.
_ODD_SPACE = ((0x0B, 0x0C), (0x1C, 0x1F), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x2064), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
_UNSURE = re.compile(r"<\||[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _ODD_SPACE) + "]")
_LOADED: dict = {}


class TokenMemo:
    """Chunk -> packed little-endian ids, or chunk -> number of ids."""

    def __init__(self, path: str, space_matters: bool, counts_only: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.space_matters, self.counts_only = space_matters, counts_only
        self.known: dict = {}

    def _value(self, ids: list[int]):
        return len(ids) if self.counts_only else struct.pack(f"<{len(ids)}I", *ids)

    def _chunks(self, text: str) -> list:
        if self.space_matters:
            return _CHUNK.findall(text)
        return text.encode().split()

    def encode(self, text: str):
        """Packed ids of ``text``, or their number."""
        if _UNSURE.search(text):
            return self._value(self.tokenizer.encode(text, add_special_tokens=False).ids)
        chunks = self._chunks(text)
        known = self.known
        new = list(set(chunks).difference(known))
        if new:
            plain = new if self.space_matters else [x.decode() for x in new]
            encoded = self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)
            fresh = {chunk: self._value(enc.ids) for chunk, enc in zip(new, encoded)}
            if len(known) < MEMO_ENTRIES:
                known.update(fresh)
            else:
                values = [known[c] if c in known else fresh[c] for c in chunks]
                return sum(values) if self.counts_only else b"".join(values)
        values = map(known.__getitem__, chunks)
        return sum(values) if self.counts_only else b"".join(values)


def memo(path: str, space_matters: bool, counts_only: bool) -> TokenMemo:
    """The worker's memo for a vocabulary file. ``space_matters``: white space is part of tokens."""
    key = (path, space_matters, counts_only)
    if key not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[key] = TokenMemo(path, space_matters, counts_only)
    return _LOADED[key]


def tokenizer_digest(path: str) -> str:
    """Identity of a tokenizer: its file's bytes and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()[:32]
