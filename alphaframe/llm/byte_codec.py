"""Byte-level subword ids of whole texts, with words remembered in bounded memory."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import tiktoken
from tokenizers import Tokenizer

MEMO_WORDS = 1 << 18
#: The pre-split pattern of byte-level vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that a vocabulary file uses for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteCodec:
    """``encode`` gives the ids that the tokenizer file gives, as little-endian unsigned 32-bit."""

    def __init__(self, tokenizer_file: str):
        self.whole = Tokenizer.from_file(tokenizer_file)
        back = _byte_of_char()
        added = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        ranks = {bytes(back[c] for c in t): i for t, i in self.whole.get_vocab().items() if t not in added}
        self.plain = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _direct(self, text: str) -> bytes:
        return array("I", self.plain.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if self.added is not None and self.added.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        first, *words = text.split(" ")
        memo = self.words
        found = list(map(memo.get, words))
        if None in found:
            for k, got in enumerate(found):
                if got is None:
                    w = words[k]
                    got = memo.get(w)
                    if got is None:
                        got = self.older.get(w)
                        if got is None:
                            # A space takes no part in a run only between two characters that are no space.
                            if not w or w[0].isspace() or w[-1].isspace():
                                return self._direct(text)
                            got = self._direct(" " + w)
                        if len(w) <= 64:
                            memo[w] = got
                    found[k] = got
            if len(memo) >= MEMO_WORDS:
                self.older, self.words = memo, {}
        if words and (not first or first[-1].isspace()):
            return self._direct(text)
        return self._direct(first) + b"".join(found)


@lru_cache(maxsize=2)
def byte_codec(tokenizer_file: str) -> ByteCodec:
    return ByteCodec(tokenizer_file)
