"""Words of UTF-8 texts, split and lower-cased on bytes (A-Z only, as the contracts ask)."""

from __future__ import annotations

from collections.abc import Iterable

# every ASCII byte but 0-9 and a-z separates; bytes from 0x80 on belong to words
_SEPARATORS = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.lower().translate(_TO_SPACE).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+``."""
    return text.lower().split()


class Vocabulary:
    """Numbers from 1 for a fixed set of words; every other word is 0."""

    def __init__(self, words: Iterable[bytes]):
        self.index = {w: i for i, w in enumerate(sorted(set(words)), 1)}

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, words: list[bytes]) -> list[int]:
        get = self.index.get
        return [get(w, 0) for w in words]
