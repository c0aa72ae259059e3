"""Token ids of whole texts by a given public tokenizer.

The encoder lowers A-Z and splits texts at ASCII white space, which the tokenizer does too, and
remembers the ids of the pieces: words repeat, so most need no second look.  A piece of plain
Latin script is cut by the tokenizer's own pattern and given to its BPE model; any other piece
goes through the whole tokenizer.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from .common import as_bytes, expand, rewritten

# fixed values: the pre-tokenizer pattern of word_bpe_49k.json
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
CACHE_PIECES = 1_000_000
ENDS = (b".", b",")
SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
LAST_PLAIN = "ɏ"
DOTTED_CAPITAL_I = "İ"


def byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level BPE: itself where printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Encoder:
    """``encode(texts) -> ids``; memory is bounded by ``cache_pieces``."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.cache_pieces = cache_pieces
        # the shortcuts below are those of one kind of file; other tokenizers are asked in full
        cut = str(self.tokenizer.pre_tokenizer)
        self.by_piece = "ByteLevel" in cut and "invert=True" in cut and "Lowercase" in str(self.tokenizer.normalizer)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.sizes = np.zeros(1 << 14, dtype=np.int64)

    def _word_ids(self, word: bytes) -> list[int]:
        at = self._find(word)
        return self.flat[self.starts[at] : self.starts[at] + self.sizes[at]].tolist()

    def _piece_ids(self, piece: bytes) -> list[int]:
        if piece.isalpha():
            return [t.id for t in self.model.tokenize(piece.decode())]
        text = piece.decode("utf-8")
        if "<|" in text or max(text) > LAST_PLAIN or DOTTED_CAPITAL_I in text or not unicodedata.is_normalized("NFC", text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        words = PIECES.findall(text.lower())
        if len(words) == 1:
            return [t.id for t in self.model.tokenize("".join([self.letters[b] for b in words[0].encode()]))]
        return [i for word in words for i in self._word_ids(word.encode())]

    def _find(self, piece: bytes) -> int:
        at = self.index.get(piece)
        return self._add(piece) if at is None else at

    def _add(self, piece: bytes) -> int:
        ids = self._piece_ids(piece)
        at = len(self.index)
        self.index[piece] = at
        if at >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[at], self.sizes[at] = self.used, len(ids)
        self.used += len(ids)
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32), text after text, and the number of ids of every text; null counts as empty."""
        if not self.by_piece:
            lists = [e.ids for e in self.tokenizer.encode_batch([t.decode() for t in as_bytes(texts)], add_special_tokens=False)]
            return np.array([i for ids in lists for i in ids], dtype=np.int32), np.array([len(ids) for ids in lists], dtype=np.int64)
        if len(self.index) > self.cache_pieces:
            self._clear()
        split = pc.split_pattern(rewritten(texts, SPACES), b" ")
        pieces = split.flatten().dictionary_encode()
        get, find = self.index.get, self._find
        ends = {e: find(e) for e in ENDS}
        known = np.full((len(pieces.dictionary), 2), -1, dtype=np.int64)
        for row, p in zip(known, pieces.dictionary.to_pylist()):
            if p[-1:] in ends and p[:-1].isalpha():  # a full stop or comma is always a piece of its own
                row[1] = ends[p[-1:]]
                p = p[:-1]
            if p:
                row[0] = i if (i := get(p)) is not None else find(p)
        at = known[pieces.indices.to_numpy()].ravel()
        counts = np.where(at < 0, 0, self.sizes[at])
        ids = self.flat[expand(self.starts[at], counts)]
        before = np.concatenate([[0], np.cumsum(counts)])[::2]
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        return ids, np.diff(before[bounds])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file, so that its memory of words serves many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
