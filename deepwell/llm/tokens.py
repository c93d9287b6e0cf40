"""Public vocabularies over whole batches: each distinct stretch of text is encoded once.

Byte-level BPE never merges across the boundary before a blank that follows a character other than
white space, so a text's tokens are those of the stretches between such boundaries, one after the
other. A batch's distinct stretches are found by hash and encoded; a bounded table of them stays with
the worker between batches. SentencePiece models differ in one thing: a text's final blank has no token. Vocabulary files are read from ``folder`` (see ``default_folder``).
"""

from __future__ import annotations

import base64
import importlib.util
from pathlib import Path

import numpy as np

from . import textops as T

GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT = 1 << 19

# A blank is a boundary if the byte before it can't be the end of a white-space character: in UTF-8 those
# beyond ASCII end in 80-8A, 85, 9F, A0, A8, A9 or AF. The control bytes 1C-1F count as white space.
_CUT_AFTER = np.ones(256, bool)
_CUT_AFTER[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False


def default_folder() -> str:
    """The folder of the installed public tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    return str(Path(spec.origin).parent) if spec and spec.origin else "/opt/tokenizers"


def stretches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of the stretches; every row's start and end is one."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        cut[1:-1] = (data[1:] == 32) & _CUT_AFTER[data[:-1]]
    cut[offsets] = True
    return np.flatnonzero(cut)


class Vocabulary:
    """``sizes``: bytes of each token; ``fallback``: tokens that are bytes for want of a piece."""

    def __init__(self, file: str, folder: str | None = None):
        path = str(Path(folder or default_folder(), file))
        self.file = file
        if file.endswith(".tiktoken"):
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
            self._bpe = tiktoken.Encoding(file, pat_str=GPT2_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.n = max(ranks.values()) + 1
            self.pieces = [b""] * self.n
            for piece, i in ranks.items():
                self.pieces[i] = piece
            self._encode = self._bpe.encode_ordinary
            # without a piece of its own, a character beyond ASCII is spelt in tokens that aren't text alone
            self.fallback = np.array([not _is_text(p) for p in self.pieces])
        else:
            import sentencepiece

            self._pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.n = self._pieces.vocab_size()
            self.pieces = [self._pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(self.n)]
            self._encode = None
            self.fallback = np.array([self._pieces.is_byte(i) for i in range(self.n)])
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        self._hash = np.zeros(0, np.uint64)  # sorted
        self._at = np.zeros(0, np.int64)
        self._len = np.zeros(0, np.int64)
        self._flat = np.zeros(0, np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows, and the rows' bounds in them."""
        bounds = stretches(data, offsets)
        if len(bounds) < 2:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        starts, ends = bounds[:-1], bounds[1:]
        if self._encode is None:  # SentencePiece puts a blank before the first word: a stretch's own goes
            starts = starts + ((data[starts] == 32) & (np.searchsorted(offsets, starts, "left") == np.searchsorted(offsets, starts, "right")))
        keys, first, inverse = np.unique(T.span_hashes(T.prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self._hash, keys)
        place[place == len(self._hash)] = 0
        known = self._hash[place] == keys if len(self._hash) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        if len(new):
            if len(self._hash) + len(new) > KEPT:
                self._hash, self._at, self._len, self._flat = self._hash[:0], self._at[:0], self._len[:0], self._flat[:0]
                new = np.arange(len(keys))
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            ids = [self._encode(t) for t in texts] if self._encode else self._pieces.encode(texts, num_threads=1)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum()))
            at = len(self._flat) + np.cumsum(lengths) - lengths
            self._flat = np.concatenate([self._flat, flat])
            self._hash = np.concatenate([self._hash, keys[new]])
            order = np.argsort(self._hash, kind="stable")
            self._hash = self._hash[order]
            self._at = np.concatenate([self._at, at])[order]
            self._len = np.concatenate([self._len, lengths])[order]
            place = np.searchsorted(self._hash, keys)
        here = place[inverse]
        lengths = self._len[here]
        tokens = self._flat[T.ragged(self._at[here], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return tokens, total[np.searchsorted(bounds, offsets)]


def _is_text(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


_loaded: dict[tuple[str, str | None], Vocabulary] = {}


def vocabulary(file: str, folder: str | None = None) -> Vocabulary:
    """One per worker process."""
    if (file, folder) not in _loaded:
        _loaded[file, folder] = Vocabulary(file, folder)
    return _loaded[file, folder]


def pack_ids(ids: np.ndarray, n: int) -> bytes:
    """Little-endian ids of 2 bytes where the vocabulary has at most 65,536 tokens, of 4 otherwise."""
    return ids.astype("<u2" if n <= 1 << 16 else "<u4").tobytes()


def unpack_ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if n <= 1 << 16 else "<u4")
