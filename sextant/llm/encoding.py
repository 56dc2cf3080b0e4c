"""Token ids by the tokenizers library, with a cache of the pieces between blanks.

A text is cut before every blank that stands between two characters that are no white space. Both supported
pre-tokenizers end a pre-token there whatever follows, so the ids of the pieces, one after the other, are the ids
of the text. A block of texts is cut by Arrow, and each distinct piece of it is looked up once. Texts where a blank touches other white
space are cut at white-space runs instead; texts with characters on whose class Python and the library differ, or
with the content of an added token in them, are encoded whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import threading
import time
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_ODD = "\x1c-\x1f"
#: White space other than the blank.
_OTHER = "\\t\\n\\v\\f\\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_TOUCHING = f"[ {_OTHER}] | [{_OTHER}]|^ | $"
_RUNS = re.compile(r"\s*\S+|\s+")
# The published pre-tokenizer patterns of the two vocabularies.
_BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD_END = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Marks at the end of a piece that are one pre-token after letters.
_MARKS = "!,.;:?#$%&*"


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Encoder:
    """Encodes texts to ids; once ``capacity`` pieces are remembered, only those of the last block stay."""

    def __init__(self, path: str, capacity: int = 500_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.capacity, self.used = self.tok.model, capacity, time.monotonic()
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.whole = "(?i)" + "|".join([f"[{_ODD}]", *added])
        self.words = self.tok.normalizer is not None
        self.to_alphabet = {k: v for k, v in _byte_alphabet().items()}
        self._reset()

    def _reset(self) -> None:
        self.flat, self.start, self.size = array("I"), array("q"), array("i")
        self.parts: dict[str, int] = {}
        self.inner, self.first = _Pieces(self, " "), _Pieces(self, "")

    def _shrink(self, pieces: list[str]) -> None:
        """Forgets all pieces but these."""
        old = {p: self.inner[p] for p in pieces if p in self.inner}
        flat, start, size = self.flat, self.start, self.size
        self._reset()
        for p, at in old.items():
            self.inner[p] = self.add(flat[start[at] : start[at] + size[at]])

    def _parts(self, piece: str) -> list[str]:
        """Pre-tokens of a piece of Latin-1 characters."""
        if self.words:
            piece = unicodedata.normalize("NFC", piece).lower()
        lead = " " if piece[:1] == " " else ""
        body = piece[len(lead) :]
        core = body.rstrip(_MARKS)
        if core.isalpha():
            head = core if self.words else lead + core
            return [head, body[len(core) :]] if len(core) < len(body) else [head]
        return (_WORD_END if self.words else _BYTE_LEVEL).findall(piece)

    def _part(self, part: str) -> int:
        """Where the ids of a pre-token lie in the flat store."""
        if (at := self.parts.get(part)) is None:
            mapped = part.replace(" ", "\u0120") if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.to_alphabet)
            self.parts[part] = at = self.add([t.id for t in self.model.tokenize(mapped)])
        return at

    def place(self, piece: str) -> int:
        """Where the ids of a piece lie in the flat store; a piece that is one pre-token shares its place."""
        if not piece.isascii() and max(piece) >= "Ā":
            return self.add(self.tok.encode(piece, add_special_tokens=False).ids)
        places = [self._part(p) for p in self._parts(piece)]
        if len(places) == 1:
            return places[0]
        return self.add([i for p in places for i in self.flat[self.start[p] : self.start[p] + self.size[p]]])

    def learn(self, pieces: list[str]) -> None:
        """Remembers new pieces after a blank: at once those of letters and marks at their end, as most are; the others by ``place``."""
        inner, parts, flat, start, size = self.inner, self.parts, self.flat, self.start, self.size
        for piece in pieces:
            if piece in inner:
                continue
            core = piece.rstrip(_MARKS)
            if not core.isalpha() or not (piece.isascii() or max(piece) < "Ā"):
                inner[piece] = self.place(" " + piece)
                continue
            head = core.lower() if self.words else " " + core
            if (at := parts.get(head)) is None:
                at = self._part(head)
            if len(core) < len(piece):
                tail = piece[len(core) :]
                if (end := parts.get(tail)) is None:
                    end = self._part(tail)
                a, b, n = start[at], start[end], len(flat)
                flat.extend(flat[a : a + size[at]])
                flat.extend(flat[b : b + size[end]])
                at = len(size)
                start.append(n)
                size.append(len(flat) - n)
            inner[piece] = at

    def add(self, ids: list[int]) -> int:
        self.start.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)
        return len(self.size) - 1

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces at these places, one after the other, and where each one ends."""
        flat, start, size = (np.frombuffer(x, k) if len(x) else np.zeros(0, k) for x, k in ((self.flat, np.uint32), (self.start, np.int64), (self.size, np.int32)))
        n = size[at].astype(np.int64)
        ends = np.cumsum(n)
        return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[at] - (ends - n), n)], ends

    def encode(self, texts) -> list[np.ndarray]:
        """Ids of each text (an Arrow string array or a list), as unsigned 32-bit arrays; null is the empty text."""
        self.used = time.monotonic()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return []
        whole, touching = (pc.match_substring_regex(texts, x) for x in (self.whole, _TOUCHING))
        apart = pc.or_(whole, touching)
        lists = pc.split_pattern(pc.if_else(apart, "", texts), " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets, pieces = offsets - offsets[0], coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist
        if len(self.inner) + len(self.first) > self.capacity:
            self._shrink(pieces)
        self.learn(pieces)
        codes = coded.indices.to_numpy()
        at = np.fromiter(map(self.inner.__getitem__, pieces), np.int64, len(pieces))[codes]
        at[offsets[:-1]] = [self.first[pieces[k]] for k in codes[offsets[:-1]].tolist()]
        ids, ends = self._gather(at)
        bounds = np.concatenate([[0], ends])[offsets].tolist()
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        for k in np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist():
            text = texts[k].as_py()
            if whole[k].as_py():
                out[k] = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                runs = _RUNS.findall(text)
                out[k] = self._gather(np.fromiter(map(self.first.__getitem__, runs), np.int64, len(runs)))[0]
        return out


class _Pieces(dict):
    """Piece -> index into the encoder's flat store; ``lead`` stands before every piece."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, piece: str) -> int:
        self[piece] = at = self.encoder.place(self.lead + piece)
        return at


_ENCODERS: dict[str, Encoder] = {}
#: Seconds after its last use in which an encoder goes, so that idle workers hold no memory that other stages need.
IDLE = 3


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker; it lives until the worker has been idle for ``IDLE`` seconds."""
    if (enc := _ENCODERS.get(path)) is None:
        _ENCODERS[path] = enc = Encoder(path)
        threading.Thread(target=_expire, args=(path,), daemon=True).start()
    enc.used = time.monotonic()
    return enc


def _expire(path: str) -> None:
    """Waits until an encoder has been idle, then drops it and gives its memory back to the system."""
    while (left := _ENCODERS[path].used + IDLE - time.monotonic()) > 0:
        time.sleep(left)
    del _ENCODERS[path]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def batches(column: pa.Array, most: int = 4 << 20):
    """(first row, texts) of an Arrow string column in blocks of about ``most`` bytes."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)), 0
    while at < len(column):
        upto = min(len(column), 1 + int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)))
        yield at, column.slice(at, upto - at)
        at = upto


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
