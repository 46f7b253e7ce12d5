"""Exact, cached byte-level BPE encoding of whole texts."""

from __future__ import annotations

import gc
import json
import os
import re
import sys
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from quillframe.llm.common import claim

#: Bytes, about, of the pieces whose ids (or numbers of ids) a Python worker remembers before it starts anew; up to twice as many are held.
CACHE_BYTES, COUNTED_CACHE_BYTES = 96 << 20, 32 << 20
#: Bytes of a remembered piece beside its characters and ids, and beside its characters where only ids are counted.
PIECE_BYTES, COUNTED_BYTES = 180, 140

#: Line ends and spaces between two other characters.
_LINE_END = re.compile(r"(?<=\S)\n(?=\S)")
_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Characters, about, of the texts that are cut at once.
RUN_CHARS = 8 << 20
#: Kinds of bytes; words with another one are not cut inside.
_LETTER, _DIGIT, _MARK, _OTHER, _SPACE_KIND, _LINE = range(6)


def pieces_are_safe(spec: dict) -> bool:
    """Whether a tokenizer's ids of a text are those of its pieces cut at single spaces and line ends.

    The byte-level pattern only joins a space to what follows it, and a line end
    between two other characters is a part of its own, so no token crosses
    either; normalizers, post-processors or special tokens with white space
    could break that.
    """
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (
        pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and model.get("type", "BPE") == "BPE"
        and not model.get("dropout")
        and not model.get("continuing_subword_prefix")
        and not model.get("end_of_word_suffix")
        and model["vocab"].keys() >= set(byte_letters().values())
        and not spec.get("normalizer")
        and not spec.get("post_processor")
        and all(not re.search(r"\s", t["content"]) and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec.get("added_tokens", []))
    )


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def byte_kinds(added: Iterable[str] = ()) -> bytes:
    """The kind of each byte of UTF-8: ASCII, and the letters from À to ÿ, whose first byte is C3.

    Of another kind are all that the byte-level pattern takes in other ways:
    apostrophes, further characters, other white space, and the first byte of
    an added token. (The bytes 97 and B7 after C3 make the signs × and ÷.)
    """
    kinds = bytearray([_OTHER]) * 256
    for b in range(0x21, 0x7F):
        kinds[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK
    for b in (0xC3, *range(0x80, 0xC0)):
        kinds[b] = _LETTER
    for b in (ord("'"), 0x97, 0xB7, *[t.encode()[0] for t in added if t]):
        kinds[b] = _OTHER
    kinds[0x20], kinds[0x0A] = _SPACE_KIND, _LINE
    return bytes(kinds)


class Encoder:
    """Ids of texts as raw little-endian bytes, ``width`` bytes an id; the same ids as ``Tokenizer.encode``.

    Texts are cut in bulk: at spaces and line ends, and inside words of plain
    characters also between letters, digits and marks, as the byte-level
    pattern does. A piece keeps the space before it. Equal pieces of some texts
    are looked up once; ids are remembered in two generations, so that frequent
    ones stay.
    """

    piece_bytes, cache_bytes = PIECE_BYTES, CACHE_BYTES

    def __init__(self, path: str, spec: str | None = None, cache_bytes: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if spec is None:
            with open(path, encoding="utf-8") as f:
                spec = f.read()
        self.tokenizer = Tokenizer.from_str(spec)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.code = "H" if self.width == 2 else "I"
        self.limit, self.held = cache_bytes or self.cache_bytes, 0
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.line_end = self._raw(["\n"])[0]
        spec = json.loads(spec)
        self.safe = pieces_are_safe(spec)
        if self.safe:
            self.model = self.tokenizer.model
            self.sizes = np.zeros(max(spec["model"]["vocab"].values()) + 1, np.int64)
            for token, i in spec["model"]["vocab"].items():
                self.sizes[i] = len(token)
            self.letters = {chr(b): c for b, c in byte_letters().items() if b != 0x0A and chr(b) != c}
            self.kinds = byte_kinds(t["content"] for t in spec.get("added_tokens", []))
            self.plain = bytes(b for b in range(256) if self.kinds[b] not in (_LINE, _OTHER))

    def _raw(self, texts: list[str]) -> list[bytes]:
        ids = [array(self.code, e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for a in ids:
                a.byteswap()
        return [a.tobytes() for a in ids]

    def _raw_parts(self, parts: list[bytes]) -> list[bytes]:
        """Ids of pieces that are one part of the byte-level pattern each."""
        out: list[bytes] = []
        tokenize = self.model.tokenize
        for at in range(0, len(parts), 2000):
            some = parts[at : at + 2000]
            lines = b"\n".join(some).decode("latin-1")
            for c in self.letters.keys() & set(lines):
                lines = lines.replace(c, self.letters[c])
            ids = np.array([t.id for line in lines.split("\n") for t in tokenize(line)], np.int64)
            out += self._split(ids, np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(list(map(len, some))), "right"))
        return out

    def _split(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw, ends = ids.astype(self.dtype).tobytes(), (ends * self.width).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _texts(self, known: list[bytes | None], numbers: np.ndarray, spans: list[np.ndarray]) -> list[bytes]:
        """Of texts given by their first pieces and the ones after their last."""
        ids = pa.array(known, pa.large_binary()).take(pa.array(numbers))
        ends, raw = np.frombuffer(ids.buffers()[1], np.int64), ids.buffers()[2].to_pybytes()
        return [raw[a:b] for a, b in zip(*[ends[s].tolist() for s in spans])]

    def _lines(self, lines: list[list[bytes]]) -> bytes:
        return self.line_end.join(map(b"".join, lines))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.safe:
            return [self._raw([t])[0] for t in texts]
        collects = gc.isenabled()
        gc.disable()  # the many short lists below hold no cycles
        try:
            out, some, size = [], [], 0
            for text in texts:
                some.append(text)
                size += len(text)
                if size >= RUN_CHARS:
                    out += self._some(some)
                    some, size = [], 0
            return out + (self._some(some) if some else [])
        finally:
            if collects:
                gc.enable()

    def _some(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        starts = np.cumsum([1, *[len(t) + 1 for t in raw]])
        data = b"\n".join([b"", *raw, b""])
        del raw
        at, spaced = self._cut(data)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        names, numbers = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        if self.held > self.limit:
            self.old, self.new, self.held = self.new, {}, 0
        known = list(map(self.new.get, names))
        absent = [i for i, ids in enumerate(known) if ids is None]
        if absent:
            self._learn([names[i] for i in absent])
            for i in absent:
                known[i] = self.new.get(names[i])
            unknown = [i for i in absent if known[i] is None]
            if unknown:  # pieces beside other white space
                spaced = np.concatenate([spaced, at[:-1][np.isin(numbers, unknown)]])
        spans = [np.searchsorted(at, starts[:-1]), np.searchsorted(at, starts[1:] - 1)]
        out = self._texts(known, numbers, spans)
        for i in np.unique(np.searchsorted(starts, spaced, "right") - 1).tolist():
            if 0 <= i < len(texts):
                out[i] = self._spaced(texts[i])
        return out

    def _cut(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin, with the end of all; and the places of white space after white space."""
        kinds = np.frombuffer(data.translate(self.kinds), np.uint8)
        begins = kinds[1:] != kinds[:-1]
        begins &= kinds[:-1] != _SPACE_KIND
        white = kinds >= _SPACE_KIND
        other = np.flatnonzero(kinds == _OTHER)
        if len(other):  # their words are whole pieces
            ends = np.flatnonzero(white)
            after = np.unique(np.searchsorted(ends, other))
            inside = np.zeros(len(data) + 1, np.int8)
            inside[ends[after - 1] + 2] += 1
            inside[ends[after]] -= 1
            begins &= np.cumsum(inside, dtype=np.int8)[1:-1] == 0
        at = np.concatenate([[0], np.flatnonzero(begins) + 1, [len(data)]])
        return at, np.flatnonzero(white[1:] & white[:-1]) + 1

    def _spaced(self, text: str) -> bytes:
        """Ids of a text with white space side by side; it is cut only where both neighbours are no white space."""
        lines = [_SPACE.split(line) for line in _LINE_END.split(text)]
        pieces = {("" if i == 0 else " ") + p for line in lines for i, p in enumerate(line)}
        names = list(pieces)
        ids = dict(zip(names, self._raw(names)))
        return self._lines([[ids[("" if i == 0 else " ") + p] for i, p in enumerate(line)] for line in lines])

    def _learn(self, wanted: list[bytes]) -> None:
        """Puts the ids of pieces into ``new``.

        Pieces of white space or with white space at an end stay out: their ids
        depend on what stands beside them.
        """
        self.held += sum(map(len, wanted)) * 2 + self.piece_bytes * len(wanted)
        parts, others = [], []
        for p in wanted:
            ids = self.old.get(p)
            if ids is not None:
                self.new[p] = ids
            elif not p.translate(None, self.plain):
                if p[1:2] != b" ":
                    parts.append(p)
            elif p == b"\n":
                self.new[p] = self.line_end
            else:
                body = p.removeprefix(b" ").decode()
                if not body[0].isspace() and not body[-1].isspace():
                    others.append(p)
        self.new.update(zip(parts, self._raw_parts(parts)))
        self.new.update(zip(others, self._raw([p.decode() for p in others])))


class TokenCounter(Encoder):
    """The numbers of ids of texts; what it remembers of a piece is a number."""

    piece_bytes, cache_bytes = COUNTED_BYTES, COUNTED_CACHE_BYTES

    def _raw(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _split(self, ids: np.ndarray, ends: np.ndarray) -> list[int]:
        return np.diff(ends, prepend=0).tolist()

    def _texts(self, known: list[int | None], numbers: np.ndarray, spans: list[np.ndarray]) -> list[int]:
        ends = np.concatenate([[0], np.cumsum(np.array([n or 0 for n in known])[numbers])])
        return (ends[spans[1]] - ends[spans[0]]).tolist()

    def _lines(self, lines: list[list[int]]) -> int:
        return sum(map(sum, lines)) + self.line_end * (len(lines) - 1)


_encoders: dict[tuple[type, str, int | None], Encoder] = {}


def encoder(path: str, spec: str | None = None, kind: type = Encoder, cache_bytes: int | None = None) -> Encoder:
    """The encoder, or another ``kind``, of this Python process for a tokenizer file; one with another memory gives way to it."""
    claim(f"encode {kind.__name__} {cache_bytes}", _encoders.clear)
    key = kind, path, cache_bytes
    if key not in _encoders:
        _encoders[key] = kind(path, spec, cache_bytes)
    return _encoders[key]


def texts_of(batch: pa.Array) -> list[str]:
    return [t.decode("utf-8", "replace") if t else "" for t in batch.to_pylist()]
