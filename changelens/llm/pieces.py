"""SentencePiece encoding and decoding with the original byte span of every piece.

Texts are normalised here, by longest-prefix matching through the model's compiled character map (a double-array trie and the replacement
strings), and every normalised byte remembers the source byte it came from.  The normalised text is encoded by the `sentencepiece` library
under the same model without its normaliser; the pieces tile the normalised text, so the remembered places project each onto source bytes.

A merge never joins across a place where no piece of the vocabulary could lie.  Where the vocabulary has no piece with the space symbol after
another character, a text is therefore encoded word by word, each distinct word once, with the same ids as a whole text has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.memo import Memo, runs

SPACE = "\u2581"
_SPACE = SPACE.encode()
#: Texts encoded together at most, and their bytes unless one text alone has more.
TEXTS, SOURCE = 128, 1 << 20
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(blob: bytes) -> Iterator[tuple[int, int, bytes | int, bytes]]:
    """(number, wire type, value, whole field) of each field of a protocol-buffer message."""
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = blob[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(blob):
        start = at
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = blob[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = blob[at : at + size], at + size
        yield tag >> 3, kind, value, blob[start:at]


class CharMap:
    """A compiled character map: longest matching source prefix to its replacement."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key that `text` has at `at`."""
        units = self.units
        if not units:
            return None
        best = None
        node = self._child(units[0], 0)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node = self._child(unit, node)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.strings[best[1] : self.strings.index(b"\0", best[1])]

    @staticmethod
    def _child(unit: int, node: int) -> int:
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))


class Pieces:
    """A model file: normalisation with alignment, encoding with spans, decoding."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            blob = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.pieces: list[tuple[str, int]] = []
        self.dummy = self.squeeze = self.escape = True
        charmap, rest, suffix = b"", [], False
        for number, _, value, whole in _fields(blob):
            if number == 1:
                got = {k: v for k, _, v, _ in _fields(value)}
                self.pieces.append((got.get(1, b"").decode(), got.get(3, NORMAL)))
            if number == 2:
                suffix = bool({k: v for k, _, v, _ in _fields(value)}.get(24, 0))
            if number == 3:
                got = {k: v for k, _, v, _ in _fields(value)}
                charmap, self.dummy, self.squeeze, self.escape = got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1))
            elif number != 4:
                rest.append(whole)
        if suffix:
            raise ValueError("models that put the space symbol after a word are not supported")
        self.map = CharMap(charmap)
        # a normaliser that changes nothing: no map, no added prefix, no squeezed or escaped spaces
        inner = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=b"".join(rest) + b"\x1a" + bytes([len(inner)]) + inner)
        user = sorted((p for p, kind in self.pieces if kind == USER), key=len, reverse=True)
        self.user = re.compile(b"|".join(re.escape(p.encode()) for p in user)) if user else None

        usual = [p for p, kind in self.pieces if kind in (NORMAL, USER)]
        # signs that stand side by side in some piece; a merge never crosses between two that don't.  Space stands for the space symbol
        # here, and all bytes beyond ASCII count as joined with everything.
        self.joined = np.zeros((256, 256), bool)
        self.joined[128:] = self.joined[:, 128:] = True
        for p in usual:
            b = p.replace(SPACE, " ").encode()
            self.joined[list(b[:-1]), list(b[1:])] = True
        self.by_word = self.escape and {p for p, kind in self.pieces if kind == BYTE} >= {f"<0x{b:02X}>" for b in range(256)} \
            and SPACE in usual and not self.joined[:128, 10].any() and not self.joined[10, :128].any() and not any(SPACE in p.lstrip(SPACE) for p in usual)
        self.memo = Memo(self._words, "<i4")
        self.sizes = np.array([1 if kind == BYTE else len(p.encode()) for p, kind in self.pieces], np.int64)
        self.numbers = [str(i) for i in range(len(self.pieces))]

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words and the count of each: all encoded in one call between line ends, which no piece joins with anything."""
        words = [w.replace(b" ", _SPACE) for w in words]
        ids = np.array(self.raw.encode(b"\n".join(words).decode(), num_threads=1), "<i4")
        ends = np.cumsum(self.sizes[ids])
        last = np.searchsorted(ends, np.cumsum([len(w) + 1 for w in words]) - 1, "right")
        inside = np.ones(len(ids), bool)
        inside[last[:-1]] = False  # the line ends
        return ids[inside], np.diff(np.append(-1, last)) - 1

    def _by_word(self, normal: list[bytes]) -> list[np.ndarray]:
        """The ids of normalised texts, word by word: a word begins where no piece could lie across."""
        spaced = [n.replace(_SPACE, b" ") for n in normal]
        sizes = np.array([len(s) for s in spaced])
        buffer = b"".join(spaced)
        raw = np.frombuffer(buffer, np.uint8)
        begins = np.append(True, ~self.joined[raw[:-1], raw[1:]])[: len(raw)]
        # beyond ASCII: spaces after another character and line ends part words all the same
        begins[1:] |= ((raw[1:] == 32) & (raw[:-1] != 32)) | (raw[1:] == 10) | (raw[:-1] == 10)
        tops = np.cumsum(sizes) - sizes
        begins[tops[sizes > 0]] = True
        starts = np.flatnonzero(begins)
        ids, counts = self.memo.ids(buffer, starts, np.diff(np.append(starts, len(raw))))
        total = np.append(0, np.cumsum(counts))[np.searchsorted(starts, np.append(tops, len(raw)))]
        return [ids[a:b] for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True)]

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and bytes of normalised text of each piece."""
        ids, pieces = self.raw.encode(text), self.raw.encode(text, out_type=str)
        return np.array(ids, "<i4"), np.array([1 if self.pieces[i][1] == BYTE else len(p.encode()) for i, p in zip(ids, pieces, strict=True)], np.int64)

    def normalize(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and the source byte of each of its bytes and of its end."""
        if not self.map.units and not self.squeeze and self.user is None:
            return self._plain(text)
        out, where, at, spaced = bytearray(), [], 0, self.squeeze
        if self.squeeze:
            while at < len(text) and (found := self._prefix(text, at))[1] == b" ":
                at += found[0]
        space = _SPACE if self.escape else b" "
        if at == len(text):
            return b"", np.zeros(1, np.int64)
        if self.dummy:
            out += space
            where += [at] * len(space)
        while at < len(text):
            size, got, fixed = self._prefix(text, at)
            while spaced and got.startswith(b" "):
                got = got[1:]
            for c in got:
                out += space if c == 32 and not fixed else bytes([c])
                where += [at] * (len(space) if c == 32 and not fixed else 1)
            spaced = got.endswith(b" ") if got else spaced
            at += size
            spaced = spaced and self.squeeze
        end = at
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                end = where[len(out)]
                del where[len(out) :]
        return bytes(out), np.array([*where, end], np.int64)

    def _prefix(self, text: bytes, at: int) -> tuple[int, bytes, bool]:
        if self.user and (m := self.user.match(text, at)):
            return len(m.group()), m.group(), False
        if found := self.map.longest(text, at):
            return *found, False
        lead = text[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, text[at : at + size], False

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Without a character map only spaces change: one byte becomes the bytes of the space symbol."""
        if not text:
            return b"", np.zeros(1, np.int32)
        space = _SPACE if self.escape else b" "
        wide = np.where(np.frombuffer(text, np.uint8) == 32, len(space), 1)
        where = np.repeat(np.arange(len(text), dtype=np.int32), wide)
        head = len(space) * self.dummy
        return space * self.dummy + text.replace(b" ", space), np.concatenate([np.zeros(head, np.int32), where, np.array([len(text)], np.int32)])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text: ids, and the n+1 source byte places between which its n pieces lie."""
        normal = [self.normalize(t.encode("utf-8", "replace")) for t in texts]
        coded: list = [None] * len(texts)
        # the space symbol and a plain space look alike after the other's replacement, so texts that hold both are encoded whole
        plain = [i for i, (n, _) in enumerate(normal) if self.by_word and b" " not in n]
        for some in runs([normal[i][0] for i in plain]):
            for i, ids in zip(plain[some], self._by_word([normal[i][0] for i in plain[some]]), strict=True):
                coded[i] = ids, self.sizes[ids]
        coded = [c or self._whole(n.decode()) for c, (n, _) in zip(coded, normal, strict=True)]
        return [(ids, where[np.append(0, np.cumsum(sizes)).astype(np.int64)]) for (ids, sizes), (_, where) in zip(coded, normal, strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """(id_col, ids array<int> with the end id last, places array<int>, decoded string) for every row of `docs`.

    `places` has one entry more than there are pieces: piece i comes from the source bytes places[i] to places[i+1] (a byte-fallback piece
    inside a character has an empty span at the character's start, but for the last byte).  The end id has no span.  Null texts are encoded like empty ones:
    the end id alone.  Rows keep their id, null or repeated, and none is dropped; other columns are not read.
    """
    return _run(docs, model, id_col, text_col, [("ids", "array<int>", pa.list_(pa.int32()), lambda p, ids, places: np.append(ids, p.library.eos_id())),
                                                ("places", "array<int>", pa.list_(pa.int32()), lambda p, ids, places: places)]
                + [("decoded", "string", pa.string(), lambda p, ids, places: p.decode([*ids.tolist(), p.library.eos_id()]))] * decoded)


def encode_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same encoding as text for digests: (id_col, n_tokens, id_list: decimal ids joined by a space, decoded, tiled boolean).

    `tiled`: the spans cover the source from its first byte to its last in order.
    """
    def listed(p: Pieces, ids: np.ndarray, places: np.ndarray) -> str:
        return " ".join([p.numbers[i] for i in ids] + [str(p.library.eos_id())])

    return _run(docs, model, id_col, text_col, [
        ("n_tokens", "long", pa.int64(), lambda p, ids, places: len(ids) + 1),
        ("id_list", "string", pa.string(), listed),
        ("decoded", "string", pa.string(), lambda p, ids, places: p.decode([*ids.tolist(), p.library.eos_id()])),
        ("tiled", "boolean", pa.bool_(), lambda p, ids, places: bool((np.diff(places) >= 0).all()))])


def _cuts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of consecutive texts that are encoded together."""
    first = held = 0
    for i, size in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if i > first and (i - first == TEXTS or held + size > SOURCE):
            yield first, i - first
            first, held = i, 0
        held += size
    if len(texts):
        yield first, len(texts) - first


def _run(docs: DataFrame, model: str, id_col: str, text_col: str, wanted: list[tuple]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = None
        for batch in batches:
            pieces = pieces or Pieces(model)
            for first, size in _cuts(batch.column(1)):
                part = batch.slice(first, size)
                coded = pieces.encode([t or "" for t in part.column(1).to_pylist()])
                columns = [pa.array([make(pieces, *c) for c in coded], kind) for _, _, kind, make in wanted]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [id_col, *[w[0] for w in wanted]])

    slim = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return slim.mapInArrow(run, ", ".join([f"`{id_col}` long", *[f"{name} {kind}" for name, kind, _, _ in wanted]]))
