"""SentencePiece encoding with byte offsets into the original text, and decoding.

The normaliser is run here, not in the library: at each place of the text the longest prefix that the
model's compiled character map holds is replaced, and every byte of the result keeps the place of the
original bytes it came from. White space is then trimmed, escaped and prefixed as the model's settings say.
The library encodes the normalised text, with its own normaliser switched off, and every piece's bytes are
projected back to a span of bytes of the original text.

The compiled map is a double array: a byte leads from unit ``i`` to ``i ^ offset ^ byte`` if that unit has
the byte as its label; the value of a leaf is the place of the replacement in a block of NUL-ended strings.

Encoding works on distinct chunks through a bounded table: a chunk ends before the space mark that follows
another character, which no piece can span as long as no piece of the model has the mark inside (this is
checked; otherwise the whole text is one chunk).

Defined cases: null text is empty and has no ids; decoding no ids gives the empty text. Texts of any length
are handled whole. Rows, repeated or not, are independent; an empty table gives no rows. ``encode_pieces``
keeps every input column and fails on a clash with its output names; ``pieces_report`` reads only doc_id and text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from binwright.llm.common import id_and_text, ship

MARK = "▁"  # stands for a space in pieces
CHUNK_START = re.compile(f"(?<=[^{MARK}])(?={MARK})")
CACHED_CHUNKS = 300_000  # per Python worker; emptied when full


class CharacterMap:
    """Longest-prefix replacement by a model's compiled character map."""

    def __init__(self, blob: bytes):
        self.units, self.strings = (), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.strings = blob[4 + size :]
        self.starts = frozenset(b for b in range(256) if self._step(self._offset(self.units[0]), b)) if self.units else frozenset()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _step(self, at: int, byte: int) -> tuple[int, int] | None:
        """The unit that ``byte`` leads to, and its place."""
        place = at ^ byte
        unit = self.units[place] if place < len(self.units) else 0
        return (unit, place) if unit & (0x80000000 | 0xFF) == byte else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest mapped prefix of ``text[at:]``."""
        found, base = None, self._offset(self.units[0])
        for i in range(at, len(text)):
            step = self._step(base, text[i])
            if step is None:
                break
            unit, place = step
            base = place ^ self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[base] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[value : self.strings.index(b"\0", value)]
        return found

    def apply(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The mapped text and, per byte of it and for its end, the place in ``text`` it came from."""
        if not self.starts:
            return text, np.arange(len(text) + 1)
        out, places, at = bytearray(), [], 0
        while at < len(text):
            hit = self.longest(text, at) if text[at] in self.starts else None
            n, new = hit or (_width(text[at]), None)
            new = text[at : at + n] if new is None else new
            out += new
            places += [at] * len(new)
            at += n
        return bytes(out), np.array([*places, len(text)], np.int64)


def _width(lead: int) -> int:
    """Bytes of the character that starts with this byte."""
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class PieceCodec:
    """A model's normaliser, encoder and decoder."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec.Clear()
        spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        inside = any(MARK in p.piece[1:] and p.piece.strip(MARK) for p in proto.pieces)
        self.cut = not inside and not self.suffix and self.escape and all(p.type != 4 for p in proto.pieces)
        # Bytes that an ordinary piece (type 1) covers, or minus the value of a byte (6); of others the library tells.
        self.lengths = [
            len(p.piece.encode()) if p.type == 1 else -int(p.piece[1:-1], 16) if p.type == 6 else None for p in proto.pieces
        ]
        self.known: dict[str | tuple[str], tuple[bytes, bytes, str]] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The text that pieces cover and, per byte of it and for its end, the byte of ``text`` it came from."""
        new, places = self.map.apply(text.encode("utf-8", "surrogatepass"))
        if self.trim:
            new, places = _trimmed(new, places, self.escape)
        if not new:
            return "", np.zeros(1, np.int64)
        space = MARK.encode() if self.escape else b" "
        if self.prefix:  # the added mark has the place of what it stands before
            new, places = (new + b" ", np.append(places, places[-1])) if self.suffix else (b" " + new, np.append(places[:1], places))
        if self.escape:
            wide = np.where(np.frombuffer(new, np.uint8) == 32, len(space), 1)
            places = np.append(np.repeat(places[:-1], wide), places[-1])
            new = new.replace(b" ", space)
        return new.decode("utf-8", "surrogatepass"), places

    def keys(self, normal: str) -> list[str | tuple[str]]:
        """The chunks of a normalised text: one that starts with the mark without it, another in a tuple."""
        if not self.cut:
            return [(normal,)] if normal else []
        first, *words = normal.split(MARK)
        if first or "" in words:  # no mark at the start, or several marks in a row
            return [c[1:] if c[0] == MARK else (c,) for c in CHUNK_START.split(normal) if c]
        return words

    def learn(self, cut: list[list[str | tuple[str]]]) -> None:
        """Make sure that all these chunks are in the table: ids and piece lengths as bytes, ids as decimal text."""
        known = self.known
        new = list({c for cs in cut for c in cs if c not in known})
        if len(known) + len(new) > CACHED_CHUNKS:
            known.clear()
            new = list({c for cs in cut for c in cs})
        chunks = [c[0] if isinstance(c, tuple) else MARK + c for c in new]
        for key, chunk, ids in zip(new, chunks, self.plain.encode(chunks, num_threads=1) if new else [], strict=True):
            lengths = self._lengths(chunk, ids)
            known[key] = struct.pack(f"={len(ids)}i", *ids), struct.pack(f"={len(ids)}q", *lengths), ",".join(map(str, ids))

    def _lengths(self, chunk: str, ids: list[int]) -> list[int]:
        """Bytes of the chunk that each piece covers; of the byte pieces of one character, the last covers it."""
        out, left, width = [], 0, 0
        for i in ids:
            n = self.lengths[i]
            if n is None:
                return np.diff([p.end for p in self.plain.encode(chunk, return_type="proto").pieces], prepend=0).tolist()
            if n <= 0:  # a byte: minus its value
                left = left or (width := _width(-n))
                left -= 1
                n = 0 if left else width
            out.append(n)
        return out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
        """Per text: ids, first byte and end byte of each piece in the original, and the ids as decimal text."""
        normal = [self.normalise(t) for t in texts]
        cut = [self.keys(n) for n, _ in normal]
        self.learn(cut)
        out = []
        for (_, places), keys in zip(normal, cut, strict=True):
            ids, lengths, words = zip(*map(self.known.__getitem__, keys), strict=True) if keys else ((), (), ())
            ends = np.cumsum(np.frombuffer(b"".join(lengths), np.int64))
            starts = np.concatenate((np.zeros(1, np.int64), ends))[:-1]
            out.append((np.frombuffer(b"".join(ids), np.int32), places[starts], places[ends], ",".join(words)))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids) if ids else ""


def _trimmed(text: bytes, places: np.ndarray, escape: bool) -> tuple[bytes, np.ndarray]:
    """Without spaces at either end (nor marks at the end), and with one space for each run of them."""
    data = np.frombuffer(text, np.uint8)
    space = data == 32
    keep = ~space | (~np.append(True, space[:-1]) & ~np.logical_and.accumulate(space[::-1])[::-1])
    last = np.flatnonzero(keep)
    new, places = data[keep].tobytes(), np.append(places[:-1][keep], places[last[-1] + 1] if len(last) else 0)
    while escape and (cut := new.rstrip(b" ").removesuffix(MARK.encode())) != new:
        new, places = cut, places[: len(cut) + 1]
    return new, places


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    with open(path, "rb") as f:
        return PieceCodec(f.read())


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with ids, starts and ends (arrays of the same length; bytes of the original text)."""
    ship(docs.sparkSession)
    if clash := {"ids", "starts", "ends"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(model)
        for batch in _small(batches):
            rows = work.encode([t or "" for t in batch.column("text").to_pylist()])
            made = [
                pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                pa.array([r[2] for r in rows], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "ids", "starts", "ends"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, ids array<int>, starts array<bigint>, ends array<bigint>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with its ``ids`` decoded to ``decoded``."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(model)
        for batch in _small(batches):
            texts = [work.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded string")


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pieces_report(docs: DataFrame, model: str) -> DataFrame:
    """Digests of ids, spans and decoded text, made in the pass that encodes: long arrays stay in the worker."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, hexed = codec(model), lambda b: hashlib.sha256(b).hexdigest()
        for batch in _small(batches):
            rows = work.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(r[0]) for r in rows], pa.int64()),
                "ids_sha256": [hexed(r[3].encode()) for r in rows],
                "decoded_sha256": [hexed(work.decode(r[0].tolist()).encode("utf-8", "surrogatepass")) for r in rows],
                "covered_bytes": pa.array([int((r[2] - r[1]).sum()) for r in rows], pa.int64()),
            })

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long"
    return id_and_text(docs).mapInArrow(run, schema)
