"""Token ids as flat binary files with 64-bit document offsets, read back memory-mapped.

File format, per shard ``shard-NNNNNN`` in one folder:

- ``.bin``: the ids of all documents one after the other, little-endian, 16 bits wide if the vocabulary
  allows it and else 32;
- ``.off``: unsigned 64-bit offsets into the shard in ids, one per document and one for the end;
- ``.doc``: signed 64-bit doc_id per document.

Shards are ranges of ascending ``doc_id``; a shard's ids start, in the whole corpus, at the sum of the ids
of the shards before it. These bases are prefix sums over one row per shard (the manifest).

Each task writes temporary names and renames them at its end, so a repeated task puts the same file in the
same place. The folder must be one that all executors see (``spark.checkpoint.dir``).

Defined cases: null text is empty (just the end id). A row with a null ``doc_id`` comes first and back as
null. Repeated ids are in order of their text. An empty table has no shards and gives no rows. Other
columns of the input are not read.

Encoding calls the tokenizer for each distinct chunk once and keeps the ids in a bounded table. A chunk ends
before a single space between two characters that are not white space; there the pre-tokenizer of a
byte-level BPE always starts a new token, so chunk ids joined are the ids of the text.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binwright.llm.common import NO_ID, id_and_text, ship, stored
from binwright.session import scratch_path

CACHED_CHUNKS = 1_000_000  # per Python worker; emptied when full
LOT = 500  # chunks encoded in one call
PORTION = 64  # texts encoded at once
BETWEEN = "\0"
MARKS = ".,;:!?#$%&*"
ENDS = frozenset(MARKS)
TWO_SPACES = re.compile(r"\s\s")
CHUNK = re.compile(r"(?<=\S) (?=\S)")


class ChunkEncoder:
    """Ids of texts as bytes of one width, through a bounded table of chunks.

    A key is a word after a space, or in a tuple a chunk as it is. New words are cut once more, where a letter is
    followed by marks only, and the rest is encoded in lots: chunks in a row, with a character between them that is
    in no merge and so stays a token of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(True) <= 2**16 else "<u4")
        self.between = self._ids(BETWEEN)
        (symbol,) = {p for p, i in self.tokenizer.get_vocab(True).items() if [i] == self.between.tolist()} or {""}
        alone = symbol and not any(symbol in p for p in self.tokenizer.get_vocab(True) if p != symbol)
        self.lot = LOT if alone else 1
        self.alphabet = _byte_alphabet()
        self.plain = self._plain()
        self.packed = {i: int(i).to_bytes(self.dtype.itemsize, "little") for i in self.tokenizer.get_vocab(True).values()}
        self.known: dict[str | tuple[str], bytes] = {}

    def _plain(self) -> bool:
        """Whether the tokenizer is byte-level merges alone, without a normaliser or an added first space."""
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        added = any(t["content"].strip().isalpha() for t in spec["added_tokens"])
        return pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec["normalizer"] and not added

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts, a few texts at a time: so their chunks are still near the processor when they are joined."""
        return [ids for at in range(0, len(texts), PORTION) for ids in self.encode(texts.slice(at, PORTION).to_pylist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        keys, known = [_keys(t) for t in texts], self.known
        found = [list(map(known.get, ks)) for ks in keys]  # looked up once; only what is missing is looked up again
        new = {c for ks, ids in zip(keys, found, strict=True) if None in ids for c, x in zip(ks, ids, strict=True) if x is None}
        if len(known) + len(new) > CACHED_CHUNKS:
            known.clear()
        cut = {c: parts for c in new if c[-1:] in ENDS and (parts := _stem_and_marks(c))}  # no tuple is in ENDS
        self._learn([c for c in {*(new - cut.keys()), *(p for parts in cut.values() for p in parts)} if c not in known])
        for c, (stem, marks) in cut.items():
            known[c] = known[stem] + known[marks]
        for ks, ids in zip(keys, found, strict=True):
            if None in ids:
                ids[:] = [known[c] if x is None else x for c, x in zip(ks, ids, strict=True)]
        return [b"".join(ids) for ids in found]

    def _learn(self, new: list[str | tuple[str]]) -> None:
        # after a space and with no white space at the end, a chunk's tokens don't depend on what stands around it
        tokenize, packed, space = self.tokenizer.model.tokenize, self.packed, " ".translate(self.alphabet)
        for c in new:
            if self.plain and isinstance(c, str) and c.isalpha():  # a space and letters: one word for the merges
                if c.isascii():  # these letters stand for themselves
                    word = space + c
                elif ord(max(c)) < 0x250:
                    word = (" " + c).encode().decode("latin-1").translate(self.alphabet)
                else:
                    continue
                self.known[c] = b"".join([packed[t.id] for t in tokenize(word)])
        new = [c for c in new if c not in self.known]
        alike = [c for c in new if isinstance(c, str) and c and not c[-1].isspace() and BETWEEN not in c] if self.lot > 1 else []
        for at in range(0, len(alike), self.lot):
            lot = alike[at : at + self.lot]
            ids = self._ids(BETWEEN.join(" " + c for c in lot))
            found = np.split(ids, np.flatnonzero(ids == self.between[0]))
            self.known.update((c, (x[1:] if i else x).tobytes()) for i, (c, x) in enumerate(zip(lot, found, strict=True)))
        rest = [c for c in new if c not in self.known]
        for at in range(0, len(rest), LOT):  # texts of their own, in one call
            lot = rest[at : at + LOT]
            ids = self.tokenizer.encode_batch_fast([c[0] if isinstance(c, tuple) else " " + c for c in lot], add_special_tokens=False)
            self.known.update((c, np.array(x.ids, self.dtype).tobytes()) for c, x in zip(lot, ids, strict=True))


def _byte_alphabet() -> dict[int, int]:
    """The characters that stand for bytes: printable ones for themselves, others from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def _keys(text: str) -> list[str | tuple[str]]:
    """The text cut before each single space between characters that are not white space."""
    first, *words = text.split(" ")
    if not text or first and not first[0].isspace() and words and words[-1] and not TWO_SPACES.search(text):
        return [(first,), *words] if text else []
    first, *rest = CHUNK.split(text)
    return [(first,), *rest]


def _stem_and_marks(word: str) -> tuple[str, tuple[str]] | None:
    """A word that is letters at the end but for marks, cut between the two; the pre-tokenizer cuts there too."""
    stem = word.rstrip(MARKS)
    if stem and len(stem) < len(word) and stem[-1].isalpha() and ord(stem[-1]) < 0x250:
        return stem, (word[len(stem) :],)
    return None


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def local_path(folder: str) -> str:
    """The path of a folder in a mounted file system; other stores can't be memory-mapped."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"token files need a shared folder that is mounted, not {folder}")
    return unquote(url.path)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2) -> DataFrame:
    """Write the shards to ``folder``; the manifest: shard, n_docs, n_tokens, base, width."""
    spark = docs.sparkSession
    ship(spark)
    root = local_path(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        end = np.array([end_id], code.dtype).tobytes()
        shard, width = TaskContext.get().partitionId(), code.dtype.itemsize
        name, own = f"{root}/shard-{shard:06d}", f".{uuid.uuid4().hex}"
        n, total = 0, 0
        os.makedirs(root, exist_ok=True)
        with open(f"{name}.bin{own}", "wb") as ids, open(f"{name}.off{own}", "wb") as offsets, open(f"{name}.doc{own}", "wb") as names:
            for batch in batches:
                encoded = code.encode_column(batch.column("text"))
                lengths = np.array([len(e) // width + 1 for e in encoded], np.int64)
                ids.write(b"".join(e + end for e in encoded))
                offsets.write((total + np.cumsum(lengths) - lengths).astype("<u8").tobytes())
                names.write(np.array([NO_ID if x is None else x for x in batch.column("doc_id").to_pylist()], "<i8").tobytes())
                n, total = n + len(encoded), total + int(lengths.sum())
            offsets.write(np.array([total], "<u8").tobytes())
        for kind in ("bin", "off", "doc"):
            if n:
                os.replace(f"{name}.{kind}{own}", f"{name}.{kind}")
            else:
                os.remove(f"{name}.{kind}{own}")
        if n:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n], "n_tokens": [total], "width": [width]})

    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = stored(ordered.mapInArrow(write, "shard long, n_docs long, n_tokens long, width long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard, not per document
    return shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """From the files alone: doc_id, start (in the corpus), n_tokens, ids_crc32 (ids as 32-bit values)."""
    root = local_path(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{root}/shard-{row['shard']:06d}"
                ids = np.memmap(f"{name}.bin", f"<u{row['width']}", "r")
                offsets = np.memmap(f"{name}.off", "<u8", "r").astype(np.int64)
                names = np.memmap(f"{name}.doc", "<i8", "r")
                if len(names) != row["n_docs"] or len(ids) != row["n_tokens"] or offsets[-1] != len(ids):
                    raise ValueError(f"{name} does not hold what the manifest says")
                for at in range(0, len(names), 2048):
                    bounds = offsets[at : at + 2049]
                    crcs = [
                        zlib.crc32(ids[a:b].astype("<u4").tobytes())
                        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
                    ]
                    part = np.asarray(names[at : at + 2048])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(part, mask=part == NO_ID),
                        "start": bounds[:-1] + row["base"], "n_tokens": np.diff(bounds), "ids_crc32": crcs,
                    })

    # One shard is what one task wrote, so it is also what one task can read.
    n = max(1, manifest.count())
    return manifest.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_report(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode, write, and return what the files say."""
    folder = scratch_path(docs.sparkSession, "token_files")
    return read_token_files(write_token_files(docs, tokenizer, folder, end_id), folder)
