"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of documents in ascending order of their keys, laid end to end, in blocks of
BLOCK ids:

    header   magic b"PFOR", version u32, block length u32
    blocks   minimum u32, width u8, number of outliers u16, ids in the block u16,
             (id - minimum) modulo 2**width packed into `width` bits each (least bit first),
             places of the outliers u16 each, their bits above `width` u32 each
    index    start of every block u64, in order
    footer   number of blocks u64, place of the index u64, magic b"PFOR"

The width is that of the WIDTH_PERCENTILE-th largest difference; ids beyond it are outliers, whose
places and high bits stand in the exception lists. The block index gives random access.

Spark deals the documents out by ranges of the key; every task writes one file in the shared folder
under a name of its own and returns a row of the manifest and one of the document index for each
document. Only files named by rows that Spark committed are read, so lost executors and repeated
tasks do no harm. Defined cases: null and empty texts have the end id alone; equal keys keep a row
each (ordered by text); an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import common
from freshet.session import cut, shared_dir, shuffle_width

MAGIC = b"PFOR"
BLOCK = 1024
WIDTH_PERCENTILE = 99.0
KEPT_IDS = 12_000_000  # ids of encoded words that a task remembers; after that it starts anew
AT_ONCE = 4096  # words encoded at once


def pack_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    over = (ids - low).astype(np.uint64)
    at = min(math.ceil(len(ids) * WIDTH_PERCENTILE / 100), len(ids) - 1)
    width = int(np.partition(over, at)[at]).bit_length()
    far = np.flatnonzero(over >> np.uint64(width)).astype(np.uint16)
    if width == 16:  # packed bits of this width are plain integers
        packed = over.astype("<u2").tobytes()
    else:
        packed = np.packbits(((over[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
    return b"".join((
        struct.pack("<IBHH", low, width, len(far), len(ids)), packed,
        far.astype("<u2").tobytes(), (over[far] >> np.uint64(width)).astype("<u4").tobytes(),
    ))


def unpack_block(data: memoryview | bytes) -> np.ndarray:
    low, width, n_far, n = struct.unpack_from("<IBHH", data)
    at, size = 9, (n * width + 7) // 8
    if width == 16:
        out = np.frombuffer(data, "<u2", n, at).astype(np.uint64)
    else:
        bits = np.zeros((n, 64), np.uint8)
        bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little", count=n * width).reshape(n, width)
        out = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().copy()
    far = np.frombuffer(data, "<u2", n_far, at + size)
    out[far] |= np.frombuffer(data, "<u4", n_far, at + size + 2 * n_far).astype(np.uint64) << np.uint64(width)
    return (out + np.uint64(low)).astype(np.uint32)


class Writer:
    def __init__(self, out) -> None:
        self.out, self.at, self.starts, self.held, self.n_held, self.n = out, 0, [], [], 0, 0
        self._put(MAGIC + struct.pack("<II", 1, BLOCK))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for a in range(0, end, BLOCK):
            self.starts.append(self.at)
            self._put(pack_block(ids[a : min(a + BLOCK, end)]))
        self.held, self.n_held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        index = self.at
        self._put(np.array(self.starts, "<u8").tobytes() + struct.pack("<QQ", len(self.starts), index) + MAGIC)
        self.out.close()


class Reader:
    """Ids of a file by place; blocks are read through the index as they are needed."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - 20)
        n, index = struct.unpack("<QQ", source.read(16))
        if source.read(4) != MAGIC:
            raise ValueError("not a token file")
        source.seek(index)
        self.starts = np.append(np.frombuffer(source.read(8 * n), "<u8"), index).astype(np.int64)
        self.kept: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def _block(self, i: int) -> np.ndarray:
        if self.kept[0] != i:
            self.source.seek(int(self.starts[i]))
            self.kept = (i, unpack_block(self.source.read(int(self.starts[i + 1] - self.starts[i]))))
        return self.kept[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        parts, end = [], start + n
        while start < end:
            i, at = divmod(start, BLOCK)
            part = self._block(i)[at : at + end - start]
            parts.append(part)
            start += len(part)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


# White space beyond ASCII as three bytes of UTF-8, and as two.
_WIDE = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()]
_WIDE_3, _WIDE_2 = (np.array([int.from_bytes(c) for c in _WIDE if len(c) == n], np.int32) for n in (3, 2))
_NARROW = np.array([i < 0x80 and chr(i).isspace() for i in range(256)])
_LETTER = np.array([i < 0x80 and chr(i).isalpha() for i in range(256)])
_MARK = np.array([0x20 < i < 0x7F and not chr(i).isalnum() for i in range(256)])


def word_cuts(buffer: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the spaces that something else than white space follows, in UTF-8 texts that end at `ends`."""
    last = np.zeros(len(buffer) + 1, bool)
    last[ends] = True
    at = np.flatnonzero(buffer == 0x20) + 1
    at = at[~last[at]]
    at = at[~_NARROW[buffer[at]]]
    wide = np.flatnonzero(buffer[at] >= 0x80)
    if len(wide):
        a, b, c = (buffer[np.minimum(at[wide] + i, len(buffer) - 1)].astype(np.int32) for i in range(3))
        white = np.isin(a << 16 | b << 8 | c, _WIDE_3) | np.isin(a << 8 | b, _WIDE_2)
        at = np.delete(at, wide[white])
    return at - 1


def mark_cuts(buffer: np.ndarray) -> np.ndarray:
    """Places of the ASCII punctuation marks that a letter of ASCII or Latin-1 stands before."""
    at = np.flatnonzero(_MARK[buffer[1:]]) + 1
    before, lead = buffer[at - 1], buffer[np.maximum(at - 2, 0)]
    return at[_LETTER[before] | (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)]  # not the signs of times and division


class WordEncoder:
    """The tokenizers library with a memory of words.

    The pre-tokenizer ends a token before every space that something else than white space follows, and
    between a letter and a punctuation mark. Texts are cut there, each new piece is encoded by the library,
    and the ids are laid end to end, which gives the ids of the whole texts. The new pieces of a chunk are
    encoded many at once, as one text where they begin with such a space; the bytes of each token tell
    which piece it belongs to.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words = common.WordIds()
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # each character of a byte-level token is one byte
        for token, i in vocab.items():
            self.width[i] = len(token)

    def _library(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: Sequence[str], sizes: np.ndarray) -> None:
        """Encode pieces that begin with a space before something else than white space; sizes: their bytes."""
        for a in range(0, len(pieces), AT_ONCE):
            some = pieces[a : a + AT_ONCE]
            ids = self._library(["".join(some)])[0]
            cuts = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes[a : a + AT_ONCE]), side="right")
            self.words.add(some, ids, np.diff(cuts, prepend=0))

    def _learn_others(self, pieces: Sequence[str]) -> None:
        """Encode heads of texts and what follows from a mark on, each as a text of its own."""
        ids = self._library(pieces)
        self.words.add(pieces, np.concatenate([np.zeros(0, np.int32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids)))

    def encode_texts(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, end to end; ids of each text."""
        data = [x.encode() for x in texts]
        buffer = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        spaced, begins = np.zeros(len(buffer), bool), np.zeros(len(buffer) + 1, bool)
        spaced[word_cuts(buffer, ends)] = True
        begins[:-1] = spaced
        begins[mark_cuts(buffer)] = True
        begins[np.append(0, ends[:-1])] = True
        starts = np.flatnonzero(begins[:-1])
        number, distinct = common.numbered(buffer, starts)
        if len(self.words.place) * 8 + self.words.n_ids > KEPT_IDS:
            self.words = common.WordIds()
        places = self.words.places(distinct)
        after_space, size = np.zeros(len(distinct), bool), np.zeros(len(distinct), np.int64)
        after_space[number] = spaced[starts]  # no other piece begins like these
        size[number] = np.diff(np.append(starts, len(buffer)))
        known, new = len(self.words.place), np.flatnonzero(places < 0)
        words, others = new[after_space[new]], new[~after_space[new]]
        self._learn([distinct[i] for i in words.tolist()], size[words])
        self._learn_others([distinct[i] for i in others.tolist()])
        places[np.append(words, others)] = np.arange(known, len(self.words.place))
        ids, counts = self.words.ids(places[number])
        before = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, ends)]
        return ids, np.diff(before, prepend=0)

    def encode(self, data: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, counts = self.encode_texts(data)
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(data) else []


_loaded: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def file_system(uri: str):
    """(file system, path) of a folder on local disk, HDFS or an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{uri}")


def write(df: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files; one row per document: _key, part, file, at (ids before it in the file), n_tokens.

    The folder is <shared folder>/freshet-tokens/<a name of its own>.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/freshet-tokens/{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        part = TaskContext.get().partitionId()
        name, writer, encoder = f"part-{part:06d}-{uuid.uuid4().hex}.pfor", None, encoder_of(tokenizer_path)
        for (keys,), data in common.chunks(batches):
            if writer is None:
                system.create_dir(path, recursive=True)
                writer = Writer(system.open_output_stream(f"{path}/{name}"))
            ids, counts = encoder.encode_texts([x.decode("utf-8", "replace") for x in data])
            sizes = counts + 1
            ended, of_text = np.full(sizes.sum(), end_id, np.uint32), np.ones(sizes.sum(), bool)
            of_text[np.cumsum(sizes) - 1] = False
            ended[of_text] = ids
            at = writer.n + np.cumsum(sizes) - sizes
            writer.add(ended)
            yield pa.RecordBatch.from_arrays(
                [keys.cast(pa.int64()), pa.array(np.full(len(sizes), part, np.int32)), pa.array([name] * len(sizes)), pa.array(at), pa.array(sizes)],
                ["_key", "part", "file", "at", "n_tokens"],
            )
        if writer is not None:
            writer.close()

    ordered = common.texts(df, key, text).repartitionByRange(shuffle_width(spark), "_key").sortWithinPartitions("_key", "_text")
    return cut(ordered.mapInArrow(run, "_key long, part int, file string, at long, n_tokens long")).withColumn("folder", F.lit(folder))


def manifest(written: DataFrame) -> DataFrame:
    """One row per file: file, part, n (ids in it), start (ids in the files before it)."""
    files = written.groupBy("part", "file", "folder").agg(F.sum("n_tokens").alias("n"))
    rows = sorted((tuple(r) for r in files.collect()), key=lambda r: r[0])  # one row per file
    out, before = [], 0
    for part, name, folder, n in rows:
        out.append((part, name, folder, n, before))
        before += n
    return written.sparkSession.createDataFrame(out, "part int, file string, folder string, n long, start long")


def read(written: DataFrame) -> DataFrame:
    """Read the files back: one row per document: _key, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            crc = []
            for folder, name, at, n in zip(*(columns[c].to_pylist() for c in ("folder", "file", "at", "n_tokens"))):
                if opened != name:
                    system, path = file_system(folder)
                    opened, reader = name, Reader(system.open_input_file(f"{path}/{name}"))
                crc.append(zlib.crc32(reader.ids(at, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([columns["_key"], columns["start"], columns["n_tokens"], pa.array(crc, pa.int64())], ["_key", "start", "n_tokens", "ids_crc32"])

    files = F.broadcast(manifest(written).select("part", F.col("start").alias("before")))  # one row per task of the writing stage
    rows = written.join(files, "part").select("_key", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "folder", "file", "at")
    return rows.mapInArrow(run, "_key long, start long, n_tokens long, ids_crc32 long")
