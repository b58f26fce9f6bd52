"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A file holds one run of documents in ascending doc_id order::

    magic  8 bytes  b"LWTOK\\x00\\x02\\x00"
    header 8 little-endian unsigned 64-bit integers: documents, tokens, bytes
           an id (2 or 4), rows without a doc_id, offset of the doc_ids (as
           two's complement), sizes in bytes of the two boundary sections and
           of the doc_id section
    ids    little-endian unsigned integers
    ends   Elias-Fano sequence of each document's end in the id array
    docs   Elias-Fano sequence of doc_id - offset

An Elias-Fano sequence of n non-decreasing integers up to u takes about
n * (2 + log2(u / n)) bits: the low bits of each are stored packed, the high
bits as a unary bit vector whose k-th one is found by a sampled select.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_characters
from .pretokens import Agreement, composes
from .store import Workspace

MAGIC = b"LWTOK\x00\x02\x00"
#: A file is closed at this many tokens; one longer document makes a longer file.
FILE_TOKENS = 1 << 23
#: Rows in a partition of the write, on average.
ROWS_A_PARTITION = 4_000
#: Documents of a file whose places are looked up together.
READ_ROWS = 1 << 12
#: Pre-tokens that a worker keeps, and of later ones how many before it forgets them.
REMEMBERED, RECENT = 250_000, 100_000


class EliasFano:
    """Non-decreasing integers; the k-th one is read through select in the high part.

    ``samples`` holds the bit place of every SAMPLE-th one, in 32 bits, and is
    stored with the sequence; select goes to the sample before and counts ones
    byte by byte from there.
    """

    SAMPLE = 256  # ones between two stored places

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @staticmethod
    def encode(values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        high = np.zeros((top >> low_bits) + n + 1, np.uint8)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high[places] = 1
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        return EliasFano(n, low_bits, low, np.packbits(high, bitorder="little"), places[:: EliasFano.SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @staticmethod
    def from_bytes(data: memoryview) -> EliasFano:
        n, low_bits, n_low, n_high, n_samples = struct.unpack_from("<QQQQQ", data)
        at = 40 + 4 * n_samples
        return EliasFano(n, low_bits, np.frombuffer(data, np.uint8, n_low, at), np.frombuffer(data, np.uint8, n_high, at + n_low), np.frombuffer(data, "<u4", n_samples, 40))

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position in the high part of the k-th one, from 0."""
        place = self.samples[k // self.SAMPLE].astype(np.int64)
        byte, left = place >> 3, k % self.SAMPLE
        # ones of the sample's own byte that stand before it count as passed
        left = left + np.bitwise_count(self.high[byte] & ((1 << (place & 7)) - 1).astype(np.uint8))
        open_ = np.arange(len(k))
        while len(open_):
            ones = np.bitwise_count(self.high[byte[open_]])
            beyond = left[open_] >= ones
            open_ = open_[beyond]
            left[open_] -= ones[beyond]
            byte[open_] += 1
        bits = np.unpackbits(self.high[byte][:, None], axis=1, bitorder="little")
        return byte * 8 + np.argmax(np.cumsum(bits, 1) > left[:, None], axis=1)

    def get(self, k: np.ndarray) -> np.ndarray:
        """The k-th values."""
        k = np.asarray(k, np.int64)
        if not len(k):
            return np.zeros(0, np.int64)
        value = (self.select(k) - k) << self.low_bits
        for b in range(self.low_bits):
            at = k * self.low_bits + b
            value |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << b
        return value


def pack(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """One file; doc_ids ascending with the missing ones first."""
    missing = sum(d is None for d in doc_ids)
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    offset = int(known[0]) if len(known) else 0
    docs = EliasFano.encode((known - offset).astype(np.uint64)).to_bytes()
    bounds = EliasFano.encode(ends).to_bytes()
    header = struct.pack("<QQQQqQQQ", len(doc_ids), len(ids), width, missing, offset, 0, len(bounds), len(docs))
    return MAGIC + header + ids.astype("<u2" if width == 2 else "<u4").tobytes() + bounds + docs


class TokenFile:
    """A file's id array, with the documents' places found by select when they are asked for."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if view[:8] != MAGIC:
            raise ValueError("not a token-id file")
        self.documents, tokens, width, self.missing, self.offset, _, n_bounds, n_docs = struct.unpack_from("<QQQQqQQQ", view, 8)
        at = 8 + 64
        self.ids = np.frombuffer(view, "<u2" if width == 2 else "<u4", tokens, at)
        at += tokens * width
        self.ends = EliasFano.from_bytes(view[at : at + n_bounds])
        self.docs = EliasFano.from_bytes(view[at + n_bounds : at + n_bounds + n_docs])

    def bounds(self, first: int, stop: int) -> np.ndarray:
        """Where documents first .. stop-1 begin in the id array, and the end of the last."""
        ends = self.ends.get(np.arange(max(0, first - 1), stop))
        return ends if first else np.concatenate([[0], ends])

    def doc_ids(self, first: int, stop: int) -> list[int | None]:
        known = self.docs.get(np.arange(max(0, first - self.missing), max(0, stop - self.missing))) + self.offset
        return [None] * (stop - first - len(known)) + known.tolist()

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        a, z = self.bounds(k, k + 1)
        return self.ids[a:z]


class Pretokens(dict):
    """Packed ids of pre-tokens; a missing one is encoded on the way.

    The first REMEMBERED stay, and frequent words come early; later ones share a
    second table, which is emptied when full.
    """

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.recent = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.recent.get(piece)
        if ids is None:
            ids = self.encode(piece)
            if len(self) < REMEMBERED:
                self[piece] = ids
            else:
                if len(self.recent) >= RECENT:
                    self.recent.clear()
                self.recent[piece] = ids
        return ids


class WordBPE:
    """The tokenizers library behind a table of pre-tokens it has already encoded.

    A text of characters on which lower-casing and the file's split pattern
    agree with the library's normaliser and pre-tokenizer is cut here, and each
    new pre-token is encoded by the library's model, which sees pre-tokens one
    by one in any case; words repeat, so most are looked up. Any other text, and
    one with a special token, goes through the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # the library's \s is Unicode white space; no other branch begins with a letter, so letters can go first
        self.split = regex.compile(r"\p{L}+|" + pattern.replace(r"\s", r"\p{White_Space}"))
        self.bytes = byte_characters()
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.known = Pretokens(self._encode_pretoken)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.to_byte = {c: b for b, c in self.bytes.items()}
        self.agreement = Agreement(lambda t: self.split.findall(t.lower()), self._library_cut, composes)

    def _library_cut(self, text: str) -> list[str]:
        """The pre-tokens that the library's own normaliser and pre-tokenizer make."""
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return [bytes([self.to_byte[c] for c in p]).decode("utf-8") for p, _ in pieces]

    def _encode_pretoken(self, piece: str) -> bytes:
        return self.pack([t.id for t in self.tokenizer.model.tokenize("".join([self.bytes[b] for b in piece.encode("utf-8")]))])

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The text's ids, ``width`` bytes each in the machine's order."""
        if any(t in text for t in self.special) or not self.agreement.covers(text):
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        # white space is dropped by the split, so it needn't be folded
        return b"".join(map(self.known.__getitem__, self.split.findall(text.lower())))


_loaded: dict[str, WordBPE] = {}


def encoder(path: str) -> WordBPE:
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def _filesystem(where: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri("s3" + where[3:] if where.startswith("s3a:") else where)


def _put(where: str, data: bytes) -> None:
    """Write under a name of this attempt's own, then move: a retried task replaces whole files only."""
    fs, path = _filesystem(where)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with fs.open_output_stream(own) as f:
            f.write(data)
        fs.move(own, path)
    except BaseException:
        if fs.get_file_info(own).type != pafs.FileType.NotFound:
            fs.delete_file(own)
        raise


def _uri(path: str) -> str:
    path = path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    return path if "://" in path else f"file://{path}"


MANIFEST = "part int, file int, path string, documents long, tokens long"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, workspace: Workspace) -> DataFrame:
    """Encode every text, append ``end_id``, write files under ``path``; returns the manifest, a row a file.

    Documents are range-partitioned by doc_id, so files in (part, file) order
    hold ascending ids. Defined results: a null or empty text has the end id
    alone; null doc_ids come first; repeated rows, and rows that share a doc_id,
    are documents of their own; a very long text is one document and may make a
    longer file; an empty table makes no file and an empty manifest; other
    columns, whatever their names, aren't read.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // ROWS_A_PARTITION + 1)
    target = _uri(path)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        doc_ids: list[int | None] = []
        ends: list[int] = []
        ids: list[bytes] = []
        end = enc.pack([end_id])
        size, done, part = 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, ends, ids, size, done
            where = f"{target}/part-{part:06d}-{done:06d}.tok"
            _put(where, pack(doc_ids, np.array(ends, np.int64), np.frombuffer(b"".join(ids), f"u{enc.width}"), enc.width))
            row = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "file": pa.array([done], pa.int32()), "path": [where], "documents": pa.array([len(ends)], pa.int64()), "tokens": pa.array([size], pa.int64())}
            )
            doc_ids, ends, ids, size, done = [], [], [], 0, done + 1
            return row

        for b in batches:
            for d, t, p in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                part = p
                found = enc.encode(t.as_py() or "") + end
                n = len(found) // enc.width
                if ends and size + n > FILE_TOKENS:
                    yield close()
                ids.append(found)
                size += n
                doc_ids.append(d)
                ends.append(size)
        if ends:
            yield close()

    # rows that share a doc_id, or have none, are told apart by the text's hash and then by a number, so that no task gets all of them
    keyed = rows.withColumn("_h", F.xxhash64("text")).withColumn("_n", F.rand(11))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_n")]
    placed = keyed.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ordered = placed.sortWithinPartitions(*order).select("doc_id", "text", "part")
    return workspace.keep(ordered.mapInArrow(files, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Repeated and null doc_ids come back as they were written; an empty manifest
    gives no rows.
    """
    order = Window.orderBy("part", "file")  # a row a file: small beside what the files hold
    starts = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    count = max(1, manifest.count())

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = _filesystem(where)
                with fs.open_input_file(path) as f:
                    file = TokenFile(f.read())
                for first in range(0, file.documents, READ_ROWS):
                    stop = min(first + READ_ROWS, file.documents)
                    bounds = file.bounds(first, stop)
                    wide = file.ids[bounds[0] : bounds[-1]].astype("<u4")
                    cuts = (bounds - bounds[0]).tolist()
                    crc = [zlib.crc32(wide[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc_ids(first, stop), pa.int64()), pa.array(bounds[:-1] + start), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = starts.select("path", "start").repartition(count, "path")
    return spread.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
