"""Token ids in length-delimited binary records.

Record: length of the payload (8 bytes), masked checksum of those 8 bytes (4), payload, masked checksum of the
payload (4), one end byte. Payload: identifier (8 bytes, signed), then the ids, 2 bytes each where the vocabulary
has at most 65,536 entries, else 4. All numbers are little-endian; a checksum is crc32 rotated right by 15 bits
plus a constant, so that a checksum stored inside checked data doesn't cancel itself out.

Files are written by Spark's text writer (its line end is the record's end byte), so they land wherever Spark
can write. The offset index is a table beside them: file, offset and length of each record, for shuffled reads.
"""

from __future__ import annotations

import gc
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import batches, texts_of

MASK_DELTA = 0xA282EAD8
END = b"\n"
# Text bytes that go to one file; a longer document has a file of its own size.
FILE_BYTES = 8 << 20
# Words whose ids a worker remembers in each of two generations, and as many pieces; what falls out of
# both is encoded again when needed.
CACHE_ENTRIES = 400_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without its end byte."""
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and payload of each record; raises ValueError where a checksum, a length or an end byte is wrong."""
    at, end = 0, len(content)
    while at < end:
        if at + 12 > end:
            raise ValueError(f"record at {at}: cut off")
        size = content[at:at + 8]
        if struct.unpack_from("<I", content, at + 8)[0] != masked(size):
            raise ValueError(f"record at {at}: checksum of the length is wrong")
        n = struct.unpack("<Q", size)[0]
        stop = at + 12 + n
        payload = content[at + 12:stop]
        if stop + 5 > end or struct.unpack_from("<I", content, stop)[0] != masked(payload) or content[stop + 4:stop + 5] != END:
            raise ValueError(f"record at {at}: checksum of the payload is wrong")
        yield at, payload
        at = stop + 5


class WordEncoder:
    """Ids of whole texts from a tokenizer whose pieces never cross white space.

    A text is split at ASCII white space and each distinct word is encoded once per worker. A word of Latin-1
    characters is lower-cased and split into pieces here, and the library's model encodes each distinct piece;
    any other word goes through the library's whole chain. ``by_word=False`` sends whole texts through it.
    """

    PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")

    MARKS = b"!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"

    def __init__(self, path: str, by_word: bool = True):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.code = "H" if self.width == 2 else "I"
        self.model = self.tokenizer.model
        self.by_word = by_word
        specials = {re.escape(t.content[0]) for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.plain = re.compile("(?:(?![" + "".join(specials) + "])[!-~¡-ÿ])+" if specials else "[!-~¡-ÿ]+").fullmatch
        kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.bytemap, spare = [], 256
        for b in range(256):
            self.bytemap.append(chr(b) if b in kept else chr(spare))
            spare += b not in kept
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str | bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str | bytes) -> bytes:
        mapped = piece.decode() if isinstance(piece, bytes) else piece if piece.isascii() else "".join([self.bytemap[b] for b in piece.encode()])
        ids = array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if len(self.pieces) >= CACHE_ENTRIES:
            self.pieces.clear()
        self.pieces[piece] = ids
        return ids

    def _word(self, raw: bytes) -> bytes:
        if len(self.words) >= CACHE_ENTRIES:
            self.older, self.words = self.words, {}
        ids = self.older.get(raw)
        if ids is None:
            ids = self._encoded(raw)
        self.words[raw] = ids
        return ids

    def _encoded(self, raw: bytes) -> bytes:
        # The commonest form: ASCII letters, then marks that make up one piece.
        small = raw.lower()
        letters = small.rstrip(self.MARKS)
        if letters.isalpha():
            ids = self.pieces.get(letters)
            if ids is None:
                ids = self._piece(letters)
            if len(letters) == len(small):
                return ids
            marks = small[len(letters):]
            more = self.pieces.get(marks)
            return ids + (self._piece(marks) if more is None else more)
        word = raw.decode("utf-8", "replace")
        if not self.plain(word):
            return self._whole(word)
        known, out = self.pieces.get, []
        for piece in self.PIECES.findall(word.lower()):
            ids = known(piece)
            out.append(ids if ids is not None else self._piece(piece))
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """Ids of one text as little-endian numbers of ``width`` bytes."""
        if not self.by_word:
            return self._whole(text.decode("utf-8", "replace"))
        words = text.split()
        out = list(map(self.words.get, words))
        for i, ids in enumerate(out):
            if ids is None:
                ids = self.words.get(words[i])
                out[i] = self._word(words[i]) if ids is None else ids
        return b"".join(out)


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, by_word: bool = True) -> WordEncoder:
    """One encoder per Python worker."""
    if (path, by_word) not in _ENCODERS:
        gc.freeze()
        _ENCODERS[path, by_word] = WordEncoder(path, by_word)
    return _ENCODERS[path, by_word]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
                 by_word: bool = True, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode ``docs`` into record files below ``path`` in ascending order of id, build the index, return it.

    Index (``path``/index): ``doc_id``, ``file``, ``offset``, ``n_bytes``, ``n_tokens`` (with the end id),
    ``start`` (ids of all documents before), ``ids_crc32``. Null text is empty: its record holds the end id alone.
    Rows that repeat an id are records each, ordered by text; a null id is written as the least number and read
    as null. An empty table gives an empty index. ``tokenizer`` is a local path that every worker can open.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // file_bytes))
    ordered = base.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def encode(it):
        enc = encoder(tokenizer, by_word)
        closing = np.asarray([end_id], enc.dtype).tobytes()
        gc.disable()  # the caches hold no cycles; walking them costs more than the encoding
        for batch in batches(it, "text"):
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(
                [frame(struct.pack("<q", i if i is not None else -(1 << 63)) + enc.encode(t) + closing)
                 for i, t in zip(ids, texts_of(batch, "text"), strict=True)], pa.binary())], ["value"])

    records = ordered.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", END.decode()).text(f"{path}/records")
    return index_files(spark, path, encoder(tokenizer, by_word).width)


def index_files(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Read all record files, check every record, write and return the offset index."""
    def scan(it):
        for batch in it:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content, rows, start = content.as_py() or b"", [], 0
                for at, payload in frames(content):
                    ids = np.frombuffer(payload, f"<u{width}", offset=8)
                    doc = struct.unpack_from("<q", payload)[0]
                    rows.append((None if doc == -(1 << 63) else doc, name, at, len(payload) + 17, len(ids), start, zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, r, strict=True)) for r in rows], schema=SCHEMA)

    files = spark.read.format("binaryFile").load(f"{path}/records").select("path", "content")
    local = files.mapInArrow(scan, "doc_id long, file string, offset long, n_bytes long, n_tokens long, local long, ids_crc32 long")
    local.write.parquet(f"{path}/scan")
    local = spark.read.schema(local.schema).parquet(f"{path}/scan")
    # One row per file: files follow one another by the number that the writer gave them.
    sums = local.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    sums = sums.select(F.col("file").alias("_file"), F.coalesce(F.sum("_n").over(Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    index = local.join(sums, F.col("file") == F.col("_file")).select(
        "doc_id", "file", "offset", "n_bytes", "n_tokens", (F.col("local") + F.col("_before")).alias("start"), "ids_crc32")
    index.write.parquet(f"{path}/index")
    return spark.read.schema(index.schema).parquet(f"{path}/index")


FIELDS = ("doc_id", "file", "offset", "n_bytes", "n_tokens", "local", "ids_crc32")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), *((n, pa.int64()) for n in FIELDS[2:])])


def read_tokens(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """``doc_id`` and ``ids`` (array) of every record, read from the files."""
    def scan(it):
        for batch in it:
            for content in batch.column(0):
                rows = [(None if (d := struct.unpack_from("<q", p)[0]) == -(1 << 63) else d, np.frombuffer(p, f"<u{width}", offset=8).astype(np.int32))
                        for _, p in frames(content.as_py() or b"")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spark.read.format("binaryFile").load(f"{path}/records").select("content").mapInArrow(scan, "doc_id long, ids array<int>")
