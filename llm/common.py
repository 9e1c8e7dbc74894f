"""Helpers shared by the operators: the shared folder, stored tables, words, word hashes, Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20
# ASCII white space as the contracts define words.
WORD = r"[^\x20\x09-\x0D]+"


def is_local(spark: SparkSession) -> bool:
    """One machine: master ``local`` or ``local[...]`` (``local-cluster`` is none)."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only where that is unset (tests) a temporary folder is used."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: its lineage ends there, so a lost executor
    costs no earlier work and no branch computes it twice."""
    path = shared_dir(df.sparkSession, name)
    small_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows that Spark hands to a Python worker at once; whole texts come in them, so few at a time.
ARROW_ROWS = "1000"


_SHIPPED: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Send this subpackage to the Python workers, once a session: they need not find it on their path."""
    context = spark.sparkContext
    if context in _SHIPPED:
        return
    _SHIPPED.add(context)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.glob("*.py")):
            z.write(f, f"{root.name}/{f.name}")
    context.addPyFile(str(archive))


def small_batches(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; Arrow batches of the session are made small, as the operators carry whole texts."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer where ``df`` has a column of that name in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column | str) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; such rows are never learnt from."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def batches(it: Iterator[pa.RecordBatch], weigh: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of about ``limit`` bytes of column ``weigh`` (one row at least)."""
    for batch in it:
        if not batch.num_rows:
            continue
        sizes = batch.column(batch.schema.get_field_index(weigh))
        lengths = np.nan_to_num(np.asarray(pc.binary_length(sizes).to_numpy(zero_copy_only=False), float))
        part = (np.cumsum(lengths) // limit).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(part)], strict=True):
            yield batch.slice(int(a), int(b - a))


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], weigh: str, limit: int = STEP_BYTES):
    """The function for ``mapInArrow`` that applies ``fn`` to each small piece."""
    def run(it):
        for piece in batches(it, weigh, limit):
            out = fn(piece)
            if out is not None and out.num_rows:
                yield out
    return run


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [x if x is not None else b"" for x in column.to_pylist()]


# ASCII capitals to small letters, other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def flat_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words of all texts in one list, and where each text begins in it (one entry more than texts).

    ``bytes.split`` parts at ASCII white space only, which is the contracts' definition of a word."""
    words: list[bytes] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        words += text.split()
        starts[i + 1] = len(words)
    return words, starts


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """1, P, P**2, ... modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 256)
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(size - 1, 0x9E3779B97F4A7C15, np.uint64)])
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word: a polynomial over its bytes, mixed with its length."""
    if not words:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    raw += np.uint64(1)
    raw *= powers(int(lengths.max()))[np.arange(len(raw)) - np.repeat(starts, lengths)]
    return mix(np.add.reduceat(raw, starts) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` consecutive words from each position; the last ``k - 1`` positions have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[j:j + n]
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` consecutive values from each position, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:len(out) - step], out[step:])
        done += step
    return out
