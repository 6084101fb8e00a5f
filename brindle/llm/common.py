"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import types
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters: x20 and x09 to x0D.
SPACE = " \t\n\x0b\x0c\r"
#: Bytes of a batch that Spark hands to a Python worker, and the setting that says so. Spark's default is 10,000 rows or 64 MB.
BATCH_BYTES, BATCH_SETTING = 4_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def residue(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int) -> Column:
    """Whether the row's residue is 0. A row without an id is never held out."""
    return F.coalesce(residue(doc_id, modulus) == 0, F.lit(False))


def lower_ascii(text: str) -> str:
    """A-Z in lower case; other characters stay."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    """The maximal runs of characters other than the six of `SPACE`.

    str.split() without an argument also splits at other white space, so texts
    that have any take another way.
    """
    if not text:
        return []
    return text.split() if _OTHER_SPACE.search(text) is None else _WORD.findall(text)


#: Characters besides the six at which str.split() splits.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset in a local session, as in tests, a temporary folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="brindle-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what is
    written. Files that `discard` isn't called for stay until the folder's owner
    clears it, as the returned frame is lazy and may be read at any later time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what `materialise` wrote for `df`, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that are written out and done.

    Spark's cleaner acts when the driver's JVM collects its garbage, which a
    driver with a roomy heap may not do for half an hour.
    """
    gc.collect()
    spark._jvm.System.gc()


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of an Arrow array of texts as (word number of each, distinct words, first word of each text).

    The last array has one more entry than there are texts: the number of all
    words. A null text has no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    if not pc.all(real, min_count=0).as_py():  # leading or trailing white space gives empty pieces
        bounds = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[bounds]
        flat = flat.filter(real)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, bounds


def slices(batch: pa.RecordBatch, column: int, size: int):
    """The batch in slices whose texts have about `size` bytes together, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(lengths) - lengths) // size
    for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(group)) + 1):
        if len(part):
            yield batch.slice(int(part[0]), len(part))


def in_small_batches(df: DataFrame) -> DataFrame:
    """`df`, whose session hands rows to Python workers in batches of about `BATCH_BYTES` from now on, unless it has a limit of its own.

    A batch lies in the executor's JVM, outside its heap, and in the worker at the same time.
    """
    spark = df.sparkSession
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def trim() -> None:
    """Give back to the system what this process has freed.

    Arrow's pool and the C library keep freed memory, and Spark keeps a worker
    for the next stages, so an executor would grow with every stage.
    """
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if give_back is not None:
        give_back(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, a function for mapInArrow or mapInPandas, whose worker keeps no freed memory from batch to batch and after it."""

    def trimmed(batches: Iterator) -> Iterator:
        def each() -> Iterator:
            for batch in batches:
                yield batch
                trim()

        yield from run(each())
        trim()

    return trimmed


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, whose worker keeps no freed memory after a task. For many small batches, where `lean` would trim at each."""

    def trimmed(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return trimmed


def per_process(key: tuple, make):
    """What `make` gave when this worker process first asked for `key`.

    Functions reach the workers by value, so the package's own globals are made
    anew for every task; this keeps a cache from task to task.
    """
    store = sys.modules.setdefault("_brindle_worker_state", types.ModuleType("_brindle_worker_state")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow array of texts, one text after the other, and where each begins (one entry more than texts). A null is empty.

    The bytes are a view of the array's buffer.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]
