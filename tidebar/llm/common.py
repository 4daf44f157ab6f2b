"""Helpers shared by the training-data operators: tables, durable intermediate results and Arrow word tables."""

from __future__ import annotations

import ctypes
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word contracts: space and U+0009 to U+000D. These are also Arrow's ASCII white space and the
#: characters that ``bytes.split()`` splits on.
WHITE = "\x20\x09-\x0d"
#: Texts are handled in slices of about so many bytes, so that one Arrow batch of long documents stays small.
SLICE_BYTES = 3 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only a session of one machine may do without, beside its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends in files every executor sees."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def remove_folder(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more: all that came from them is written as well."""
    for table in tables:
        remove_folder(table.sparkSession, table.written_to)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with as many underscores before it as keep it off the ``taken`` ones (in any case of letters)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = "_" + name
    return name


#: A key with more than this part of all rows is hot; there are fewer than its inverse of them, whatever the input.
HOT_PART = 1 / 2000


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], rows: str, total: int, by: Column) -> DataFrame:
    """Inner join with a table of distinct ``keys`` whose column ``rows`` counts the rows of each in ``many`` (``total`` in all).

    A hot key is split by a hash of ``by``, a column of ``many``, and its row of ``few`` is repeated once for each part: at most
    2 / ``HOT_PART`` times for all keys together. The first column of ``keys`` decides; its hot values, at most 1 / ``HOT_PART``
    of them, are all that the driver sees.
    """
    each = max(1, int(total * HOT_PART))
    first = F.col(keys[0])
    power = F.ceil(F.log2(F.sum(rows) / each)).cast("int")
    hot: dict[int, list] = {}
    for r in few.where(F.col(rows) > each).groupBy(first.alias("key")).agg(power.alias("power")).collect():
        hot.setdefault(r["power"], []).append(r["key"])
    parts = F.lit(1)
    for p, values in sorted(hot.items()):
        parts = F.when(first.isin(values), 1 << p).otherwise(parts)
    salted = many.withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int"))
    copied = few.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return salted.join(copied, [*keys, "_part"]).drop("_part")


_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Give memory that Arrow and malloc hold unused back to the system, so that a reused Python worker starts small."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def group_key(text: Column) -> Column:
    """A key equal for equal texts and for no others: SHA-256 as bytes; a null text has a key of its own."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"-"))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(start, stop) ranges of an Arrow string array of about ``limit`` bytes each, one text at least."""
    n = len(texts)
    if not n:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text by the contract's white space: (offsets per text, code per word, distinct words)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    values = parts.flatten()
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(values), 0))
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        values = values.filter(pa.array(full))
    coded = values.dictionary_encode()
    return offsets, np.asarray(coded.indices, dtype=np.int64), coded.dictionary
