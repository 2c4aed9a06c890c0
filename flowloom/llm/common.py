"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

#: Text bytes handed to a kernel at once; bounds the arrays a kernel makes.
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts; one that is stored in fewer pieces than there are cores is spread over them."""
    return spread(table(spark, sf_dir, name))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one only where it is unset and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="flowloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and reads it back.

    The files outlive lost executors and are Snappy/columnar, unlike checkpoint files of rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/flowloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_files(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for ``df``; only for frames nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/flowloom-" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def learnable(id_col: str = "doc_id") -> Column:
    """True for the rows labels may be learnt from: crc32 of the id's text, modulo 5, is not 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def least_hashes(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows whose key has the least hashes (all, if there are no more); keys are distinct.

    Rows are counted first, so that a bound on the hash leaves a few more than ``limit`` in all and
    not ``limit`` of each partition, before the rest are sorted.
    """
    n, hashed = df.count(), F.xxhash64(key)
    if n > limit:
        share = min(1.0, (1.05 * limit + 6 * limit**0.5 + 20) / n)
        df = df.where(hashed <= F.lit(min((1 << 63) - 1, int(share * 2**64) - (1 << 63))))
    return df.orderBy(hashed, key).limit(limit)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> list[tuple[str, str, int]]:
    """At most ``limit`` learnable (id text, text, label) rows, chosen by a hash of the id.

    The chosen ids are at most ``limit`` rows, so the join with the texts is a broadcast of known
    size; of an id's texts the least goes on, so repeated ids are combined where they are read. Null
    labels and ids are left out; an id with several labels takes the largest.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & learnable())
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    chosen = least_hashes(known, "doc_id", limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = rows.groupBy(F.col("doc_id").cast("string").alias("k")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y"))
    return sorted((r.k, r.text, r.y) for r in got.toLocalIterator())


def blocks(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Cuts rows into runs of about ``limit`` bytes; a longer row is a run of its own."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def pieces(text: str, most: int):
    """Cuts a text before spaces or line ends into parts of at most ``most`` characters; a longer word is a part of its own."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(" ", at + 1, at + most), text.rfind("\n", at + 1, at + most))
        if cut < 0:
            ends = [k for k in (text.find(" ", at + most), text.find("\n", at + most)) if k >= 0]
            if not ends:
                break
            cut = min(ends)
        yield text[at:cut]
        at = cut
    yield text[at:]


def release() -> None:
    """Gives memory that a task no longer needs back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], dict]],
    fields: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Runs a kernel over whole texts, one output row per input row, without a shuffle.

    ``make`` is called once in each task and returns ``texts -> {column: values}``; a null text is
    given as "". Only the two columns are read, so other columns may have any name.
    """
    schema = T.StructType.fromDDL(fields)
    full = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *schema.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kernel = make()
        types = to_arrow_schema(full)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            for a, b in blocks(sizes, block_bytes):
                cols = kernel([t or "" for t in texts.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a)] + [pa.array(cols[f.name], types.field(f.name).type) for f in schema.fields],
                    schema=types,
                )
        del kernel
        release()

    return df.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, full)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]], text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``df``, all columns, whose text a kernel says to keep; without a shuffle."""
    place = df.columns.index(text_col)

    def run(batches):
        kernel = make()
        for batch in batches:
            texts = batch.column(place)
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            for a, b in blocks(sizes, block_bytes):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(kernel([t or "" for t in part.column(place).to_pylist()]), pa.bool_()))
        del kernel
        release()

    return df.mapInArrow(run, df.schema)
