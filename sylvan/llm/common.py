"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of most contracts: maximal runs of anything but these bytes.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that a function over texts gets at once: a worker's memory is theirs, not that of a batch.
ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """For the owner of a session (the registered queries and the pipeline; the operators leave settings alone): Python
    gets at most ROWS rows at once, as texts can be long. The plans that a query returns run later, so it stays set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, ROWS)


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key's text modulo ``folds``; a null key counts as fold -1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where it is unset on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="sylvan-shared-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found.rstrip("/")


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with these options of the writer, and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sylvan_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_sylvan_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to the rows, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(fn, chunks(batch, ROWS))

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about so many bytes of a text column: memory then follows no batch size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for k, n in enumerate(sizes):
        held += n
        if held >= most_bytes:
            yield batch.slice(start, k + 1 - start)
            start, held = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def chunks(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The batch in small ones: the JVM holds each outside its heap."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, cut at white space: bytes.lower and bytes.split do exactly that for ASCII and leave the rest."""
    return text.lower().split()


#: Words of 64 bits of the bitmap by which wanted rows are found again.
BITMAP_WORDS = 1 << 16


def maybe_wanted(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key``, a long, is in ``wanted``, and few others: what passes a bitmap of the wanted keys' hashes,
    broadcast at BITMAP_WORDS rows at most."""
    h = F.xxhash64(key, F.lit(3))
    slot = F.pmod(F.shiftright(h, 6), F.lit(BITMAP_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    bitmap = wanted.groupBy(slot.alias("_slot")).agg(F.bit_or(bit).alias("_bits"))
    return rows.withColumn("_slot", slot).join(F.broadcast(bitmap), "_slot").where(F.col("_bits").bitwiseAND(bit) != 0).drop("_slot", "_bits")


def wanted_rows(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key``, a long, is in ``wanted``: few others are shuffled with their texts."""
    some = maybe_wanted(rows, wanted, key)
    # an inner join: Spark would move a semi join below the bitmap's
    return some.join(wanted.select(key).distinct(), key)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are gone; else they stay until the driver happens to collect its garbage.
    What the driver's processes have freed but keep goes back too: Arrow's memory, and that of the JVM's C library."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()
    _trim_native_heap(spark)


def _trim_native_heap(spark: SparkSession) -> None:
    """The JVM's own command for it, called by its interface, as the server's class is not open; not every JVM has it."""
    jvm = spark._jvm
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    methods = {m.getName(): m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() in ("isRegistered", "getMBeanInfo", "invoke")}

    def call(name: str, *values: object) -> object:
        args = spark._sc._gateway.new_array(jvm.java.lang.Object, len(values))
        for k, value in enumerate(values):
            args[k] = value
        return methods[name].invoke(server, args)

    if call("isRegistered", commands):
        for operation in call("getMBeanInfo", commands).getOperations():
            if operation.getName() == "systemTrimNativeHeap":
                call("invoke", commands, "systemTrimNativeHeap", None, None)


def free_executors(spark: SparkSession) -> None:
    """Let the executors' JVMs give back the heap that they grew to and need no more: a full collection shrinks it. Python's workers
    share the executor's memory with it."""
    n = max(2 * spark.sparkContext.defaultParallelism, 2)
    spark.range(0, n, 1, n).select(F.call_function("reflect", F.lit("java.lang.System"), F.lit("gc")).alias("x")).agg(F.count("x")).collect()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its worker gives back what it held: it may stand idle beside others."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        trim()

    return trimmed


def trim() -> None:
    """What a Python worker has freed but keeps goes back."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if free:
        free(0)


def append_columns(df: DataFrame, reads: list[str], fn: Callable[..., list[pa.Array]], added: str) -> DataFrame:
    """``df`` with the columns of the schema ``added``, which ``fn`` makes batch by batch of the columns ``reads``."""
    at = [df.columns.index(c) for c in reads]
    names = [part.split()[0] for part in added.split(", ")]
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, ROWS)):
            made = fn(*(batch.column(k) for k in at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return df.mapInArrow(lean(run), schema)


def unused(columns: list[str], name: str) -> str:
    """A column name like ``name`` that the caller's frame does not have."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def sample_by_kind(rows: DataFrame, most: dict[object, int] | int) -> DataFrame:
    """Of the rows (kind, doc_id, text), at most so many of each kind: those first in a hash order of doc_id and text, none twice.

    Two passes, and no kind in one task: the number of different rows of each kind is estimated, rows beyond the share of the
    hashes that surely holds enough are left out where they are read, and only the rest is ordered.
    """
    h = F.xxhash64("doc_id", "text", F.lit(5))
    rows = rows.select(F.col("kind"), F.col("doc_id"), F.col("text"), h.alias("h"))
    sizes = {x.kind: max(x.n, 1) for x in rows.groupBy("kind").agg(F.approx_count_distinct("h", 0.03).alias("n")).collect()}
    limits = {k: most.get(k, 0) if isinstance(most, dict) else most for k in sizes}
    ranges = [F.when(F.col("kind") == k, F.lit(int(min(1.0, (1.5 * limits[k] + 50) / n) * (1 << 31)))) for k, n in sizes.items()]
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in limits.items()], F.lit(0))
    near = rows.where(F.pmod(F.shiftright("h", 16), F.lit(1 << 31)) < F.coalesce(*ranges, F.lit(0)))
    once = near.groupBy("kind", "h").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    first = Window.partitionBy("kind").orderBy(F.pmod(F.shiftright("h", 16), F.lit(1 << 31)), "h")
    return once.withColumn("k", F.row_number().over(first)).where(F.col("k") <= limit).select("kind", "doc_id", "text", "h")


def fit_in_task(sample: DataFrame, order: list[str], fit: Callable[[pa.Table], object], most_bytes: int, text: str = "text") -> object:
    """What ``fit`` makes of the sample's rows in this order, of at most ``most_bytes`` of text. It runs in one task, so that the
    driver gets the model and no texts; a lost executor's task runs again."""
    names, types = sample.columns, sample.schema
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, room = [], most_bytes
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0)
            room_after = pc.subtract(pa.scalar(room, pa.int64()), pc.cumulative_sum(sizes.cast(pa.int64())))
            fits = pc.greater_equal(room_after, pa.scalar(0, pa.int64())).to_pylist()
            n = fits.index(False) if False in fits else len(fits)
            parts.append(batch.slice(0, n))
            if n < len(fits):
                break
            room = room_after[-1].as_py() if n else room
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(parts)) if parts else None)], pa.binary())], names=["model"])

    made = sample.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "model binary").collect()
    model = pickle.loads(bytes(made[0][0])) if made else None
    if model is None:  # there were no rows
        from pyspark.sql.pandas.types import to_arrow_schema

        model = fit(to_arrow_schema(types).empty_table())
    return model


#: Rows of arrays that tasks make and that are added up: values in float32, in slices, of which those of zeros alone are left out.
PIECES = "kind string, slice long, unit long, data binary"
SLICE = 1 << 15


def pieces(kind: str, unit: int, values: np.ndarray) -> pa.RecordBatch:
    flat = np.ascontiguousarray(values, np.float32).ravel()
    found = [(k, flat[at : at + SLICE]) for k, at in enumerate(range(0, len(flat), SLICE))]
    found = [(k, zlib.compress(part.tobytes(), 1)) for k, part in found if part.any()]
    columns = [pa.array([kind] * len(found), pa.string()), pa.array([k for k, _ in found], pa.int64()), pa.array([unit] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "slice", "unit", "data"])


def add_up(rows: DataFrame) -> dict[str, dict[int, np.ndarray]]:
    """The sums of ``pieces`` by kind and slice, made in tasks in the order of the units: the driver gets one array of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.empty(0)
        for batch in batches:
            for kind, part, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "slice", "data")), strict=True):
                if at != (kind, part):
                    if at:
                        yield made(at, total)
                    at, total = (kind, part), np.zeros(1)
                total = total + np.frombuffer(zlib.decompress(data), np.float32)
        if at:
            yield made(at, total)

    def made(at: tuple[str, int], total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["kind", "slice", "data"])

    out: dict[str, dict[int, np.ndarray]] = {}
    for r in rows.repartition("kind", "slice").sortWithinPartitions("kind", "slice", "unit").mapInArrow(lean(run), "kind string, slice long, data binary").collect():
        out.setdefault(r.kind, {})[r.slice] = np.frombuffer(bytes(r.data))
    return out


def whole(found: dict[int, np.ndarray] | None, size: int) -> np.ndarray:
    """An array of ``add_up``, of this size, from its slices."""
    out = np.zeros(size)
    for k, part in (found or {}).items():
        out[k * SLICE : k * SLICE + len(part)] = part
    return out
