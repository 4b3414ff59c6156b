"""What the operators of this subpackage share: the shared folder, joins that bear hot keys, and words as arrays."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space and the controls 9 to 13.
SPACE = r"\x20\x09-\x0D"
#: A key with more than a 256th of the rows is hot; there are fewer than 256 of them.
HOT_SHARE = 256
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; on one machine, where it is unset, the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/granary"


#: Tasks that sum what other tasks have gathered.
SUM_TASKS = 32

#: Folders that this process has written, in order.
_written: list[str] = []


#: Rows to an Arrow batch while operators write tables: whole texts by the thousand take too much of an executor's memory.
BATCH_ROWS = 2000


def limit_batches(spark: SparkSession) -> str:
    """Holds the session's Arrow batches to BATCH_ROWS rows; gives the setting that was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH_ROWS, int(rows)) if int(rows) > 0 else BATCH_ROWS))
    return rows


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Holds Arrow batches to BATCH_ROWS rows while a frame is written or collected."""
    rows = limit_batches(spark)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def materialize(df: DataFrame) -> DataFrame:
    """Writes a frame to the shared folder and reads it back. This cuts lineage: lost executors lose none of it."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(run):
    """run, a function over a task's batches, which gives memory back at its end: Python workers live on for later stages."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):
                ctypes.CDLL(None).malloc_trim(0)

    return whole


@contextlib.contextmanager
def cleared(spark: SparkSession):
    """Deletes on leaving what was materialized inside. Frames made inside must have been written elsewhere by then."""
    mark = len(_written)
    try:
        yield
    finally:
        for path in _written[mark:]:
            there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
        del _written[mark:]


def stamped(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1, ... and rid, a number of each row, written once: every later reading sees the same numbers."""
    return materialize(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn("rid", F.monotonically_increasing_id()))


#: Bits of a table of ids at most: it is 16 MB then, and lets more ids through than were asked for.
TABLE_MOST = 27


def id_table(ids: DataFrame, name: str) -> np.ndarray:
    """A bit for each remainder of the ids in a column (hashes, or numbers that spread); about 16 bits an id, 2**TABLE_MOST at most."""
    bits = min(TABLE_MOST, max(16, int(np.ceil(np.log2(max(1, ids.count())))) + 4))
    spot = F.col(name).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = ids.select(F.bitmap_bucket_number(spot).alias("part"), F.bitmap_bit_position(spot).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    table = np.zeros((1 << bits) >> 3, np.uint8).reshape(-1, 4096)
    for part, own in parts.toLocalIterator():
        table[part - 1] = np.frombuffer(own, np.uint8)
    return table.ravel()


def in_table(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be among those of the table; no id of it is missed."""
    bit = (ids & (8 * len(table) - 1)).astype(np.int64)
    return (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def bounded_sample(rows: DataFrame, n: int, *key: Column) -> list:
    """At most n rows, those with the smallest hashes of `key`, so that reruns agree; few more than n reach the driver."""
    total = rows.count()
    place = F.shiftrightunsigned(F.xxhash64(F.lit(5), *key), 24)
    share = 1.0 if total <= 2 * n else 1.2 * n / total
    rows = rows.withColumn("_place", place).filter(F.col("_place") < F.lit(int(share * (1 << 40))))
    return sorted(rows.toLocalIterator(), key=lambda r: r["_place"])[:n]


def packed(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([zlib.compress(sums.tobytes(), 1)], pa.binary())], names=["sums"])


def add_up(batches):
    total = None
    for batch in batches:
        for x in batch.column("sums"):
            own = np.frombuffer(zlib.decompress(x.as_py()))
            total = own.copy() if total is None else total + own
    if total is not None:
        yield packed(total)


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of what tasks gathered in `sums`."""
    parts = rows.select("sums").repartition(SUM_TASKS).mapInArrow(lean(add_up), "sums binary")
    with small_batches(rows.sparkSession):
        return sum((np.frombuffer(zlib.decompress(r["sums"])) for r in parts.toLocalIterator()), np.zeros(size))


def words_of(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column, how: str = "left") -> DataFrame:
    """Joins rows to groups, which has one row a key and the key's row count in `size`.

    Hot keys are few by the pigeonhole principle, so their list can be broadcast; their rows are dealt over SALTS
    slots by `spread`, and their group is repeated in each slot. Nothing else is salted. `groups` is read twice:
    pass a table or something cheap.
    """
    hot = F.col(size) * HOT_SHARE > F.lit(total)
    marks = groups.filter(hot).select(key, F.lit(True).alias("_hot"))
    rows = rows.join(F.broadcast(marks), key, "left")
    rows = rows.withColumn("_salt", F.when(F.col("_hot"), F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    slots = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(groups.withColumn("_salt", F.explode(slots)), [key, "_salt"], how).drop("_salt")


# Words as arrays. A batch of texts is one byte array; nothing below loops over words.

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LANES = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers(dict):
    """Powers worked out so far. They stay in their process: functions that are sent to tasks carry an empty one."""

    def __reduce__(self):
        return Powers, ()


_powers = Powers()

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            one = np.full(n, base, np.uint64)
            one[0] = 1
            _powers[name] = np.multiply.accumulate(one)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def string_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts together, and where each begins and the last ends; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20):
    """Ranges of rows of about `limit` bytes each, and never less than one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


class Words:
    """The words of some texts: byte ranges, the row of each, and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE, lower: bool = True):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inner = inside[self.data]
        before = np.zeros(n, bool)
        before[1:] = inner[:-1]
        edge = offsets[:-1][offsets[:-1] < n]
        before[edge] = False
        after = np.zeros(n, bool)
        after[:-1] = inner[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inner & ~before)
        self.ends = np.flatnonzero(inner & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = powers(len(self.data) + 1)
        sums = np.empty(len(self.data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[self.data] * up[:-1], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def texts(self, which: np.ndarray) -> list[bytes]:
        """Some words, each as text() gives it."""
        data = self.data.tobytes()
        return [data[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)]


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _LANES[0]
    for j in range(1, k):
        out += hashes[j : j + n] * _LANES[j]
    return mix(out + np.uint64(k))


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
