"""What the operators of this subpackage share: table access, shared scratch tables, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word rule of the contracts: runs of anything but space and \x09-\x0D. bytes.split() splits on exactly these bytes.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Whether Spark removes an execution's shuffle files at its end.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most bytes of a batch of rows on its way to a Python worker, unless the session has its own bound. Each task holds a batch twice in the JVM, beside its heap, and once in its worker; Spark's default is 64 MB.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that jobs don't depend on its being installed there. Batches get their bound."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "_quillstream_sent", None):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    where = os.path.join(os.path.realpath(tempfile.mkdtemp()), "quillstream.zip")
    with zipfile.ZipFile(where, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "quillstream")):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, root))
    context.addPyFile(where)
    context._quillstream_sent = where


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a local folder only for one-machine sessions without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return "file://" + os.path.join(tempfile.gettempdir(), "quillstream-shared")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder goes with the cluster's own clean-up
        pass


class Scratch:
    """A folder of tables under the shared root. Cut lineage there: the files outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str, under: Scratch | None = None):
        self.spark = spark
        self.path = f"{under.path if under else shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes and rereads a table. The shuffles behind it are then of no more use and are removed when the write is done."""
        where, conf = f"{self.path}/{name}", self.spark.conf
        before = conf.get(CLEAN, None)
        conf.set(CLEAN, "true")
        try:
            df.write.mode("overwrite").parquet(where)
        finally:
            conf.set(CLEAN, before) if before is not None else conf.unset(CLEAN)
        return self.spark.read.parquet(where)

    def drop(self, name: str = "") -> None:
        _delete(self.spark, f"{self.path}/{name}".rstrip("/"))

    def keep(self, df: DataFrame) -> DataFrame:
        """For a result that still reads these tables: the folder goes when the driver ends, not before."""
        atexit.register(_delete, self.spark, self.path)
        return df


def released(run):
    """`run` of mapInArrow, which at its end gives free memory back to the machine: workers wait for the next task with what they hold, beside sorts and joins of the JVM."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError, TypeError):  # another C library than glibc
            pass

    return whole


class Hashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound so that memory stays flat."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(width):
            out = (out + words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return mix(out)


class Bitmap:
    """Which 64-bit hashes may be among those of some rows: two bits each in a bitmap of at most 2^27 bits, sent to the executors. No false negatives."""

    def __init__(self, rows: DataFrame, key: Column, scratch: Scratch, most: int = 27):
        name = f"bitmap-{uuid.uuid4().hex}"
        held = scratch.save(rows.select(key.alias("key")), name)
        self.bits = max(16, min(most, (16 * held.count()).bit_length()))
        high, low = F.shiftrightunsigned("key", 64 - self.bits), F.col("key").bitwiseAND((1 << self.bits) - 1)
        spots = held.select(F.explode(F.array(high + 1, low + 1)).alias("spot"))  # these functions count from 1
        made = spots.groupBy(F.bitmap_bucket_number("spot").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
        flat = np.zeros(1 << (self.bits - 3), np.uint8)
        for row in made.toLocalIterator():  # 2^(bits - 15) rows of 4 KB at most
            part = np.frombuffer(row["bits"], np.uint8)
            flat[(row["at"] - 1) * 4096 :][: len(part)] = part[: max(0, len(flat) - (row["at"] - 1) * 4096)]
        self.sent = scratch.spark.sparkContext.broadcast(flat)
        scratch.drop(name)

    def has(self, keys: np.ndarray) -> np.ndarray:
        held, out = self.sent.value, np.ones(len(keys), bool)
        for spot in (keys.view(np.uint64) >> np.uint64(64 - self.bits), keys.view(np.uint64) & np.uint64((1 << self.bits) - 1)):
            out &= (held[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out

    def keep(self, df: DataFrame, key: Column) -> DataFrame:
        """The rows whose key may be among them."""

        def run(batches):
            for batch in batches:
                yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(self.has(batch.column(batch.num_columns - 1).to_numpy())))

        return df.withColumn("qs_key", key).mapInArrow(run, df.schema)


def crc_mod(col: str, mod: int):
    """crc32 of the id's text, modulo `mod`. A null id has the empty text's."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the links.

    In a round each node points to its smallest neighbour if that is smaller, pointers
    are followed to their ends, and the links are carried over to these ends. Only
    local minima are left, so nodes at least halve and later rounds are small. Each table is written.
    """
    scratch = Scratch(scratch.spark, "components", under=scratch)
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = scratch.save(links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links-0")
    whole, step = None, 0
    while True:
        up = scratch.save(links.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("to")), f"up-{step}-0")
        hop = 0
        while True:
            hop += 1
            over = up.select(F.col("node").alias("at"), F.col("to").alias("end"))
            up = scratch.save(up.join(over, up["to"] == over["at"]).select("node", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), f"up-{step}-{hop}")
            scratch.drop(f"up-{step}-{hop - 1}")
            ended = not up.where("moved").limit(1).count()
            up = up.select("node", "to")
            if ended:
                break
        if whole is None:
            whole = up.select("node", F.col("to").alias("component"))
        else:
            whole = whole.join(up, whole.component == up.node, "left").select(whole.node, F.coalesce("to", "component").alias("component"))
        step += 1
        left = up.select(F.col("node").alias("u"), F.col("to").alias("pu"))
        right = up.select(F.col("node").alias("v"), F.col("to").alias("pv"))
        links = scratch.save(links.join(left, "u").join(right, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), f"links-{step}")
        scratch.drop(f"links-{step - 1}")
        if not links.limit(1).count():
            return scratch.save(whole, "components")
