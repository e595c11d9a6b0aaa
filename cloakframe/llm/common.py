"""What several operators share: scratch tables, Arrow text access and vectorised hashing of bytes and words."""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a kernel works on at once; a longer text forms a block of its own.
BLOCK_BYTES = 1 << 19

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Base of the polynomial over bytes, its inverse modulo 2**64, and odd factors for the places in a word sequence.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACES = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


# -- scratch tables ----------------------------------------------------------------------------------------------


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without: there a
    folder in the warehouse serves."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"


#: Scratch tables written by this process and not released yet, in order.
_made: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage, survives lost executors, and gives
    the planner a true size for choosing joins. The files stay until :func:`release`."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every scratch table and every one-run digest index of this application; frames that still read them
    must have been written first."""
    for t in spark.catalog.listTables():
        if t.name.startswith("digest_index_"):
            spark.sql(f"DROP TABLE {t.name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/llm-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mark() -> int:
    """A point in the order of scratch tables, for :func:`release_since`."""
    return len(_made)


def release_since(spark: SparkSession, point: int, keep: DataFrame | None = None) -> None:
    """Delete the scratch tables made since a point, and all one-run digest indexes, but for the files that ``keep``
    reads: what a stage needed, once its result is written."""
    kept = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in keep.inputFiles()} if keep is not None else set()
    staying = []
    for path in _made[point:]:
        if path.split(":", 1)[-1].lstrip("/") in kept:
            staying.append(path)
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made[point:] = staying
    for t in spark.catalog.listTables():
        if t.name.startswith("digest_index_"):
            spark.sql(f"DROP TABLE {t.name}")


# -- Arrow -------------------------------------------------------------------------------------------------------


def text_blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of rows of about ``most`` bytes.
    Nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def settled(kernel: Callable) -> Callable:
    """A kernel of Arrow batches that gives the memory it has freed back to the machine when its task ends. Spark keeps
    Python workers for later tasks and stages, so what a worker holds on to adds up to what its executor needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone keeps freed pages
                trim(0)

    return run


# -- hashing -----------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for ordinary blocks only."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 2 * BLOCK_BYTES)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
        if size <= 4 * BLOCK_BYTES:
            _powers[int(base)] = have
    return have[:n]


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Bytes between words for the shingling operators: space and 0x09 to 0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes between words for the bag-of-words operators: all ASCII but letters and digits.
PUNCT = np.ones(256, bool)
PUNCT[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    PUNCT[_a:_b] = False


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word lower-cased in ASCII, number of words of each row). Words never cross rows."""
    n = len(data)
    rows = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:][offsets[1:] > 0] - 1
    last[cut] = inside[cut]
    ends = np.flatnonzero(last) + 1
    acc = np.empty(n + 1, np.uint64)
    acc[0] = 0
    np.cumsum((ASCII_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=acc[1:])
    hashes = mix((acc[ends] - acc[starts]) * powers(INVERSE, n)[starts])
    return hashes, np.diff(np.searchsorted(starts, offsets))


def sequences(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``size`` words within a row, number of runs of each row)."""
    total = len(hashes)
    runs = np.maximum(counts - size + 1, 0)
    if total < size or not runs.any():
        return np.zeros(0, np.uint64), runs
    acc = hashes[: total - size + 1] * PLACES[0]
    for k in range(1, size):
        acc = acc + hashes[k : total - size + 1 + k] * PLACES[k]
    ends = np.cumsum(counts)
    ok = np.ones(total, bool)
    for k in range(1, size):  # runs that start in the last size-1 words of a row would leave it
        at = ends - k
        ok[at[(at >= ends - counts) & (at >= 0)]] = False
    return mix(acc[ok[: total - size + 1]]), runs


# -- runs of integers in a cell -----------------------------------------------------------------------------------


def squeeze(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes: small numbers and small differences take little room."""
    wide = np.ascontiguousarray(a.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(wide.tobytes())


def expand(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(-1)


def squeeze_sorted(a: np.ndarray) -> bytes:
    return squeeze(np.diff(a, prepend=np.uint64(0)))


def expand_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b), dtype=np.uint64)


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For keys that are hashes: which may be in the bitmap."""
    slot = (hashes.view(np.uint64) & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


# -- connected components -------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected edges (a, b): component is the smallest node reachable.

    Alternating large-star and small-star steps until all edges form stars; each round is written to the shared folder.
    Edges point from the smaller node to the larger, so a star hangs from the smallest node of its component. A node
    with very many neighbours is handled by partial aggregation and by joins that adaptive execution can split."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    e = materialize(e, "edges")
    while not _stars(e):
        # large star: larger neighbours of u hang from the smallest of u and its neighbours
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours hang from the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = materialize(small.select(F.col("m").alias("a"), F.col("v").alias("b")).union(small.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct(), "edges")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every node of the edges (a < b) is either a centre or hangs from just one."""
    ends = e.select(F.col("a").alias("node"), F.lit(None).cast("bigint").alias("centre")).union(e.select(F.col("b").alias("node"), F.col("a").alias("centre")))
    node = ends.groupBy("node").agg(F.min("centre").alias("low"), F.max("centre").alias("high"), F.count("centre").alias("hangs"), F.count(F.lit(1)).alias("all"))
    return not node.where("low <> high OR hangs > 0 AND hangs < all").count()


# -- bitmaps: a filter of bounded size in front of an exact join ---------------------------------------------------

BITMAP_MAX_BITS = 1 << 29


def marked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows with a column near: false only if the long key is none of the wanted ones.

    The keys' bitmap, about 16 bits a key and BITMAP_MAX_BITS at most, is broadcast in pieces of 4 KB; built-in expressions only."""
    bits = min(BITMAP_MAX_BITS, 1 << max(16, math.ceil(math.log2(16 * max(1, wanted.count())))))
    slot = F.pmod(key, F.lit(bits)) + 1
    pieces = wanted.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))
    at = rows.withColumn("_slot", slot).withColumn("_bucket", F.bitmap_bucket_number("_slot")).withColumn("_at", F.bitmap_bit_position("_slot").cast("int"))
    bit = F.expr("shiftright(cast(conv(hex(substring(_bits, _at div 8 + 1, 1)), 16, 10) AS int), _at % 8) & 1 = 1")
    return at.join(F.broadcast(pieces), "_bucket", "left").withColumn("near", F.coalesce(bit, F.lit(False))).drop("_bucket", "_bits", "_slot", "_at")


def parted(df: DataFrame, key: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose long key is none of the wanted ones, rows that an exact join has to decide), with the columns of df.
    ``wanted`` has the one column ``key``. What few rows are joined, the others are not shuffled for, at any size."""
    rows = marked(df.select(F.struct("*").alias("row"), key.alias("key")), "key", wanted)
    return rows.where("NOT near").select("row.*"), rows.where("near").select("row.*")


def bitmap_of(keys: DataFrame, column: str, hashed: bool = False) -> tuple[np.ndarray, int]:
    """A bitmap of long keys by their hash (or by themselves, if they are hashes): about 16 bits a key and 64 MB at
    most, or-ed together on the executors. It has no false negatives; past the bound more false positives pass,
    which the exact step behind it removes."""
    count = keys.count()
    bits = 1 << min(29, max(16, math.ceil(math.log2(max(1, count) * 16))))
    spans = max(1, bits >> 16)

    def pack(batches):
        part: dict[int, np.ndarray] = {}
        for b in batches:
            for s, o in zip(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), strict=True):
                part.setdefault(int(s), np.zeros(8192, np.uint8))[o >> 3] |= np.uint8(1 << (o & 7))
        for s, v in part.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["span", "bits"])

    slots = keys.select(F.pmod(F.col(column) if hashed else F.xxhash64(F.col(column)), F.lit(bits)).alias("slot")).select(
        F.shiftright("slot", 16).cast("int").alias("span"), F.col("slot").bitwiseAND(65535).cast("int").alias("at")
    ).distinct()
    out = np.zeros((spans, 8192), np.uint8)
    width = max(1, min(spans, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    for row in slots.repartition(width, "span").mapInArrow(pack, "span int, bits binary").collect():
        out[row.span] |= np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1), bits
