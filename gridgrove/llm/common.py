"""What the operators share: folds, tokens, shared tables, components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z, on UTF-8 bytes.
WORD_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
# A word of `[^\x20\x09-\x0D]+` after A-Z became a-z; bytes.split() cuts at the rest.
SPACE_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_MIX3 = np.uint64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    """Words of letters and digits, A-Z lower-cased."""
    return text_bytes(text).translate(WORD_TABLE).split()


def space_words(text: str | None) -> list[bytes]:
    """Words between white space, A-Z lower-cased."""
    return text_bytes(text).translate(SPACE_TABLE).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX2
    x ^= x >> np.uint64(27)
    x *= _MIX3
    x ^= x >> np.uint64(31)
    return x


class WordIds(dict):
    """A 64-bit hash of each word, computed once; emptied when it holds `most` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to about `most` bytes of the column each, one row at least."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64))
        begin = 0
        while begin < batch.num_rows:
            base = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, base + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only where the session names none and all runs on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="shared-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a copy in the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def unsized(df: DataFrame) -> DataFrame:
    """A checkpoint without the size that was estimated for it: joins multiply sizes, and in a loop the estimate's digits would double with each round."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again; the files go when the program ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended before
            pass

    atexit.register(drop)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most `rows` rows."""
    return df.limit(rows + 1).count() <= rows


def sample_ids(ids: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows of ids, those of the smallest hashes of the key.

    Rows are first thinned by hash to twice as many as asked for, on average, so that tasks send few of them on.
    """
    share = min(1.0, 2 * most / max(1, ids.count()))
    unit = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return ids.where(unit <= share).orderBy(unit, key).limit(most)


def keep_ids(docs: DataFrame, ids: DataFrame, how: str, key: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs semi- or anti-joined with ids; ids are broadcast only when counted to be few."""
    ids = checkpoint(ids)
    return docs.join(F.broadcast(ids) if small(ids, broadcast_rows) else ids, key, how)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node of the edges.

    Alternates linking every larger neighbour to a node's smallest one and every smaller neighbour
    likewise, until nothing changes; a hub's edges are never gathered in one row.
    """
    pairs = checkpoint(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct())
    was = signature(pairs)
    while was[0]:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v >= u or v = m").select(F.greatest("u", "v").alias("u"), "m").where("u > m").distinct()
        least = large.groupBy("u").agg(F.min("m").alias("t"))
        then = large.join(least, "u").select(F.when(F.col("m") == F.col("t"), F.col("u")).otherwise(F.col("m")).alias("u"), F.col("t").alias("v"))
        pairs = unsized(checkpoint(then.where("u <> v").distinct()))
        now = signature(pairs)
        if was == now:
            break
        was = now
    ends = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(ends)


def signature(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())


LETTER = re.compile(r"[^\W\d_]")
