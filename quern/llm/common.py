"""What the operators of this subpackage share: the shared work folder, lineage cuts, Arrow helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import table

__all__ = ["Bits", "apart", "bytes_of", "commit_file", "dropped", "filesystem", "in_struct", "new_path", "parts_of", "publish", "quoted", "ready", "sha256_of_ids", "shared_dir", "stored", "table", "texts_of"]

_LOCAL: dict[str, str] = {}


def ready(spark: SparkSession) -> None:
    """Lets Python workers find this package where it isn't installed but lies in the same place (elsewhere: --py-files)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a qualified URI.

    It is ``spark.checkpoint.dir``. Where that is unset a temporary folder is used, on a
    local master only: on a cluster other machines could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="quern-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        base = f"file://{_LOCAL[app]}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(conf).makeQualified(path).toString()


def new_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}/{name}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = parent.getFileSystem(conf)
    fs.mkdirs(parent)
    fs.deleteOnExit(parent)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Removes the files behind frames from stored(), once nothing reads them any more."""
    for df in frames:
        drop_path(df.sparkSession, df._quern_path)


def filesystem(uri: str):
    """pyarrow's file system for a path in the shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def publish(fs, tried: str, path: str) -> None:
    """Gives a whole file its name. Another attempt of the same task may have been first; its file holds the same."""
    from pyarrow import fs as pafs

    try:
        fs.move(tried, path)
    except OSError:
        if fs.get_file_info(path).type != pafs.FileType.File:
            raise
        fs.delete_file(tried)


def commit_file(uri: str, parts: list[bytes], attempt: int) -> int:
    """Writes a file under a name of this attempt, then renames it, so that readers see whole files only."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    tried = f"{path}.tried-{attempt}"
    with fs.open_output_stream(tried) as out:
        for x in parts:
            out.write(x)
        size = out.tell()
    publish(fs, tried, path)
    return size


class Bits:
    """A filter over 64-bit keys of a fixed size, whatever their number: it says no only for keys that are none of them."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame, column: str, n_bits: int) -> Bits:
        """Of a column of integers. What comes to the driver is a row for each 64 bits that aren't empty: n_bits / 64 at most."""
        at = f"explode(array({column} & {n_bits - 1}L, shiftrightunsigned({column}, 32) & {n_bits - 1}L)) as at"
        bits = keys.selectExpr(at).selectExpr("cast(shiftright(at, 6) as int) as word", "shiftleft(1L, cast(at & 63L as int)) as bit")
        found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        words = np.zeros(n_bits // 64, np.uint64)
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return cls(words)

    def packed(self) -> bytes:
        """For a broadcast, whose file each executor keeps: of few keys it is short."""
        return zlib.compress(self.words.tobytes(), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Bits:
        return cls(np.frombuffer(zlib.decompress(data), np.uint64))

    def have(self, keys: np.ndarray) -> np.ndarray:
        """For each key (64 bits, of any sign) whether it may be one of them."""
        keys, last = keys.view(np.uint64), np.uint64(64 * len(self.words) - 1)
        out = np.ones(len(keys), bool)
        for at in (keys & last, (keys >> np.uint64(32)) & last):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Python strings of a column; null becomes the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def parts_of(batch: pa.RecordBatch, most: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in parts with fewer than so many bytes of text, but for the last row of a part."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = [0, *(np.flatnonzero(np.diff(ends // most, prepend=0)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(at, at[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a column, without decoding; null becomes the empty text."""
    col = batch.column(name)
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


#: Kinds of keys that apart() tells.
KINDS = 1 << 18


def apart(rows: DataFrame, others: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key (an integer in both) is surely none of the others', and those whose key may be one.

    The former need no shuffle when rows are joined with others. What is broadcast has KINDS rows at most, whatever the input.
    """
    kind = F.col(key).bitwiseAND(KINDS - 1).alias("_kind")
    taken = F.broadcast(others.select(kind).distinct())
    marked = rows.select("*", kind)
    return tuple(marked.join(taken, "_kind", how).drop("_kind") for how in ("left_anti", "left_semi"))


def in_struct(docs: DataFrame) -> DataFrame:
    """doc_id (a long), same (a hash of the text), row: a struct of all columns, so that no name of theirs clashes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("same"), F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sha256_of_ids(ids: str) -> F.Column:
    """Hex SHA-256 of an array of ids, as strings in string order, comma-joined."""
    return F.sha2(F.concat_ws(",", F.array_sort(F.transform(F.col(ids), lambda x: x.cast("string")))), 256)
