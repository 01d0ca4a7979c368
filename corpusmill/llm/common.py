"""Pieces shared by the training-data operators: table access, shared storage, native text expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Reads the named columns of one table; all columns if none are named."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; on a local master, a new one where none is."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpusmill-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(frame: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are checkpointed in the shared folder, where they outlive lost executors."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them again. `removed` deletes the files."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.written_to = path
    return out


def removed(frame: DataFrame) -> None:
    """Deletes what `written` wrote for a frame, once nothing reads it any more."""
    if path := getattr(frame, "written_to", None):
        spark = frame.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def private(docs: DataFrame, name: str) -> str:
    """A column name that no column of the frame has, upper or lower case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value to a lambda variable, so that it is computed once even where the body uses it in inner lambdas."""
    return F.transform(F.array(value), body)[0]


def whole(text: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def lowered(text: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Array of the text's words `[^\\x20\\x09-\\x0D]+`."""
    bare = F.trim(text, F.lit("\t\n\x0b\f\r "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def n_words(text: Column) -> Column:
    """Number of words, without keeping them."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def remainder(mod: int) -> Column:
    """crc32 of the doc_id as text, modulo mod; a null doc_id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod, F.lit(-1))


def clean(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass")


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions of the session."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class Vocabulary(dict):
    """Numbers of lower-cased words in the order in which they come, and their 64-bit hashes."""

    def __init__(self, first: tuple[int, ...] = ()) -> None:
        super().__init__()
        self.hashes = list(first)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return number

    def numbers(self, text: str | None, after: int = 0) -> np.ndarray:
        """Numbers of a text's words `[^\\x20\\x09-\\x0D]+`, then so many zeros."""
        words = clean(text).translate(_LOWER).split()
        out = np.zeros(len(words) + after, np.int32)
        out[: len(words)] = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return out

    def array(self) -> np.ndarray:
        return np.array(self.hashes, np.uint64)


class Shipped:
    """A broadcast of a Python object with the code of its class; a worker unpacks it once."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):  # noqa: ANN201
        if not hasattr(self._sent, "unpacked"):
            self._sent.unpacked = cloudpickle.loads(self._sent.value)
            self._sent.__dict__.pop("_value", None)  # one copy is enough
        return self._sent.unpacked


def extend(docs: DataFrame, made: T.StructType, fill: Callable[[pa.RecordBatch], list[list]], drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns that Python fills batch by batch; they replace input columns of the same names, upper or lower case.

    A batch is all that a worker holds, so memory doesn't grow with the input. Columns in drop are read but not returned.
    """
    gone = {c.lower() for c in (*made.names, *drop)}
    keep = [c for c in docs.columns if c.lower() not in gone]
    types = [f.type for f in to_arrow_schema(made)]
    names = [*keep, *made.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array(values, t) for values, t in zip(fill(batch), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=names)

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *made.fields]))
