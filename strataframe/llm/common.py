"""Shared pieces of the corpus operators: word splitting, work tables, tokenizing."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import dropping_tables, work_dir, written

__all__ = ["BLANKS", "REMEMBERED", "SHINGLE", "SIMILARITY", "ascii_words", "dropping_tables", "forget_words", "map_texts", "row_key", "small_batches", "table", "word_tokenizer_path", "work_dir", "written"]

#: The white space of the contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
_SPLIT = re.compile("[\x20\x09-\x0d]+")
# str.split() also breaks at these; texts that hold one take the slower way.
_OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SHINGLE, SIMILARITY = 5, 0.8
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ascii_words(text: str) -> list[str]:
    """Maximal runs of characters other than `BLANKS`."""
    if _OTHER_BLANKS.search(text):
        return [w for w in _SPLIT.split(text) if w]
    return text.split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of whole texts: few rows each, so that long texts fit a Python worker. Sets the session's
    spark.sql.execution.arrow.maxRecordsPerBatch, which plans read when they run; Spark's own bound in bytes stays.

    Also lets workers on this machine find this package; on a cluster it is installed or sent with --py-files.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [_ROOT])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_texts(df: DataFrame, make, schema: str) -> DataFrame:
    """`df` without its column `text`, beside the columns of `schema` that Python computes from it.

    `make()` is called once a task and gives a function from a list of texts (None for null) to the new columns, or to
    (rows, columns) where `rows` says which row of the batch each new row belongs to. Other columns pass through as Arrow
    data, so that no id loses digits and no type is converted.
    """
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != "text"]
    new = StructType.fromDDL(schema)
    out = StructType([df.schema[c] for c in keep] + new.fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types, f = [to_arrow_type(x.dataType) for x in new.fields], make()
        for batch in batches:
            got = f(batch.column("text").to_pylist())
            old = [batch.column(c) for c in keep]
            if isinstance(got, tuple):
                rows, got = got
                rows = pa.array(rows, pa.int64())
                old = [c.take(rows) for c in old]
            columns = [x if isinstance(x, pa.Array) else pa.array(x, t, from_pandas=False) for x, t in zip(got, types)]
            yield pa.RecordBatch.from_arrays(old + columns, names=[*keep, *new.names])

    return df.select(*keep, "text").mapInArrow(run, out)


def row_key(*columns: Column) -> tuple[Column, Column]:
    """128 bits that name a row by its content; null-safe, the same for repeated rows."""
    parts = [F.coalesce(c.cast("string"), F.lit("\0null")) for c in columns]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *reversed(parts))


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: What a worker remembers of tokenizers; modules with encoders of their own add theirs.
REMEMBERED = [_tokenizer]


def forget_words() -> None:
    """Drop the encoders of this Python worker. Workers are used again by later stages; those that keep words of their own
    call this first, so that a worker holds the words of one operator at a time."""
    for cache in REMEMBERED:
        cache.cache_clear()


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
