"""Operator 9, substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, row_key, table, written

#: Bytes between raw cuts on average, bytes since the cut before at least, and characters of a run that reports list, at least.
RAW_MEAN, MIN_GAP, MIN_RUN = 20, 8, 100
#: Bytes of a chunk at most, and bytes from a cut to the next one inside a longer stretch, at least and at most.
LONGEST, NEAR, FAR = 96, 16, 64
_CHUNKS = "at array<int>, d1 array<long>, d2 array<int>, of array<int>"


def _gear() -> np.ndarray:
    """A 16-bit number for each byte, from the splitmix64 rule."""
    z = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(48)).astype(np.uint16)


GEAR = _gear()


def chunk_ends(data: bytes, raw_mean: int = RAW_MEAN, min_gap: int = MIN_GAP) -> np.ndarray:
    """Ends of the chunks of UTF-8 text. The hash is of the last 16 bytes, and every rule looks at the bytes nearby only,
    so an insertion moves the cuts around it and no others.

    Repetitive bytes have no such cuts, or only cuts too close to each other. Stretches of more than `LONGEST` bytes are
    cut again, each time where the hash is least (the first such place) `NEAR` to `FAR` bytes on. Where bytes repeat with
    a period, that is the same place of the period in every text, whatever stands before, and the chunks are alike."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    h = GEAR[b]
    for k in (1, 2, 4, 8):  # sums over the last 2, 4, 8, 16 bytes, each byte shifted once for every later one
        h = np.concatenate([h[:k], h[k:] + (h[:-k] << np.uint16(k))])
    inside = np.append((b[1:] & 0xC0) == 0x80, False)  # a cut here would be inside a character
    at = np.flatnonzero((h < 65536 // raw_mean) & ~inside) + 1
    if len(at):
        at = at[np.diff(at, prepend=-min_gap) >= min_gap]
    at = at if len(at) and at[-1] == len(b) else np.append(at, len(b))
    long = np.flatnonzero(np.diff(at, prepend=0) > LONGEST)
    if not len(long):
        return at
    h, more = np.where(inside, 65536, h.astype(np.int32)), []
    for k in long.tolist():
        lo, hi = int(at[k - 1]) if k else 0, int(at[k])
        while hi - lo > LONGEST:
            lo += NEAR + int(h[lo + NEAR - 1 : lo + FAR].argmin())
            more.append(lo)
    return np.sort(np.concatenate([at, np.array(more, at.dtype)]))


def _order(doc_id: Column, row: Column) -> Column:
    """One number by doc_id (null last), then by place in the input: fixed length, so that its least value needs no sort."""
    doc = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(20,0)"))
    return (doc * F.lit(str(2**54)).cast("decimal(17,0)") + row.cast("decimal(20,0)")).cast("decimal(38,0)")


def chunk_table(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs`, written: doc_id, r1 and r2 (the key of its content), `row` (its rank, unique), and arrays
    with an entry for each chunk of the whole text: d1 and d2, 96 bits of its digest, and `of`, the number of the first chunk
    of the row with this digest (-1 for the first itself). `at` has the places in characters where chunks start, and the length. Null and empty texts have none.
    """

    def cut():
        def of(texts):
            ats, digests, again = [], [], []
            for text in texts:
                data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                ends, lo, own = chunk_ends(data), 0, []
                for hi in ends.tolist():
                    own.append(xxhash.xxh3_128_digest(data[lo:hi]))
                    lo = hi
                chars = ends if not isinstance(text, str) or len(data) == len(text) else np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[ends - 1]
                ats.append(np.concatenate([[0], chars]).astype(np.int32))
                seen: dict[bytes, int] = {}
                again += [-1 if (k := seen.setdefault(x, i)) == i else k for i, x in enumerate(own)]
                digests += own
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            n = np.array([len(x) - 1 for x in ats], np.int64)
            ends, all_ends = np.cumsum([0, *n]).astype(np.int32), np.cumsum([0, *(n + 1)]).astype(np.int32)
            at = np.concatenate(ats) if ats else np.zeros(0, np.int32)
            lists = [(ends, d[:, 0].copy()), (ends, d[:, 1].astype(np.int32)), (ends, np.array(again, np.int32))]
            return [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v)) for e, v in [(all_ends, at), *lists]]

        return of

    r1, r2 = row_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), r1.alias("r1"), r2.alias("r2"), "text", F.monotonically_increasing_id().alias("__id"))
    rows = rows.select("doc_id", "r1", "r2", _order(F.col("doc_id"), F.col("__id")).alias("row"), "text")
    return written(map_texts(rows, cut, _CHUNKS), "chunks")


def duplicate_chunks(chunks: DataFrame) -> DataFrame:
    """The dedup: every chunk but the first with its digest. Returns row, pos (its number in the row) and first (the row that
    keeps the digest).

    Chunks rank by doc_id, row and place; the first stays. Of a row's chunks with one digest only the first is joined.
    """
    each = chunks.select("row", F.posexplode(F.arrays_zip("d1", "d2", "of")).alias("pos", "c")).select("row", "pos", "c.d1", "c.d2", "c.of")
    once = each.where("of < 0").drop("of")
    shared = once.groupBy("d1", "d2").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "first")
    # Written, so that both sides of the join are plain exchanges, which Spark can split where a chunk is very common.
    shared = written(shared, "shared-chunks")
    others = once.join(shared, ["d1", "d2"]).where(F.col("row") > F.col("first")).select("row", "pos", F.col("pos").alias("of"), "first")
    again = each.where("of >= 0").select("row", "pos", "of", F.col("row").alias("first"))
    keeper = F.min("first").over(Window.partitionBy("row", "of"))
    return others.unionByName(again).repartition("row").select("row", "pos", keeper.alias("first"))


def repeated_spans(docs: DataFrame, min_run: int = MIN_RUN, chunks: DataFrame | None = None) -> DataFrame:
    """A report of the dedup: runs of neighbouring repeated chunks of at least `min_run` characters together (1: all of them).

    Returns doc_id, first_doc_id (the smallest doc_id that keeps a chunk of the run), start, length in characters, and r1, r2,
    which name the row by its content. Copies inside one text are found as those in others are. A null doc_id ranks last.
    Rows that repeat another, doc_id and text, are that row and are listed once; rows that share a doc_id with another text
    rank by their place in the input. Null and empty texts and empty tables give no rows; other columns are not read.
    """
    chunks = chunk_table(docs) if chunks is None else chunks
    by_row = Window.partitionBy("row").orderBy("pos")
    hits = duplicate_chunks(chunks).withColumn("__new", (F.col("pos") != F.coalesce(F.lag("pos").over(by_row) + 1, F.lit(-1))).cast("int"))
    runs = hits.withColumn("__run", F.sum("__new").over(by_row)).groupBy("row", "__run").agg(F.min("first").alias("first"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    # The first of the rows with one content stands for them; the others are copies of it as a whole.
    own = chunks.groupBy("r1", "r2").agg(F.min("row").alias("row")).select("row")
    spans = runs.join(chunks.select("row", "doc_id", "r1", "r2", "at").hint("merge"), "row").join(own.hint("merge"), "row", "left_semi")
    length = F.get("at", F.col("hi") + 1) - F.get("at", "lo")
    doc = F.floor(F.col("first") / F.lit(str(2**54)).cast("decimal(17,0)"))
    first = F.when(doc < F.lit(str(2**63)).cast("decimal(20,0)"), doc).cast("long")
    return spans.select("r1", "r2", "doc_id", first.alias("first_doc_id"), F.get("at", "lo").alias("start"), length.cast("long").alias("length")).where(F.col("length") >= min_run)


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`docs` with the spans (r1, r2, start, length) of each row cut from its text; DataFrame functions only.

    A row is its content, so repeated rows are cut alike, rows that share a doc_id each by their own spans, and rows with a
    null doc_id too. Spans must not overlap; null texts stay null, an empty table or no spans change nothing.
    """
    by_row = spans.groupBy(F.col("r1").alias("__r1"), F.col("r2").alias("__r2")).agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("__spans"))
    left = F.aggregate(
        "__spans", F.struct(F.array().cast("array<string>").alias("t"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(F.concat(a["t"], F.array(F.substr(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")))).alias("t"), (s["start"] + s["length"]).cast("long").alias("at")),
        lambda a: F.concat(F.array_join(a["t"], ""), F.substr(F.col("text"), (a["at"] + 1).cast("int"))),
    )
    r1, r2 = row_key(F.col("doc_id"), F.col("text"))
    out = docs.withColumns({"__r1": r1, "__r2": r2}).join(by_row, ["__r1", "__r2"], "left")
    return out.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(left)).select(*docs.columns)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeated_spans() of all documents: the runs of 100 characters and more."""
    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "first_doc_id", F.col("start").cast("long"), "length")
