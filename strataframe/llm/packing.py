"""Operator 6, best-fit packing planned over a histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, table, word_tokenizer_path, written
from .piece_encoder import piece_encoder

CAPACITY, END_ID = 2048, 0
_PIECES = "piece int, start long, length long, ids_crc32 long"
_SLOTS = "length long, first_rank long, n long, per_bin long, first_sequence long, first_offset long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of at most `capacity` ids of each document. Null and empty text are one piece, the end alone;
    repeated rows give their pieces again, a null doc_id stays null, an empty table gives an empty table."""

    def cut():
        enc = piece_encoder(tokenizer)

        def of(texts):
            rows = []
            for i, ids in enumerate(enc.encode([t if isinstance(t, str) else "" for t in texts])):
                ids += END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append((i, k, at, len(part) // 4, zlib.crc32(part)))
            columns = [list(c) for c in zip(*rows)] or [[]] * 5
            return columns[0], columns[1:]

        return of

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, _PIECES)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Bins are kept as runs (first sequence, number) by room left, so the work and the plan depend on the number
    of different lengths, never on the number of documents. A run (length, first_rank, n, per_bin,
    first_sequence, first_offset) says: the piece of that length with rank first_rank + j goes to sequence
    first_sequence + j // per_bin at first_offset + (j % per_bin) * length.
    """
    slots, opened, rooms, runs = [], 0, [], {}

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):  # the fullest bins that still have room
                room = rooms[at]
                first, number = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first, number = capacity, opened, -(-left // (capacity // length))
                opened += number
            each = room // length
            full = min(number, left // each)
            last = min(left - full * each, each) if full < number else 0
            n = full * each + last
            slots.append((length, rank, n, each, first, capacity - room))
            put(room - each * length, first, full)
            if last:
                put(room - last * length, first + full, 1)
                put(room, first + full + 1, number - full - 1)
            else:
                put(room, first + full, number - full)
            left, rank = left - n, rank + n
    return slots


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """Add `sequence_id` and `offset` to rows with `doc_id`, `piece` and `length` (1 to `capacity`).

    Ranks within a length are counted in `buckets` parts by hash and then offset, so no length, however common,
    meets in one task. The plan has a few rows for each of at most `capacity` lengths, so it is sent to all executors; the
    counts of parts are dealt as the ranked rows are already. Repeated rows get slots of their own, ties of equal rows go
    either way. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    parts = buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = pieces.groupBy("length").count()  # at most `capacity` rows
    slots = plan_slots({r["length"]: r["count"] for r in counts.collect()}, capacity)
    plan = spark.createDataFrame(slots, _SLOTS)
    dealt = pieces.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    before = (
        dealt.groupBy("length", "__part").count()
        .withColumn("__before", F.sum("count").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    )
    ranked = (
        dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
        .join(before, ["length", "__part"])
        .withColumn("__rank", F.col("__rank") + F.col("__before"))
    )
    j = F.col("__rank") - F.col("first_rank")
    return (
        ranked.join(F.broadcast(plan), ["length"])
        .where((j >= 0) & (j < F.col("n")))
        .withColumn("sequence_id", F.col("first_sequence") + F.floor(j / F.col("per_bin")).cast("long"))
        .withColumn("offset", F.col("first_offset") + (j % F.col("per_bin")) * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places. Null text: empty, which is one id."""
    return best_fit_pack(written(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_documents() of all documents."""
    return pack_documents(table(spark, sf_dir, "documents"), word_tokenizer_path())
