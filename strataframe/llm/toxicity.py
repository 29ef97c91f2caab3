"""Operator 10, toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy."""

from __future__ import annotations

import copy
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import each_key_in_one_task
from .common import ascii_words, dropping_tables, forget_words, map_texts, small_batches, table, written
from .language_id import fold

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
#: Labelled documents of a block, about, and the bytes of features that close one; steps over documents that a part of training
#: takes at least, within so many passes; rows of each label that a language's threshold needs; words that a worker remembers when
#: it scores, and when it makes features.
BLOCK, BLOCK_BYTES, STEPS, PASSES, CALIBRATE, REMEMBER, KNOWN = 2000, 8 << 20, 36_000, 6, 20, 200_000, 50_000
#: Moves are summed over tasks as whole numbers of 1/UNIT, so that their order changes nothing, each MOST at most.
UNIT, MOST = 2.0**24, 2.0**16
_EDGE = ".,;:!?\"'()[]{}*$%&#|<>-"


_FIRST = {n: zlib.crc32(f"{n}:".encode()) for n in (0, 4, 5, 6)}


def word_parts(word: str) -> tuple[int, ...]:
    """Buckets of a word: itself and its prefixes of 4 to 6 letters. Its vector is their sum."""
    w = word.lower().strip(_EDGE)
    return tuple([zlib.crc32((w[:n] if n else w).encode("utf-8", "surrogatepass"), first) % BUCKETS for n, first in _FIRST.items() if n < len(w)])


def packed_word(parts: tuple[int, ...]) -> bytes:
    """4 buckets (or the last of them again) and how many count."""
    return struct.pack("<4HB", *parts, *(parts[-1:] or (0,)) * (4 - len(parts)), len(parts))


def packed(words: list[bytes]) -> bytes:
    """How many different words there are, these, and which of them stands at each place, in 2 bytes or in 4."""
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    return struct.pack("<I", len(number)) + b"".join(number) + np.array(ids, _place(len(number))).tobytes()


def _place(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of the different words, how many of them count, and the word at each place."""
    n = struct.unpack_from("<I", data)[0]
    words = np.frombuffer(data, "u1", 9 * n, 4).reshape(-1, 9)
    return np.ascontiguousarray(words[:, :8]).view("<u2"), words[:, 8], np.frombuffer(data[4 + 9 * n :], _place(n))


def word_features(text: str | None, known: dict[str, bytes] | None = None) -> bytes:
    """The packed words of a text; `known` remembers words."""
    known = {} if known is None else known
    words = ascii_words(text or "")
    for w in set(words).difference(known):
        known[w] = packed_word(word_parts(w))
    return packed([known[w] for w in words])


def read_features(data: bytes) -> list[tuple[int, ...]]:
    """The buckets of each word of a text."""
    parts, lengths, ids = unpacked(data)
    words = [tuple(p[:k]) for p, k in zip(parts.tolist(), lengths)]
    return [words[i] for i in ids.tolist()]


class Block:
    """Documents to learn from: parts[i] holds lengths[i] buckets of word i, `flat` those of all from offsets[i] on; of a document
    `words` are its different words and `local` says which of them stands at each place."""

    def __init__(self, features: list[bytes]):
        docs = [unpacked(f) for f in features]
        parts = np.concatenate([np.zeros((0, 4), "<u2"), *(p for p, _, _ in docs)])
        lengths = np.concatenate([np.zeros(0, "u1"), *(n for _, n, _ in docs)]).astype(np.int64)
        key = np.ascontiguousarray(parts).view("<u8").ravel() + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
        parts, lengths = parts[first].astype(np.int64), lengths[first]
        self.parts, self.lengths = parts, lengths
        self.flat, self.offsets = parts[np.arange(4) < lengths[:, None]], np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        ends = np.cumsum([0, *(len(n) for _, n, _ in docs)])
        self.docs = [(number[a:b], ids.astype(np.int64)) for a, b, (_, _, ids) in zip(ends[:-1], ends[1:], docs)]

    def sums(self, table: np.ndarray) -> np.ndarray:
        """The vector of each word."""
        out, some = np.zeros((len(self.offsets) - 1, DIM), np.float32), np.diff(self.offsets) > 0
        if some.any():
            out[some] = np.add.reduceat(table[self.flat], self.offsets[:-1][some], axis=0)
        return out

    def seen(self, toxic: list[int], at: list[int]) -> np.ndarray:
        """In how many of the documents `at` of each label each bucket is."""
        out, has = np.zeros((2, BUCKETS), np.int64), np.zeros(BUCKETS, bool)
        for d in at:
            words = self.docs[d][0]
            some = self.parts[words][np.arange(4) < self.lengths[words][:, None]]
            has[some] = True
            out[toxic[d]] += has
            has[some] = False
        return out


def log_odds(seen: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of the label by bucket: `seen` documents of each label hold it, of `rows` documents."""
    seen = seen + 0.5
    odds = np.log(seen[1] / (1 + rows[1])) - np.log(seen[0] / (1 + rows[0]))
    return odds * (seen.sum(0) >= 4) / 6  # what is rare says nothing


class ConvNet:
    """Word vectors, filters of several widths, the largest value of each filter over the text, one output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
        self.filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float64)
        self.squares = {name: np.full(value.shape, 1e-4) for name, value in self.values().items()}

    def values(self) -> dict[object, np.ndarray]:
        return {"table": self.table, "out": self.out, "bias": self.bias, "shift": self.shift, **self.filters}

    def vectors(self, parts: list[tuple[int, ...]]) -> np.ndarray:
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter((b for p in parts for b in p), np.int64, int(n.sum()))
        out, some = np.zeros((len(parts), DIM), np.float32), n > 0
        if some.any():
            out[some] = np.add.reduceat(self.table[flat], (np.cumsum(n) - n)[some], axis=0)
        return out

    def _pool(self, taps: dict, ids: np.ndarray, places: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
        """taps[w][j]: each word's share in a filter of width w at tap j. Texts shorter than a filter are padded with nothing.
        The places of the largest values are for training only."""
        top, where = [], []
        for w in WIDTHS:
            n = max(1, len(ids) - w + 1)
            z = np.zeros((n, FILTERS), np.float32)
            for j in range(w):
                part = taps[w][j][ids[j : j + n]]
                z[: len(part)] += part
            top.append(z.max(0))
            if places:
                where.append(z.argmax(0))
        return np.maximum(np.concatenate(top) + self.bias, 0), where

    def taps(self, vectors: np.ndarray) -> dict:
        return {w: [vectors @ self.filters[w][j] for j in range(w)] for w in WIDTHS}

    def probability(self, pooled: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift[0], -30, 30))))

    def start(self, odds: np.ndarray) -> "ConvNet":
        """Word vectors from the log odds of their buckets along one direction."""
        self.turn(odds)
        for w in WIDTHS:
            self.filters[w][:, 0, : FILTERS // 2] = np.abs(self.filters[w][:, 0, : FILTERS // 2]) + 0.3
        self.out[:] = np.abs(self.out)
        return self

    def turn(self, odds: np.ndarray) -> None:
        self.table[:, 0] += odds.astype(np.float32)

    def learn(self, block: Block, toxic: list[int], order: list[int], rows: np.ndarray, rate: float = 0.05) -> None:
        """Stochastic steps with per-weight rates, a document each; `rows` are the documents of each label in all blocks."""
        weight = rows.sum() / (2 * np.maximum(1, rows))
        squares, filters = self.squares, self.filters

        def step(name, value, grad, at=...):
            squares[name][at] += grad**2
            value[at] -= rate * grad / np.sqrt(squares[name][at])

        sums = block.sums(self.table)
        for d in order:
            words, local = block.docs[d]
            if not len(local):
                self.shift -= rate * 0.1 * (self.probability(np.maximum(self.bias, 0)) - toxic[d])
                continue
            pooled, where = self._pool(self.taps(sums[words]), local)
            gap = weight[toxic[d]] * (self.probability(pooled) - toxic[d])
            if abs(gap) < 0.02:
                continue
            back = gap * self.out * (pooled > 0)
            step("out", self.out, gap * pooled)
            step("bias", self.bias, back)
            self.shift -= rate * 0.1 * gap
            who, what = [], []
            for k, w in enumerate(WIDTHS):
                b = back[k * FILTERS : (k + 1) * FILTERS]
                on = np.flatnonzero(b)
                grad = np.zeros_like(filters[w])
                for j in range(w):
                    f = on[where[k][on] + j < len(local)]
                    i = words[local[where[k][f] + j]]
                    grad[j][:, f] = sums[i].T * b[f]
                    who.append(i)
                    what.append((filters[w][j][:, f] * b[f]).T)
                step(w, filters[w], grad)
            moved, at = np.unique(np.concatenate(who), return_inverse=True)
            each = np.zeros((len(moved), DIM))
            np.add.at(each, at, np.concatenate(what))
            counts = np.arange(4) < block.lengths[moved][:, None]
            at, place = np.unique(block.parts[moved][counts], return_inverse=True)  # words, and parts of one, may share a bucket
            grad = np.zeros((len(at), DIM))
            np.add.at(grad, place, np.repeat(each, block.lengths[moved], axis=0))
            step("table", self.table, grad, at)
            sums[moved] = (self.table[block.parts[moved]] * counts[:, :, None]).sum(1)

    def moves(self, before: "ConvNet", rows: int) -> np.ndarray:
        """What has changed since `before`, in whole units that can be summed over blocks: of the table by bucket, with how many
        blocks moved a bucket, of the rest times the rows learned from."""
        out = []
        for now, old in ((self.values(), before.values()), (self.squares, before.squares)):
            out += [np.rint(np.clip(now[k].astype(float) - old[k], -MOST, MOST) * UNIT).ravel() * (1 if k == "table" else rows) for k in now]
        return np.concatenate([*out, (self.squares["table"] != before.squares["table"]).any(1), [rows]]).astype(np.int64)

    def move(self, total: np.ndarray) -> None:
        """Take the mean of the blocks' moves: of those that moved a bucket, and by rows for the rest."""
        times, rows, at = np.maximum(1, total[-1 - BUCKETS : -1]), max(1, int(total[-1])), 0
        for name, value in [*self.values().items(), *self.squares.items()]:
            part = total[at : at + value.size].reshape(value.shape) / UNIT
            value += (part / (times[:, None] if name == "table" else rows)).astype(value.dtype)
            at += value.size

    @staticmethod
    def fit(texts: list[list[tuple[int, ...]]], toxic: list[int], epochs: int = 6, rate: float = 0.05, seed: int = 7) -> "ConvNet":
        """From the buckets of each word of each text, as one block."""
        block, rng, rows = Block([packed([packed_word(w) for w in t]) for t in texts]), np.random.default_rng(seed), np.bincount(np.asarray(toxic, int), minlength=2)
        net = ConvNet(seed).start(log_odds(block.seen(toxic, range(len(texts))), rows))
        for _ in range(epochs):
            net.learn(block, toxic, rng.permutation(len(texts)), rows, rate)
        return net


class Scorer:
    """Scores texts with words remembered by their shares in each filter; memory is bounded by `remember` words."""

    def __init__(self, net: ConvNet, remember: int = REMEMBER):
        self.net, self.remember = net, remember
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = {w: [np.zeros((0, FILTERS), np.float32)] * w for w in WIDTHS}

    def scores(self, texts: list[str]) -> list[float]:
        return self._scores([ascii_words(t) for t in texts], word_parts)

    def of_parts(self, texts: list[list[tuple[int, ...]]]) -> list[float]:
        """Scores of texts whose words are given as their buckets."""
        return self._scores(texts, lambda w: w)

    def _scores(self, lists: list[list], parts_of) -> list[float]:
        words = set().union(*lists)
        new = words.difference(self.number)
        if len(self.number) + len(new) > self.remember:
            self.reset()
            new = words
        if new:
            new = sorted(new)
            for w in new:
                self.number[w] = len(self.number)
            taps = self.net.taps(self.net.vectors([parts_of(w) for w in new]))
            self.rows = {w: [np.vstack([old, add]) for old, add in zip(self.rows[w], taps[w])] for w in WIDTHS}
        number = self.number.__getitem__
        return [self.net.probability(self.net._pool(self.rows, np.fromiter(map(number, ws), np.int64, len(ws)), False)[0] if ws else np.maximum(self.net.bias, 0) * 0) for ws in lists]


def threshold(scores: np.ndarray, toxic: np.ndarray, times: np.ndarray | None = None) -> float:
    """The score from which rows count as toxic: 0.5, or the middle between two scores that gets at least two rows more right
    and has the best balanced accuracy, the nearest to 0.5 of these. 0.5 with fewer than `CALIBRATE` rows of a label. A row
    stands for `times` rows."""
    times = np.ones(len(scores), np.int64) if times is None else times
    n1, n0 = times[toxic == 1].sum(), times[toxic == 0].sum()
    if min(n1, n0) < CALIBRATE:
        return 0.5
    s, place = np.unique(scores, return_inverse=True)
    count = lambda label: np.bincount(place[toxic == label], times[toxic == label], len(s))
    at = np.concatenate([[0.5], (s[1:] + s[:-1]) / 2])
    below = np.searchsorted(s, at)  # scores that are less
    high = n1 - np.concatenate([[0], np.cumsum(count(1))])[below]
    low = np.concatenate([[0], np.cumsum(count(0))])[below]
    good = [0, *(i for i in range(1, len(at)) if high[i] + low[i] >= high[0] + low[0] + 2)]
    return float(at[max(good, key=lambda i: (high[i] / n1 + low[i] / n0, -abs(at[i] - 0.5)))])


def feature_blocks(docs: DataFrame, known: DataFrame, shards: int) -> DataFrame:
    """The features of all labelled documents in blocks: shard, part and, for each document, toxic, held (a quarter, by hash),
    lang and f. With as many shuffle partitions as shards, what is in a block, and in which order, depends on the documents alone.
    Of rows that share a doc_id one counts."""
    long = F.col("doc_id").cast("long").alias("doc_id")
    shard = F.pmod(F.hash("doc_id"), F.lit(shards)).cast("int")  # as Spark deals rows, so that a shard is in one task
    found = docs.where("text is not null").select(long, "lang", "text").join(known.select(long, "toxic"), "doc_id")
    found = found.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("row"), F.min("toxic").alias("toxic"))
    found = found.withColumns({"shard": shard, "h": F.xxhash64(F.lit("order"), "doc_id")}).sortWithinPartitions("shard", "h", "doc_id")
    found = found.select("shard", F.col("toxic").cast("int").alias("toxic"), (F.pmod("h", F.lit(4)) == 0).alias("held"), "row.lang", "row.text")

    names = ("toxic", "held", "lang", "f")
    kinds = [pa.int32(), pa.int32(), *(pa.list_(t) for t in (pa.int32(), pa.bool_(), pa.string(), pa.binary()))]

    def pack(batches):
        forget_words()
        words: dict[str, bytes] = {}
        rows, size, shard, part = [], 0, None, 0

        def block():
            columns = [[shard], [part], *([list(c)] for c in zip(*rows))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["shard", "part", *names])

        for batch in batches:
            for s, *row, text in zip(*(batch.column(c) for c in ("shard", "toxic", "held", "lang", "text"))):
                s = s.as_py()
                if rows and (s != shard or len(rows) >= 2 * BLOCK or size >= BLOCK_BYTES):
                    yield block()
                    rows, size, part = [], 0, part + 1 if s == shard else 0
                shard = s
                rows.append([*(x.as_py() for x in row), word_features(text.as_py(), words)])
                size += len(rows[-1][-1])
                if len(words) > KNOWN:
                    words.clear()
        if rows:
            yield block()

    small_batches(docs.sparkSession)
    return found.mapInArrow(pack, "shard int, part int, toxic array<int>, held array<boolean>, lang array<string>, f array<binary>")


def block_sum(blocks: DataFrame, of, columns: tuple[str, ...] = ("shard", "part", "toxic", "held", "f")) -> np.ndarray | None:
    """The sum of the vector of whole numbers that `of` makes of each block: in tasks, in 8 tasks, then here. None of no block."""

    def sums(vectors):
        total = None
        for v in vectors:
            total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], names=["v"])

    def first(batches):
        forget_words()
        yield from sums(of(*(x.as_py() for x in row)) for b in batches for row in zip(*(b.column(c) for c in columns)))

    def second(batches):
        yield from sums(np.frombuffer(zlib.decompress(x.as_py()), "<i8") for b in batches for x in b.column("v"))

    rows = blocks.select(*columns).mapInArrow(first, "v binary").repartition(8).mapInArrow(second, "v binary").collect()
    return sum(np.frombuffer(zlib.decompress(r["v"]), "<i8") for r in rows) if rows else None


def learn_blocks(net: ConvNet, blocks: DataFrame, rows: np.ndarray, whole: bool, alone: bool) -> None:
    """Learn from all documents of all blocks, or but the held ones. In a pass each block learns on from the same net, then the
    net takes the mean of their moves; a block that is `alone` makes all passes at once."""
    passes = max(1, min(PASSES, math.ceil(STEPS / max(1, rows.sum()))))
    for number in range(1 if alone else passes):

        def moves(shard, part, toxic, held, f, net=net, number=number):
            own, block, at = copy.deepcopy(net), Block(f), [i for i, h in enumerate(held) if whole or not h]
            rng = np.random.default_rng([7, whole, number, shard, part])
            for _ in range(passes if alone else 1):
                own.learn(block, toxic, rng.permutation(np.array(at, int)).tolist(), rows)
            return own.moves(net, len(at))

        net.move(block_sum(blocks, moves))


def train_toxicity(docs: DataFrame, labels: DataFrame) -> tuple[ConvNet | None, dict[str, float]]:
    """A net and a threshold for each language, from all labelled documents, whole.

    Tasks make the features, in blocks of about `BLOCK` documents in the shared folder, and learn from them; only sums over all
    blocks come to the driver, whose size does not grow with the documents. First the net learns from all but a quarter, by
    hash, which calibrates, see threshold(), on scores in steps of 1/10000; then it learns on from all. None without both labels.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    shards = max(1, round(known.count() / BLOCK))
    with dropping_tables(spark), each_key_in_one_task(spark):
        with each_key_in_one_task(spark, shards):
            blocks = written(feature_blocks(docs, known, shards), "toxic-blocks")
        alone = shards == 1 and blocks.count() < 2

        def count(toxic, held, f):
            block, out = Block(f), []
            for kept in (False, True):
                at = [i for i, h in enumerate(held) if h == kept]
                out.append(np.concatenate([block.seen(toxic, at).ravel(), np.bincount([toxic[i] for i in at], minlength=2)]))
            return np.stack(out)

        found = block_sum(blocks, count, ("toxic", "held", "f"))
        if found is None:
            return None, {}
        most, kept = found.reshape(2, -1)
        (seen, rows), (all_seen, all_rows) = ((x[:-2].reshape(2, -1), x[-2:]) for x in (most, most + kept))
        if not all_rows.all():
            return None, {}
        odds, limits = log_odds(all_seen, all_rows), {}
        net = ConvNet().start(log_odds(seen, rows) if rows.all() else odds)
        if rows.all():
            learn_blocks(net, blocks, rows, False, alone)

            def judged(batches):
                forget_words()
                for b in batches:
                    for toxic, held, lang, f in zip(*(b.column(c).to_pylist() for c in ("toxic", "held", "lang", "f"))):
                        at = [i for i, h in enumerate(held) if h and lang[i] is not None]
                        block = Block([f[i] for i in at])
                        sums = block.sums(net.table)
                        got = [net.probability(net._pool(net.taps(sums[w]), ids, False)[0] if len(ids) else np.maximum(net.bias, 0) * 0) for w, ids in block.docs]
                        columns = [pa.array([lang[i] for i in at], pa.string()), pa.array([toxic[i] for i in at], pa.int32()), pa.array([round(x * 10_000) for x in got], pa.int32())]
                        yield pa.RecordBatch.from_arrays(columns, names=["lang", "toxic", "score"])

            scored = blocks.select("toxic", "held", "lang", "f").mapInArrow(judged, "lang string, toxic int, score int").groupBy("lang", "toxic", "score").count()
            scored = written(scored, "toxic-scores")
            both = scored.groupBy("lang").agg(*(F.sum(F.when(F.col("toxic") == x, F.col("count")).otherwise(0)).alias(f"n{x}") for x in (0, 1)))
            enough = both.where(F.least("n0", "n1") >= CALIBRATE).select("lang")
            got: dict[str, list] = {}
            for r in scored.join(enough, "lang").collect():
                got.setdefault(r["lang"], []).append((r["score"], r["toxic"], r["count"]))
            for lang, x in sorted(got.items()):
                scores, toxic, times = np.array(x).T
                limits[lang] = threshold(scores / 10_000, toxic, times)
            net.turn(odds - log_odds(seen, rows))
        learn_blocks(net, blocks, all_rows, True, alone)
    net.squares = {}
    return net, limits


def score_toxicity(docs: DataFrame, net: ConvNet | None, limits: dict[str, float]) -> DataFrame:
    """doc_id, score, predicted (score of 0.5 or more) and flagged (score against the threshold of the row's lang).

    The score comes from the text alone; only `flagged` looks at lang, a null or unknown one counts from 0.5. Null and empty
    texts score as a text without words. Without a net all scores are 0. Rows stay apart, an empty table gives an empty one.
    """

    def score():
        forget_words()
        scorer = Scorer(net) if net else None
        return lambda texts: [scorer.scores([t if isinstance(t, str) else "" for t in texts]) if scorer else [0.0] * len(texts)]

    scored = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), score, "score double")
    limit = F.lit(0.5)
    for lang, c in limits.items():
        limit = F.when(F.col("lang").eqNullSafe(lang), c).otherwise(limit)
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= limit).alias("flagged"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_toxicity() of all documents, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    net, limits = train_toxicity(docs.where(fold(5) != 0), table(spark, sf_dir, "labels").where(fold(5) != 0))
    return score_toxicity(docs, net, limits).withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False))).select("doc_id", "held_out", "score", "predicted", "flagged")
