"""Operator 4, n-gram Jaccard join: MinHash bands propose pairs, Bayesian pruning drops them early, exact sets verify them."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE, SIMILARITY, forget_words, map_texts, row_key, table, written
from .components import components

#: Bands of rows: a pair at 0.8 shares none of 28 bands of 4 with probability (1 - 0.8^4)^28 < 4e-7.
BANDS, ROWS = 28, 4
HASHES = BANDS * ROWS
#: Hashes compared in each step, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-7
#: Members of one block of a bucket; larger buckets are dealt over pairs of blocks. Bytes of sets in a block, on average.
BLOCK, PART_BYTES = 128, 32 << 20
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KEY = ["band", "key", "bi", "bj"]


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    z = np.array([xxhash.xxh3_64_intdigest(f"minhash {k}") for k in range(2 * HASHES)], np.uint64)
    return z[:HASHES] | np.uint64(1), z[HASHES:]


_A, _B = _multipliers()


class Shingler:
    """Sets of hashed word shingles. A text of fewer words than a shingle is one shingle; without words, none."""

    def __init__(self, size: int = SHINGLE, remember: int = 100_000):
        forget_words()
        self.size, self.remember, self.known = size, remember, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text.lower()) if isinstance(text, str) else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.remember:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        ids = np.array([known[w] for w in words], np.uint64)
        n, h = max(1, len(ids) - self.size + 1), None
        for j in range(min(self.size, len(ids))):
            part = ids[j : j + n]
            h = part if h is None else (h ^ (h >> np.uint64(31))) * _MIX + part
        h = (h ^ (h >> np.uint64(29))) * _MIX
        return np.unique(h ^ (h >> np.uint64(32)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least value under each hash; four of them, a band, are one 64-bit key as they stand, so
    that bands are equal exactly where their parts of two signatures are."""
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(shingles), 4096):
        part = (shingles[at : at + 4096, None] * _A + _B) >> np.uint64(32)
        out = np.minimum(out, part.min(0).astype(np.uint32))
    return out.astype("<u2")


def least_matches(similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(hashes compared, matches at least): with a flat prior the posterior that a pair with m matches of n reaches
    `similarity` is the probability of at most m successes in n + 1 tries; fewer matches put it below `tolerance`."""
    steps = []
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if total >= tolerance:
                break
        steps.append((n, m))
    return steps


def _sketches(docs: DataFrame) -> DataFrame:
    """Row key, doc_id and the sketch of each row: `s` names the set by 128 bits of its content (null without words)."""

    def sketch():
        shingles = Shingler()

        def of(texts):
            names, sizes, signatures = [], [], []
            for text in texts:
                s = shingles(text)
                names.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sizes.append(len(s))
                signatures.append(signature(s) if len(s) else np.zeros(0, "<u2"))
            ends = np.cumsum([0, *(len(x) // ROWS for x in signatures)])
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(signatures).view("<i8") if signatures else [], pa.int64()))
            return [names, sizes, [x.tobytes() for x in signatures], bands]

        return of

    r1, r2 = row_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(r1.alias("r1"), r2.alias("r2"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(rows, sketch, "s binary, n int, sig binary, bands array<long>")


def _whole_groups(batches):
    """Frames of whole groups by `_KEY`, from batches sorted by it; a group has at most two blocks of members."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        last = np.ones(len(pdf), bool)
        for c in _KEY:
            v = pdf[c].to_numpy()
            last &= v == v[-1] if len(v) else last
        at = int(np.argmax(last)) if len(pdf) else 0
        held = pdf.iloc[at:].reset_index(drop=True)
        if at:
            yield pdf.iloc[:at]
    if held is not None and len(held):
        yield held


def _survivors(pdf: pd.DataFrame, steps: list[tuple[int, int]], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that outlive the pruning and have this band as their first in common. Pairs of one core
    are counted already."""
    sig = np.frombuffer(b"".join(pdf["sig"]), "<u2").reshape(-1, HASHES)
    keys = [pdf[c].to_numpy() for c in _KEY]
    new = np.ones(len(pdf), bool)
    if len(pdf) > 1:
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    group = np.cumsum(new)
    band, blk, n, cross = keys[0], pdf["blk"].to_numpy(), pdf["n"].to_numpy(), keys[2] != keys[3]
    core = pd.factorize(pdf["core"])[0]
    left, right = [], []
    for d in range(1, int(np.bincount(group).max(initial=1))):
        i = np.flatnonzero(group[d:] == group[:-d])
        j = i + d
        ok = (~cross[i] | (blk[i] != blk[j])) & (core[i] != core[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
        i, j = i[ok], j[ok]
        same, seen = np.zeros(len(i), int), 0
        for upto, least in steps:
            if not len(i):
                break
            same = same + (sig[i, seen:upto] == sig[j, seen:upto]).sum(1)
            ok = same >= least
            i, j, same, seen = i[ok], j[ok], same[ok], upto
        if len(i):
            first = (sig[i] == sig[j]).reshape(-1, BANDS, ROWS).all(2).argmax(1)
            ok = first == band[i]
            left.append(i[ok])
            right.append(j[ok])
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(left), np.concatenate(right)


def _verify(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs (i, j) of the sets have a Jaccard similarity of at least `similarity`, exactly."""
    used = np.unique(np.concatenate([i, j]))
    sizes = np.array([len(sets[u]) for u in used])
    _, number = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
    ends = np.cumsum(sizes)
    part = {u: number[e - s : e] for u, e, s in zip(used.tolist(), ends, sizes)}
    mark, ok = np.zeros(int(number.max()) + 1, np.int32), np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        a = part[int(i[run[0]])]
        mark[a] = 1
        others = [part[int(x)] for x in j[run]]
        size = np.array([len(x) for x in others])
        both = np.add.reduceat(mark[np.concatenate(others)], np.cumsum(size) - size)
        ok[run] = both >= similarity * (len(a) + size - both) - 1e-9
        mark[a] = 0
    return ok


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(s, set) for each wanted (s, r1, r2), from the text of that row."""

    def make():
        shingles = Shingler()
        return lambda texts: [[shingles(t).tobytes() for t in texts]]

    r1, r2 = row_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(r1.alias("r1"), r2.alias("r2"), "text")
    # Both sides grow with the documents: merged at every size, never broadcast. Repeated rows give a set again.
    found = rows.join(wanted.hint("merge"), ["r1", "r2"]).select("s", "text")
    return map_texts(found, make, "set binary").dropDuplicates(["s"])


def _cores(big: DataFrame, sets: DataFrame, contents: DataFrame, similarity: float) -> DataFrame:
    """(s, core) for the sets of large buckets that lie close to a pivot, exactly checked.

    Of each large bucket the set that meets most others there and elsewhere is the pivot, and a set takes the best pivot of
    its buckets. Jaccard distance is a metric: sets within half of the allowed distance of one pivot are links of each
    other, so a group of near copies is counted by its size and its pairs are never made. Members of a pivot are dealt over
    parts of bounded numbers and bytes, each with a copy of the pivot's set; a part is read as a stream.
    """
    score = big.groupBy("s").agg(F.sum("m").alias("score"))
    scored = written(big.join(score.hint("merge"), "s"), "scored")
    top = written(scored.groupBy("band", "key").agg(F.max(F.struct("score", "s")).alias("top")), "tops")
    best = scored.join(top.hint("merge"), ["band", "key"]).groupBy("s").agg(F.max("top").alias("top"))
    best = best.select("s", F.col("top.s").alias("pivot")).join(sets.select("s", "n").hint("merge"), "s")
    best = written(best, "pivots")
    sizes = best.groupBy("pivot").agg(F.greatest(F.sum(F.col("n").cast("long") * 8 + 64) / PART_BYTES, F.count("*") / (2 * BLOCK)).alias("parts"))
    # This and the other sides of joins on hot keys are written, so that both sides are plain exchanges, which Spark can split.
    parts = written(sizes.select("pivot", F.ceil("parts").cast("int").alias("parts")), "parts")
    dealt = best.join(parts.hint("merge"), "pivot").select("s", "pivot", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int").alias("part"))
    members = dealt.join(contents.hint("merge"), "s").select("pivot", "part", F.lit(1).alias("kind"), "s", "set")
    pivots = parts.join(contents.select(F.col("s").alias("pivot"), "set").hint("merge"), "pivot")
    pivots = pivots.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("pivot").alias("s"), "set")
    half = (1 + similarity) / 2

    def near(batches):
        pivot = None
        for pdf in batches:
            rows = []
            for p, kind, s, data in zip(pdf["pivot"], pdf["kind"], pdf["s"], pdf["set"]):
                one = np.frombuffer(data, np.uint64)
                if not kind:
                    pivot = one
                    continue
                both = len(np.intersect1d(pivot, one, assume_unique=True))
                if both >= half * (len(pivot) + len(one) - both):
                    rows.append((s, p))
            yield pd.DataFrame(rows, columns=["s", "core"])

    stream = members.unionByName(pivots).repartition("pivot", "part").sortWithinPartitions("pivot", "part", "kind")
    return stream.mapInPandas(near, "s binary, core binary")


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """near_duplicates() with the key of the row, r1 and r2, and `root`, which names its class (null without words)."""
    steps = least_matches(similarity)
    sketched = written(_sketches(docs), "sketches")
    live = sketched.where("n > 0")
    ids = live.select("s", "doc_id").distinct().groupBy("s").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low"))
    sets = live.groupBy("s").agg(F.min(F.struct("r1", "r2")).alias("r"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    sets = written(sets.join(ids.hint("merge"), "s"), "sets")
    banded = sets.select("s", "n", F.posexplode("bands").alias("band", "key"))
    buckets = written(banded.groupBy("band", "key").agg(F.count("*").alias("m"), F.sum("n").alias("size")).where("m > 1"), "buckets")
    # Signatures travel only with members of shared buckets.
    shared = written(banded.drop("n").join(buckets.hint("merge"), ["band", "key"]), "members")
    contents = written(_shingle_sets(docs, shared.select("s").distinct().join(sets.select("s", "r.r1", "r.r2").hint("merge"), "s")), "contents")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("size") * 8 / PART_BYTES)).cast("int")
    big = shared.where(F.col("m") > BLOCK).select("s", "band", "key", "m", blocks.alias("rest"))
    cores = written(_cores(big, sets, contents, similarity) if not big.isEmpty() else sets.select("s", F.col("s").alias("core")).where("false"), "cores")
    # In a large bucket the members of its largest core are not compared with each other: they only meet the others.
    cored = written(big.join(cores.hint("merge"), "s", "left").withColumn("core", F.coalesce("core", "s")), "cored")
    largest = cored.groupBy("band", "key", "m", "core").count().groupBy("band", "key", "m").agg(F.max(F.struct("count", "core")).alias("l"))
    largest = written(largest.where(F.col("l.count") > BLOCK).select("band", "key", F.col("l.core").alias("heavy"), F.col("l.count").alias("h")), "heavy")
    cored = cored.join(largest.hint("merge"), ["band", "key"], "left").where("h is null or h < m")
    in_heavy = F.coalesce(F.col("core") == F.col("heavy"), F.lit(False))
    per = F.col("rest") / F.col("m")
    cored = cored.withColumn("pl", F.ceil(F.coalesce("h", F.lit(0)) * per).cast("int")).withColumn("ps", F.ceil((F.col("m") - F.coalesce("h", F.lit(0))) * per).cast("int"))
    at = F.xxhash64("s")
    blk = F.when(in_heavy, F.col("ps") + F.pmod(at, F.greatest("pl", F.lit(1)))).otherwise(F.pmod(at, F.col("ps"))).cast("int")
    last = F.when(in_heavy, F.col("ps") - 1).otherwise(F.col("ps") + F.col("pl") - 1)
    few = shared.where(F.col("m") <= BLOCK).withColumn("ps", blocks)
    few = few.select("s", "band", "key", F.pmod(at, F.col("ps")).cast("int").alias("blk"), (F.col("ps") - 1).alias("last"))
    members = few.unionByName(cored.select("s", "band", "key", blk.alias("blk"), last.alias("last")))
    tagged = sets.select("s", "n", "copies", "sig").join(cores.hint("merge"), "s", "left").withColumn("core", F.coalesce("core", "s"))
    members = members.join(tagged.hint("merge"), "s").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    columns = [*_KEY, "blk", "s", "core", "n", "copies", "sig"]
    spread = members.withColumns({"bi": F.least("blk", "other"), "bj": F.greatest("blk", "other")}).select(*columns).repartition(*_KEY).sortWithinPartitions(*_KEY)

    def candidates(batches):
        for pdf in _whole_groups(batches):
            i, j = _survivors(pdf, steps, similarity)
            if len(i):
                yield pdf.iloc[np.unique(np.concatenate([i, j]))][columns]

    schema = "band int, key long, bi int, bj int, blk int, s binary, core binary, n int, copies long, sig binary"
    wanted = written(spread.mapInPandas(candidates, schema), "candidates")

    def links(batches):
        for pdf in _whole_groups(batches):
            i, j = _survivors(pdf, steps, similarity)
            if not len(i):
                continue
            ok = _verify([np.frombuffer(x, np.uint64) for x in pdf["set"]], i, j, similarity)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            s, copies = pdf["s"].to_numpy(), pdf["copies"].to_numpy()
            count, root = np.zeros(len(pdf), np.int64), {}
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])

            def find(x):
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in zip(s[i].tolist(), s[j].tolist()):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
            at = np.flatnonzero(count)
            yield pd.DataFrame({"s": s[at], "links": count[at], "root": [find(x) for x in s[at].tolist()]})

    verified = wanted.join(contents.hint("merge"), "s").repartition(*_KEY).sortWithinPartitions(*_KEY).mapInPandas(links, "s binary, links long, root binary")
    with_copies = written(cores.join(sets.select("s", "copies").hint("merge"), "s"), "core-copies")
    whole = written(with_copies.groupBy("core").agg(F.sum("copies").alias("whole")), "core-sums")
    of_cores = with_copies.join(whole.hint("merge"), "core").select("s", (F.col("whole") - F.col("copies")).alias("links"), F.col("core").alias("root"))
    verified = written(verified.unionByName(of_cores), "links")
    counts = verified.groupBy("s").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("s").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "s")
    found = sets.select("s", "copies", "low").join(counts.hint("merge"), "s", "left").join(roots.hint("merge"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    found = written(found, "found")
    lows = written(found.groupBy("root").agg(F.min("low").alias("class_id")), "lows")
    classes = found.join(lows.hint("merge"), "root").select(
        "s", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies")
    )
    classes, none = written(classes, "classes"), F.lit(0).cast("long")
    return (
        live.select("r1", "r2", "doc_id", "s").join(classes.hint("merge"), "s").drop("s")
        .unionByName(sketched.where("n = 0").select("r1", "r2", "doc_id", F.lit(None).cast("binary").alias("root"), F.col("doc_id").alias("class_id"), none.alias("n_links"), none.alias("n_copies")))
    )


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of `docs`: doc_id, class_id, n_links, n_copies.

    Words are runs of letters, digits and underscores, lower-cased; texts are sets of five-word shingles. A document is a
    doc_id with a set: rows that repeat it are one document, different texts under one doc_id are several, and a null
    doc_id is an id like others. class_id is the smallest doc_id of the connected component of links (null if it has none);
    n_links is the number of other documents at a Jaccard similarity of at least `similarity`, copies included; n_copies
    of them have the same set. Texts without words link to nothing, their class is their doc_id. An empty table gives an
    empty table; other columns are not read.

    Copies are one member of the join, links are counted where they are verified, and tight groups are counted by their
    cores, so no list of all pairs is ever made.
    """
    return near_duplicate_classes(docs, similarity).select("doc_id", "class_id", "n_links", "n_copies")


def one_of_each_class(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of each class: the one with the smallest doc_id (a null one last), ties by the row's content.

    Of repeated rows of a text with words one stays; rows whose text has no words all stay.
    """
    classes = written(near_duplicate_classes(docs, similarity), "row-classes")
    live = classes.where("root is not null")
    first = live.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "r1", "r2")).alias("k"))
    kept = live.groupBy("r1", "r2").agg(F.count("*").alias("__rows")).join(first.select("k.r1", "k.r2").hint("merge"), ["r1", "r2"], "left_semi")
    kept = kept.unionByName(classes.where("root is null").select("r1", "r2").distinct().withColumn("__rows", F.lit(1).cast("long")))
    kept = written(kept.withColumnsRenamed({"r1": "__r1", "r2": "__r2"}), "kept-rows")
    r1, r2 = row_key(F.col("doc_id"), F.col("text"))
    found = docs.withColumns({"__r1": r1, "__r2": r2}).join(kept.hint("merge"), ["__r1", "__r2"])
    once = found.where("__rows = 1").select(*docs.columns)
    again = found.where("__rows > 1").groupBy("__r1", "__r2").agg(F.first(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return once.unionByName(again)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs of documents that share a shingle, counted exactly; classes by reachability. A document is a doc_id with a set.
SQL = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS t, doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)
), tokens AS (
  SELECT t, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM texts
), grams AS (
  SELECT t, n, i, concat_ws(' ', x, lead(x, 1) OVER d, lead(x, 2) OVER d, lead(x, 3) OVER d, lead(x, 4) OVER d) AS g
  FROM tokens WINDOW d AS (PARTITION BY t ORDER BY i)
), text_sets AS (
  SELECT DISTINCT t, g FROM grams WHERE i <= greatest(1, n - 4)
), named AS (
  SELECT t, md5(string_agg(g, chr(10) ORDER BY g)) AS name FROM text_sets GROUP BY t
), members AS (
  SELECT DISTINCT t, min(t) OVER (PARTITION BY doc_id, name) AS m, doc_id FROM named JOIN texts USING (t)
), sets AS (
  SELECT t AS m, g FROM text_sets WHERE t IN (SELECT m FROM members)
), sizes AS (
  SELECT m, count(*) AS size FROM sets GROUP BY 1
), common AS (
  SELECT a.m AS a, b.m AS b, count(*) AS shared FROM sets a JOIN sets b ON a.g = b.g AND a.m <> b.m GROUP BY 1, 2
), links AS (
  SELECT a, b, shared = sa.size AND shared = sb.size AS copies
  FROM common JOIN sizes sa ON a = sa.m JOIN sizes sb ON b = sb.m WHERE 5 * shared >= 4 * (sa.size + sb.size - shared)
), reached AS (
  SELECT m AS node, m AS root FROM sizes UNION SELECT b, root FROM reached JOIN links ON a = node
), classes AS (
  SELECT node, min(doc_id) AS class_id FROM reached JOIN (SELECT DISTINCT m, doc_id FROM members) ON root = m GROUP BY 1
), counts AS (
  SELECT a, count(*) AS n_links, count(*) FILTER (copies) AS n_copies FROM links GROUP BY 1
)
SELECT d.doc_id, CASE WHEN m.m IS NULL THEN d.doc_id ELSE class_id END AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 0) AS n_copies
FROM documents d JOIN texts x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text IS NOT DISTINCT FROM x.text
LEFT JOIN members m ON x.t = m.t LEFT JOIN classes ON node = m.m LEFT JOIN counts ON a = m.m
"""
