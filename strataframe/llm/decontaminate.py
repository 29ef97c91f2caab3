"""Operator 1, benchmark decontamination with SimHash windows. DataFrame functions only.

Windows are sized to the items by weight: an item takes the longest windows, of 7, 3 or 1 shingles, of which any stretch at
a weighted similarity of 0.8 must leave one whole. Documents are windowed at every s-th place, items at every place, so such
a stretch holds a window with the very fingerprint of one of the item's. Edits that move up to `RADIUS` bits are found
through the Hamming blocks as well. The exact weighted similarity of all stretches around a hit decides.

What a similarity of 0.8 must leave whole: lost shingles weigh at most a fifth of the item less 0.8 of what is foreign. At
its ends an item loses what it weighs. Each break inside costs at least four foreign shingles at the greatest weight, whatever
is put in, left out or replaced. (A document that skips from one place of an item to a later one that begins with the same one
to four words pays less for it; then the guarantee needs what is skipped to weigh as much.)

Fingerprints of whole items cannot do it: see the README for how many hits they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE, SIMILARITY, row_key, table, written

#: Bits in which fingerprints may differ; 4 blocks of 16 bits always leave one block equal.
RADIUS, BLOCKS = 3, 4
#: Shingles of a window, places between windows of documents: a whole stretch of W + s - 1 shingles holds a window.
CLASSES = ((7, 2), (3, 1), (1, 1))
#: Index rows at most that are sent to all executors; a larger index is joined by a shuffle.
BROADCAST_ROWS = 2_000_000
_WORD = r"[\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    """Hashes of the words in order: runs of letters and numbers, lower-cased. Null: null."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(_WORD), 0), lambda w: F.xxhash64(w))


def _shingled(df: DataFrame, text: str, words: Column | int = SHINGLE) -> DataFrame:
    """Add `__s`, the hashes of all runs of `words` words."""
    df = df.withColumn("__w", word_hashes(F.col(text)))
    k = words if isinstance(words, Column) else F.lit(words)
    n = F.size("__w") - (k - 1)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    of = lambda i, m: F.xxhash64(*[F.col("__w")[i + j] for j in range(m)])
    if isinstance(words, Column):
        hashed = lambda i: F.coalesce(*[F.when(k == m, of(i, m)) for m in range(1, SHINGLE + 1)])
    else:
        hashed = lambda i: of(i, words)
    return df.withColumn("__s", F.transform(at, hashed)).drop("__w")


def _codes(classes: list[tuple[int, int]]) -> Column:
    """All windows of a text as numbers 16 * place + W."""
    n, none = F.size("__s"), F.array().cast("array<int>")
    return F.concat(*[F.when(n >= w, F.sequence(F.lit(w), 16 * (n - w) + w, F.lit(16 * s))).otherwise(none) for w, s in classes])


def _fingerprints(df: DataFrame) -> DataFrame:
    """Add `fp`, the SimHash of the window `code`: each bit as most of 7 shingle hashes have it.

    The majority of 7 is the top bit of their count, which full adders make from whole 64-bit numbers: no loop over bits.
    Windows of 3 and 1 put each hash in 2 and 7 times (and 0 once for 3), which leaves their majority as it is.
    """

    def add(a, b, c):
        a, b, c = F.col(a), F.col(b), F.col(c)
        return a.bitwiseXOR(b).bitwiseXOR(c)

    def carry(a, b, c):
        a, b, c = F.col(a), F.col(b), F.col(c)
        return a.bitwiseAND(b).bitwiseOR(c.bitwiseAND(a.bitwiseXOR(b)))

    keep = [c for c in df.columns if c != "code"]
    df = df.select(*keep, F.shiftright("code", 4).alias("__p"), F.col("code").bitwiseAND(15).alias("__n"))
    keep += ["__p", "__n"]
    # Layer by layer, so that no expression is copied into another.
    hashes = [F.col("__s")[F.col("__p") + F.lit(k) % F.col("__n")] for k in range(6)]
    hashes.append(F.when(F.col("__n") == 3, F.lit(0).cast("long")).otherwise(F.col("__s")[F.col("__p") + F.lit(6) % F.col("__n")]))
    # Never null, so that the optimizer has no null checks to carry through the layers.
    df = df.select(*keep, *[F.coalesce(h, F.lit(0)).alias(f"h{k}") for k, h in enumerate(hashes)])
    df = df.select(*keep, "h6", add("h0", "h1", "h2").alias("a"), carry("h0", "h1", "h2").alias("c"), add("h3", "h4", "h5").alias("b"), carry("h3", "h4", "h5").alias("d"))
    df = df.select(*keep, "c", "d", carry("a", "b", "h6").alias("e"))
    return df.select(*keep, carry("c", "d", "e").alias("fp"))


def _blocks(df: DataFrame) -> DataFrame:
    """One row for each of the four blocks of the fingerprint, with a key of block and bits."""
    keys = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(65535).bitwiseOR(F.lit(k << 16).cast("long")) for k in range(BLOCKS)]
    return df.withColumn("key", F.explode(F.array(*keys)))


def _window_size(similarity: float) -> tuple[Column, Column]:
    """The running sums of the places' weights, and the longest window of which a stretch at `similarity` must leave one whole.

    To break all runs of R = W + s - 1 shingles an item may keep k runs of R - 1 with k - 1 breaks between them and lose the
    rest at its ends: the cost is what lies outside the heaviest stretch of k (R - 1) shingles, and four foreign shingles
    a break. Weights are shared out over the places of a repeated shingle, which makes the cost no larger than it is.
    """
    n, sums = F.size("__s"), F.aggregate("__pw", F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    spare, a_break = (1 - similarity) * F.col("whole"), similarity * 4 * F.col("w0")
    runs = F.sequence(F.lit(1), F.floor(spare / a_break).cast("int") + 1)

    def holds(run: int) -> Column:
        def cost(k):
            heaviest = F.array_max(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("__sums", F.least(i + k * (run - 1), n)) - F.get("__sums", i)))
            return F.col("whole") - heaviest + a_break * (k - 1)

        return F.forall(runs, lambda k: cost(k) > spare + 1e-9)

    out = F.lit(CLASSES[-1][0])
    for w, s in reversed(CLASSES[:-1]):
        out = F.when((n >= w + s - 1) & holds(w + s - 1), w).otherwise(out)
    return sums, out


def _items(benchmark: DataFrame, similarity: float) -> DataFrame:
    """Item id, words of a shingle, shingles, distinct shingles `hs` with weights `ws` (ln(1 + items / items with the
    shingle)), their sum, the weight of a foreign shingle, and the size of windows.

    An item is a row's content, named by `__i`: ids may be null, repeated or shared by different texts. An item of fewer
    than five words is one shingle of all its words.
    """
    rows = benchmark.select("item_id", "text").withColumn("__i", F.struct(*row_key(F.col("item_id"), F.col("text")))).dropDuplicates(["__i"])
    sized = rows.withColumn("__k", F.least(F.lit(SHINGLE), F.size(word_hashes(F.col("text"))))).where("__k > 0")
    items = written(_shingled(sized, "text", F.col("__k")).select("__i", "item_id", "__k", "__s"), "item-shingles")
    total = items.agg(F.count("*").alias("__items"))
    each = items.select("__i", F.explode(F.array_distinct("__s")).alias("h"))
    weight = each.groupBy("h").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("h", F.log(1 + F.col("__items") / F.col("df")).alias("w"), F.log(F.lit(1.0) + F.col("__items")).alias("w0"))
    weights = each.join(weight, "h").groupBy("__i").agg(F.sort_array(F.collect_list(F.struct("h", "w"))).alias("x"), F.max("w0").alias("w0"))
    items = items.join(weights, "__i").withColumns({"hs": F.col("x.h"), "ws": F.col("x.w")}).drop("x")
    items = items.withColumn("whole", F.aggregate("ws", F.lit(0.0), lambda a, w: a + w))
    place = lambda h: F.get("ws", F.array_position("hs", h).cast("int") - 1) / F.size(F.filter("__s", lambda x: x == h))
    sums, size = _window_size(similarity)
    items = items.withColumn("__pw", F.transform("__s", place)).withColumn("__sums", sums)
    return items.withColumn("window", size).drop("__pw", "__sums")


def _best_stretch(found: DataFrame, similarity: float) -> DataFrame:
    """Add `similarity` and `word` of the best stretch, as long as the item, that holds the matched window; null below
    `similarity`. `__c` is the text around the window, from word `__lo` on.

    Each place of `__c` gets its weight in the item and the place where its shingle was last; it counts in a stretch that
    starts after that place.
    """
    weight = lambda h: F.get("ws", F.array_position("hs", h).cast("int") - 1)

    def place(h, j):
        back = F.array_position(F.reverse(F.slice("__c", F.lit(1), j)), h).cast("int")
        return F.struct(F.when(back > 0, j - back).otherwise(F.lit(-1)).alias("last"), weight(h).alias("w"))

    found = found.withColumn("__x", F.transform("__c", place))
    most = F.aggregate("__x", F.lit(0.0), lambda a, x: a + F.when(x["last"] < 0, F.coalesce(x["w"], F.lit(0.0))).otherwise(0.0))

    def value(s):
        def step(a, x):
            new = x["last"] < s
            return F.struct(
                (a["both"] + F.when(new, F.coalesce(x["w"], F.lit(0.0))).otherwise(0.0)).alias("both"), (a["other"] + F.when(new & x["w"].isNull(), 1.0).otherwise(0.0)).alias("other")
            )

        start = F.struct(F.lit(0.0).alias("both"), F.lit(0.0).alias("other"))
        return F.aggregate(F.slice("__x", s + 1, F.col("__len")), start, step, lambda a: F.round(a["both"] / (F.col("whole") + a["other"] * F.col("w0")), 9))

    enough = most >= (similarity - 1e-9) * F.col("whole")
    found = found.withColumn("__v", F.when(enough, F.transform(F.sequence(F.lit(0), F.col("__last")), value)))
    found = found.withColumn("similarity", F.array_max("__v"))
    return found.withColumn("word", F.col("__lo") + F.array_position("__v", F.col("similarity")).cast("int") - 1)


def hits(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """contaminated() with r1, r2, the key of the document's row, and one row for each item of its own content."""
    items = written(_items(benchmark, similarity), "items")
    r1, r2 = row_key(F.col("doc_id"), F.col("text"))
    rows = docs.select("doc_id", r1.alias("r1"), r2.alias("r2"), "text").where("text is not null")
    present = items.select("__k", "window").distinct().collect()  # a row for each size of shingles and of windows: 15 at most
    n_s = F.size("__s")
    own = F.transform(F.sequence(F.lit(0), n_s - F.col("window")), lambda i: (16 * i + F.col("window")).cast("int"))
    index = _blocks(_fingerprints(items.select("__i", "__k", "__s", F.explode(own).alias("code"))))
    index = index.select("key", F.col("fp").alias("__fp"), F.col("__n").alias("__m"), F.col("__p").alias("__off"), "__i", "__k", n_s.alias("__len"))
    index = written(index, "item-windows")
    # The index grows with the benchmark only; it is sent to all executors only below a checked number of rows.
    small = index.count() <= BROADCAST_ROWS
    weighted = items.select("__i", "item_id", "hs", "ws", "whole", "w0")
    weighted = F.broadcast(weighted) if small else weighted
    result = docs.select("doc_id").where("false").select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("r1", "long"), ("r2", "long"), ("item_id", benchmark.schema["item_id"].dataType), ("similarity", "double"), ("word", "int"))])
    for k in sorted({r["__k"] for r in present}):
        classes = [c for c in CLASSES if c[0] in {r["window"] for r in present if r["__k"] == k}]
        of_k = index.where(F.col("__k") == k).drop("__k")
        windows = _shingled(rows, "text", k).select("doc_id", "r1", "r2", "__s")
        windows = _blocks(_fingerprints(windows.withColumn("code", F.explode(_codes(classes)))))
        found = windows.join(F.broadcast(of_k) if small else of_k, "key")
        # Two fingerprints may share several blocks: the lowest one counts.
        moved = F.col("fp").bitwiseXOR(F.col("__fp"))
        lowest = F.coalesce(*[F.when(F.shiftrightunsigned(moved, 16 * b).bitwiseAND(65535) == 0, b) for b in range(BLOCKS)])
        found = found.where((F.col("__n") == F.col("__m")) & (F.bit_count(moved) <= RADIUS) & (lowest == F.shiftright("key", 16)))
        low = F.greatest(F.lit(0), F.col("__p") + F.col("__n") - F.col("__len"))
        around = F.slice("__s", low + 1, F.col("__p") - low + F.col("__len"))
        found = found.select("doc_id", "r1", "r2", "__i", "__len", low.alias("__lo"), (F.col("__p") - low).alias("__last"), around.alias("__c")).join(weighted, "__i")
        found = _best_stretch(found, similarity)
        best = F.max(F.struct("similarity", (-F.col("word")).alias("at")))
        # Filtered after the grouping: a filter before it would move into the join and take that out of generated code.
        found = found.groupBy("doc_id", "r1", "r2", "__i", "item_id").agg(best.alias("b")).where(F.col("b.similarity") >= similarity - 1e-9)
        result = result.unionByName(found.select("doc_id", "r1", "r2", "item_id", "b.similarity", (-F.col("b.at")).alias("word")))
    return result


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Documents that hold a stretch, as long as an item, with a weighted Jaccard similarity to it of at least `similarity`.

    Returns doc_id, item_id, the best similarity of all stretches and the word at which the first such stretch starts. An
    item of fewer than five words is found where all its words stand together. Null and empty texts match nothing. A document
    is a row's content: repeated rows count once, a null doc_id is kept and its rows stay apart. So are items: a null
    item_id is kept, and different texts under one item_id give rows of their own. Empty tables give an empty one.
    """
    return hits(docs, benchmark, similarity).drop("r1", "r2")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` without the documents that hold benchmark text; all rows are decided by their text, with a null doc_id too."""
    r1, r2 = row_key(F.col("doc_id"), F.col("text"))
    keyed = docs.withColumns({"__r1": r1, "__r2": r2})
    gone = hits(docs, benchmark, similarity).select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2")).distinct()
    return keyed.join(gone, ["__r1", "__r2"], "left_anti").drop("__r1", "__r2")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contaminated() over all documents and items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("similarity", F.round("similarity", 6))


#: All stretches of documents, as long as an item, that share a shingle with it, weighed exactly.
SQL = r"""
WITH b AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)
), d AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)
), sized AS (
  SELECT i, w, least(5, len(w)) AS k FROM b WHERE len(w) > 0
), item_shingles AS (
  SELECT DISTINCT i, k, len(w) - k + 1 AS n, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS p FROM sized)
), weights AS (
  SELECT k, g, ln(1 + (SELECT count(*) FROM sized) / count(*)::DOUBLE) AS weight FROM item_shingles GROUP BY 1, 2
), items AS (
  SELECT i, s.k, n, g, weight, sum(weight) OVER (PARTITION BY i) AS whole, ln(1.0::DOUBLE + (SELECT count(*) FROM sized)) AS other FROM item_shingles s JOIN weights USING (k, g)
), doc_shingles AS (
  SELECT d, k, p - 1 AS p, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)
), met AS (
  SELECT d, i, n, p, s.g, weight, whole FROM doc_shingles s JOIN items USING (k, g)
), likely AS (
  SELECT d, i FROM (SELECT DISTINCT d, i, g, weight, whole FROM met) GROUP BY d, i, whole HAVING sum(weight) >= 0.8 * whole - 1e-9
), starts AS (
  SELECT DISTINCT d, i, k, n, unnest(generate_series(greatest(0, p - n + 1), p)) AS place FROM met JOIN likely USING (d, i) JOIN sized USING (i)
), stretches AS (
  SELECT DISTINCT t.d, t.i, t.k, place, s.g FROM starts t JOIN doc_shingles s ON s.d = t.d AND s.k = t.k AND s.p BETWEEN place AND place + n - 1
), valued AS (
  SELECT s.d, s.i, place, round(sum(weight) / (any_value(t.whole) + (count(*) - count(weight)) * any_value(t.other)), 9) AS similarity
  FROM stretches s LEFT JOIN items USING (i, g) JOIN (SELECT DISTINCT i, whole, other FROM items) t ON t.i = s.i GROUP BY 1, 2, 3
)
SELECT doc_id, item_id, round(max(similarity), 6) AS similarity, CAST(arg_max(place, (similarity, -place)) AS INTEGER) AS word
FROM valued JOIN d USING (d) JOIN b USING (i) GROUP BY d, i, doc_id, item_id HAVING max(similarity) >= 0.8 - 1e-9
"""
