"""Operator 7, quality rules: base rules, then Viterbi decoding of a linear-chain conditional random field over lines."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words, forget_words, map_texts, table

SYMBOLS = re.compile(r"[#*$%&|<>]")
_NOTICE = re.compile(r"licen[sc]e|copyright|rights reserved|cookie|privacy|terms of", re.I)
_CAPS, _DIGITS, _LETTERS = re.compile("[A-Z\xc0-\xde]"), re.compile("[0-9]"), re.compile(r"[^\W\d_]")
#: Documents of each quality and lines of a document at most that the field is fitted on (48 bytes a line come to the driver:
#: 74 MB at most); the share of characters in content lines that a kept document needs.
SAMPLE, SAMPLE_LINES, KEEP_SHARE = 3000, 256, 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
N_FEATURES = 12


def repeated_words(ids: np.ndarray) -> int:
    """Words in 5-word windows that are found twice or more, first included. Exact: windows are ranked, not hashed."""
    if len(ids) < 6:
        return 0
    n = int(ids.max()) + 1
    _, two = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
    m = int(two.max()) + 1
    _, four = np.unique(two[:-2] * m + two[2:], return_inverse=True)
    _, five, seen = np.unique(four[:-1] * n + ids[4:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(seen[five] >= 2)
    if not len(twice):
        return 0
    ends = np.zeros(len(ids) + 1, np.int64)
    np.add.at(ends, twice, 1)
    np.add.at(ends, twice + 5, -1)
    return int((np.cumsum(ends[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[list[str], dict[str, int]]:
    words = ascii_words(text)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = text.split("\n")
    with_word = Counter(x for x in lines if x.strip(" \t\n\x0b\x0c\r"))
    return lines, {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(SYMBOLS.findall(text)),
        "n_dup_lines": sum(with_word.values()) - len(with_word),
        "n_repeat_words": repeated_words(ids),
    }


def line_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line and the characters in its words; nothing but the text is used."""
    out, weight, seen = np.zeros((len(lines), N_FEATURES), np.float32), np.zeros(len(lines)), set()
    for i, line in enumerate(lines):
        words = ascii_words(line)
        if not words:
            out[i, 0] = 1
            continue
        chars = sum(map(len, words))
        letters = len(_LETTERS.findall(line)) or 1
        symbols = len(SYMBOLS.findall(line))
        out[i] = (
            1, min(len(words), 60) / 20, len(_CAPS.findall(line)) / letters, min(1.0, 4 * symbols / chars), "|" in line, "!!" in line, line in seen,
            words[-1][-1] in ".!?\"'", 1 - len(set(words)) / len(words), _NOTICE.search(line) is not None, len(_DIGITS.findall(line)) / chars,
            sum(a == b for a, b in zip(words, words[1:])) / len(words),
        )
        weight[i] = chars
        seen.add(line)
    return out, weight


class LineField:
    """A linear-chain conditional random field with two labels, 0 boilerplate and 1 content."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def viterbi(self, feats: np.ndarray) -> np.ndarray:
        scores = (feats @ self.emit).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = scores[0]
        back = []
        for s0, s1 in scores[1:]:
            p, q = a + m00 >= b + m10, a + m01 > b + m11
            back.append((not p, not q))
            a, b = (a + m00 if p else b + m10) + s0, (a + m01 if q else b + m11) + s1
        label = int(b >= a)
        path = [label]
        for step in reversed(back):
            label = int(step[label])
            path.append(label)
        return np.array(path[::-1])

    @staticmethod
    def fit(docs: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120, rate: float = 0.15, l2: float = 1e-3) -> "LineField":
        """Gradient ascent of the likelihood by forward and backward sums, over documents padded by length."""
        emit, move = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
        g2e, g2m = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
        docs = sorted(docs, key=lambda d: len(d[1]))
        total = sum(len(y) for _, y in docs) or 1
        batches = []
        for at in range(0, len(docs), 256):
            part = docs[at : at + 256]
            long = max(len(y) for _, y in part)
            x, y, mask = np.zeros((len(part), long, N_FEATURES)), np.zeros((len(part), long), int), np.zeros((len(part), long))
            for i, (f, lab) in enumerate(part):
                x[i, : len(lab)], y[i, : len(lab)], mask[i, : len(lab)] = f, lab, 1
            batches.append((x, y, mask))
        for _ in range(rounds):
            ge, gm = -l2 * total * emit, -l2 * total * move
            for x, y, mask in batches:
                s, steps = x @ emit, y.shape[1]
                alpha, beta = np.empty_like(s), np.zeros_like(s)
                alpha[:, 0] = s[:, 0]
                for t in range(1, steps):
                    z = np.logaddexp(alpha[:, t - 1, 0, None] + move[0], alpha[:, t - 1, 1, None] + move[1]) + s[:, t]
                    alpha[:, t] = np.where(mask[:, t, None] > 0, z, alpha[:, t - 1])
                for t in range(steps - 2, -1, -1):
                    nxt = beta[:, t + 1] + s[:, t + 1]
                    z = np.logaddexp(move[:, 0] + nxt[:, 0, None], move[:, 1] + nxt[:, 1, None])
                    beta[:, t] = np.where(mask[:, t + 1, None] > 0, z, 0)
                logz = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
                gap = (np.eye(2)[y] - np.exp(alpha + beta - logz[:, None, None])) * mask[..., None]
                ge += np.einsum("btf,btk->fk", x, gap)
                if steps > 1:
                    both = mask[:, 1:]
                    pair = alpha[:, :-1, :, None] + move + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - logz[:, None, None, None]
                    gm -= (np.exp(np.minimum(pair, 0)) * both[..., None, None]).sum((0, 1))
                    np.add.at(gm, (y[:, :-1][both > 0], y[:, 1:][both > 0]), 1)
            ge, gm = ge / total, gm / total
            g2e, g2m = g2e + ge**2, g2m + gm**2
            emit, move = emit + rate * ge / np.sqrt(g2e), move + rate * gm / np.sqrt(g2m)
        return LineField(emit, move)


def train_line_field(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineField | None:
    """Fit on at most `sample` labelled documents of each quality, chosen by hash of doc_id; None if a quality is missing.
    Documents of more than `SAMPLE_LINES` lines are judged like all, but not learned from.

    Labels are of documents. All lines of a good one start as content, all of a bad one as boilerplate; after a first
    fit the lines of bad ones take their decoded labels (but the least likely line stays boilerplate), and it is fitted
    again.
    """
    known = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    chosen = known.where("quality = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = chosen.unionByName(known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def features():
        forget_words()
        return lambda texts: [[line_features(t.split("\n"))[0].astype("<f4").tobytes() for t in texts]]

    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").where(F.size(F.split("text", "\n", SAMPLE_LINES + 1)) <= SAMPLE_LINES)
    rows = map_texts(found.select("doc_id", "quality", "text"), features, "f binary").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("f").alias("f"))
    rows = rows.collect()  # one row for each chosen doc_id
    rows = sorted((int(r["quality"]), bytes(r["f"])) for r in rows)
    data = [(q, np.frombuffer(f, "<f4").reshape(-1, N_FEATURES)) for q, f in rows]
    if len({q for q, _ in data}) < 2:
        return None
    first = LineField.fit([(f, np.full(len(f), q)) for q, f in data], rounds=60)
    again = []
    for q, f in data:
        lab = np.full(len(f), q)
        if not q:
            lab = first.viterbi(f)
            lab[np.argmax((f @ (first.emit[:, 0] - first.emit[:, 1])))] = 0
        again.append((f, lab))
    return LineField.fit(again)


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def quality_rules(docs: DataFrame, field: LineField | None, keep_share: float = KEEP_SHARE, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Base counts of each whole text and the verdict, beside `columns` of `docs`.

    A null text has no words and so fails. Without a field (no labels to learn from) all lines count as content.
    Rows stay apart, repeated or not; an empty table gives an empty table.
    """

    def judge():
        forget_words()

        def of(texts):
            rows = []
            for text in texts:
                lines, n = base_counts(text if isinstance(text, str) else "")
                failed = n["n_words"] < MIN_WORDS or 100 * n["n_repeat_words"] > MAX_REPEAT_PERCENT * n["n_words"]
                share = 0.0
                if n["n_words"]:
                    feats, weight = line_features(lines)
                    share = 1.0 if field is None else float((weight * field.viterbi(feats)).sum() / weight.sum())
                rows.append((*n.values(), failed, share, not failed and share >= keep_share))
            return [list(c) for c in zip(*rows)] or [[]] * len(_OUT.split(","))

        return of

    # Renamed on the way, so that a column named text or like a new one cannot clash.
    carried = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(columns)], "text")
    out = map_texts(carried, judge, _OUT)
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(columns)], *[c for c in out.columns if not c.startswith("__")])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality_rules() of all documents, with a field learned from the labels. BASE_SQL holds its base columns."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, train_line_field(docs, table(spark, sf_dir, "labels")))


#: The base columns, by themselves. A word counts as repeated if one of the up to five windows that it is in is found twice.
BASE_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS t, doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT t, p, list_aggregate(w[p : p + 4], 'string_agg', ' ') AS g FROM (SELECT t, w, unnest(generate_series(1, len(w) - 4)) AS p FROM t)
), again AS (
  SELECT t, p FROM (SELECT t, p, count(*) OVER (PARTITION BY t, g) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT t, count(DISTINCT p + k) AS n FROM again, generate_series(0, 4) AS x(k) GROUP BY t
), lined AS (
  SELECT t, line FROM (SELECT t, unnest(lines) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), doubled AS (
  SELECT t, count(*) - count(DISTINCT line) AS n FROM lined GROUP BY t
), counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM t LEFT JOIN doubled d USING (t) LEFT JOIN repeated r USING (t)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
"""
