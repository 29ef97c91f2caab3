"""Operator 8, language identification: family first, then one-versus-one linear machines within the family."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, row_key, table

#: Hash buckets of character 1- to 3-grams; documents at most that each language is learned from, and languages at most that
#: are learned, the most common first. Of a document 6 bytes a bucket that it uses come to the driver, 24 kB at most.
BUCKETS, SAMPLE, LANGUAGES = 1 << 12, 500, 100
#: Families of closely related languages; a language that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "da": "germanic", "sv": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic",
}
UNKNOWN = "und"


def text_vector(text: str, buckets: int = BUCKETS, piece: int = 1 << 16) -> np.ndarray | None:
    """Square roots of n-gram shares over the whole text, of length 1; None without a letter. Read piece by piece."""
    total, letters = np.zeros(buckets), False
    for at in range(0, len(text), piece):
        part = text[max(0, at - 2) : at + piece].lower()
        part = "".join([c if c.isalpha() else " " for c in part]) if not part.isalpha() else part
        letters = letters or not part.isspace()
        c = np.frombuffer((" " + part + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        h = c * np.uint64(0x9E3779B97F4A7C15)
        two = (h[:-1] << np.uint64(5)) + h[1:] + np.uint64(0x51)
        three = (two[:-1] << np.uint64(7)) + h[2:] + np.uint64(0xA3)
        for g in (h, two, three):
            total += np.bincount(((g * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets)
    if not letters:
        return None
    v = np.sqrt(total)
    return v / np.linalg.norm(v)


def linear_machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 150) -> np.ndarray:
    """Weights (last one the bias) of a support vector machine with squared hinge loss, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c
    step = 1.0 / (1.0 + 4 * cost.sum())
    w = prev = np.zeros(x.shape[1])
    for k in range(rounds):
        z = w + (k / (k + 3)) * (w - prev)
        slack = np.maximum(0, 1 - y * (x @ z))
        prev, w = w, z - step * (z - 2 * x.T @ (cost * y * slack))
    return w


class LanguageTree:
    def __init__(self, groups: dict[str, list[str]], family: list[tuple[str, str, np.ndarray]], pairs: list[tuple[str, str, np.ndarray]]):
        self.groups, self.family, self.pairs = groups, family, pairs

    @staticmethod
    def _vote(names: list[str], machines, v: np.ndarray) -> tuple[str, float]:
        """The name with most votes, ties by margin, then by name; its weakest margin as a probability."""
        votes, margin, low = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, math.inf)
        for a, b, w in machines:
            if a in votes and b in votes:
                m = float(v @ w[:-1] + w[-1])
                votes[a if m >= 0 else b] += 1
                margin[a], margin[b] = margin[a] + m, margin[b] - m
                low[a], low[b] = min(low[a], m), min(low[b], -m)
        best = max(names, key=lambda n: (votes[n], margin[n], n))
        return best, 1.0 if low[best] is math.inf else 1 / (1 + math.exp(-3 * max(-50.0, min(50.0, low[best]))))

    def predict(self, text: str | None) -> tuple[str, float]:
        v = text_vector(text) if isinstance(text, str) else None
        if v is None or not self.groups:
            return UNKNOWN, 0.0
        group, p = self._vote(sorted(self.groups), self.family, v)
        lang, q = self._vote(self.groups[group], self.pairs, v)
        return lang, p * q

    @staticmethod
    def fit(x: np.ndarray, langs: list[str], families: dict[str, str] | None = None) -> "LanguageTree":
        """From text vectors, one a row, and their languages."""
        families = FAMILIES if families is None else families
        groups: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            groups.setdefault(families.get(lang, f"={lang}"), []).append(lang)
        lang = np.array(langs)
        group = np.array([families.get(n, f"={n}") for n in langs])

        def machines(names, of):
            out = []
            for a, b in combinations(sorted(names), 2):
                at = (of == a) | (of == b)
                out.append((a, b, linear_machine(x[at], np.where(of[at] == a, 1.0, -1.0))))
            return out

        return LanguageTree(groups, machines(groups, group), [m for g in groups.values() for m in machines(g, lang)])


def train_language_tree(docs: DataFrame, sample: int = SAMPLE, families: dict[str, str] | None = None) -> LanguageTree:
    """Learn from text and lang of at most `sample` rows of each of at most `LANGUAGES` languages, chosen by hash.

    Rows without text, lang or a letter are left out, repeated rows count once, ties of the hash go by the row's content.
    Tasks make the vectors; no text comes to the driver. Without rows the tree knows no language.
    """
    r1, r2 = row_key(F.col("doc_id"), F.col("text"))
    rows = docs.where("text is not null and lang is not null").select("lang", F.xxhash64("doc_id").alias("__h"), r1.alias("__r1"), r2.alias("__r2"), "text")
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    keys = rows.drop("text").join(F.broadcast(common), "lang").groupBy("lang", "__h", "__r1", "__r2").count()
    # Spark keeps `sample` keys a language and task before it shuffles them.
    keys = keys.withColumn("__n", F.row_number().over(Window.partitionBy("lang").orderBy("__h", "__r1", "__r2"))).where(F.col("__n") <= sample)
    chosen = F.broadcast(keys.select("lang", "__r1", "__r2"))  # at most `sample` rows a language

    def features():
        def of(texts):
            out = []
            for text in texts:
                v = text_vector(text)
                at = np.flatnonzero(v) if v is not None else np.zeros(0, int)
                out.append(at.astype("<u2").tobytes() + (v[at].astype("<f4").tobytes() if len(at) else b""))
            return [out]

        return of

    found = rows.join(chosen, ["lang", "__r1", "__r2"]).select("lang", "__r1", "__r2", "text")
    got = map_texts(found, features, "f binary").groupBy("lang", "__r1", "__r2").agg(F.min("f").alias("f")).where("length(f) > 0").collect()
    got = sorted((r["lang"], bytes(r["f"])) for r in got)
    x = np.zeros((len(got), BUCKETS))
    for row, (_, f) in zip(x, got):
        n = len(f) // 6
        row[np.frombuffer(f[: 2 * n], "<u2")] = np.frombuffer(f[2 * n :], "<f4")
    return LanguageTree.fit(x, [lang for lang, _ in got], families)


def identify_languages(docs: DataFrame, tree: LanguageTree) -> DataFrame:
    """doc_id, lang_pred and score of each whole text. Null texts and texts without a letter, and all texts where the tree has
    learned nothing: `und`, 0. Rows stay apart, ties of votes and margins go by name; an empty table gives an empty table."""

    def predict():
        def of(texts):
            got = [tree.predict(t) for t in texts]
            return [[g[0] for g in got], [g[1] for g in got]]

        return of

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), predict, "lang_pred string, score double")


def fold(parts: int):
    """crc32 of doc_id as text, modulo `parts`; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify_languages() of all documents, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    tree = train_language_tree(docs.where(fold(3) != 1))
    return identify_languages(docs, tree).withColumn("held_out", F.coalesce(fold(3) == 1, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")
