"""Operator 5, edit-aware token counts: a tree of segments for each document is kept in a table and taken up again."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, map_texts, table, word_tokenizer_path, written
from .piece_encoder import PieceEncoder, piece_encoder

SEGMENT_CHARS = 256
_TREE = "segments array<string>, chars array<int>, tokens array<int>"


@lru_cache(maxsize=16)
def _cutter(segment_chars: int) -> re.Pattern:
    return re.compile(f"[\\s\\S]{{{segment_chars}}}[^{BLANKS}]*|[\\s\\S]+")


def cut_segments(text: str, segment_chars: int = SEGMENT_CHARS) -> list[str]:
    """The text in parts of `segment_chars` characters and on to the next blank; an empty text is one empty part."""
    return _cutter(segment_chars).findall(text) or [""]


def _summed(leaves: list[int]) -> list[int]:
    """Nodes of a tree over a power of two of leaves; node 0 is not used."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([x + y for x, y in zip(level[::2], level[1::2])])
    return [0, *(x for level in reversed(levels) for x in level)]


class SegmentTree:
    """Segments of a text that end at blanks, with a binary tree of their lengths and token counts.

    The tokenizer never joins text across a blank, so counts of segments add up. An edit puts new text in the segments
    it touches and the neighbour that it may run into (its boundary context). Their lengths are summed at once; they are
    `stale` until settle() takes their new counts and updates the sums above, so that the segments of many edits and of
    many trees are encoded in one call. Node 1 is the root, node i has 2i and 2i + 1 below it, and the leaves are the last half.
    """

    def __init__(self, text: str, enc: PieceEncoder, segment_chars: int = SEGMENT_CHARS):
        parts = cut_segments(text, segment_chars)
        self._build(parts, enc.sizes(parts), enc)

    @staticmethod
    def of(parts: list[str], counts: list[int], enc: PieceEncoder) -> "SegmentTree":
        """A tree over segments that are counted already."""
        tree = SegmentTree.__new__(SegmentTree)
        tree._build(parts, counts, enc)
        return tree

    def _build(self, parts: list[str], counts: list[int], enc: PieceEncoder) -> None:
        self.enc, self.encoded, self.stale, self.n = enc, 0, set(), 1 << (len(parts) - 1).bit_length()
        self.built, rest = sum(map(bool, parts)), self.n - len(parts)
        self.parts = parts + [""] * rest
        self.chars, self.tokens = _summed([*map(len, parts), *[0] * rest]), _summed([*counts, *[0] * rest])

    @staticmethod
    def load(parts: list[str], chars: list[int], tokens: list[int], enc: PieceEncoder) -> "SegmentTree":
        """A kept tree; nothing is encoded."""
        tree = SegmentTree.__new__(SegmentTree)
        tree.enc, tree.encoded, tree.stale, tree.n = enc, 0, set(), len(chars) // 2
        tree.parts, tree.chars, tree.tokens = parts + [""] * (tree.n - len(parts)), list(chars), list(tokens)
        tree.built = sum(map(bool, parts))
        return tree

    def kept(self) -> tuple[list[str], list[int], list[int]]:
        """What load() takes: the segments and the nodes' lengths and counts."""
        last = max((i for i, p in enumerate(self.parts) if p), default=0)
        return self.parts[: last + 1], self.chars, self.tokens

    def _sum_up(self, nodes: list[int], leaves) -> None:
        """Sums above leaves, one level after the other."""
        touched = {(self.n + i) // 2 for i in leaves} - {0}
        while touched:
            for i in touched:
                nodes[i] = nodes[2 * i] + nodes[2 * i + 1]
            touched = {i // 2 for i in touched} - {0}

    def settle(self, counts: list[int]) -> None:
        """Take the counts of the stale segments, in order."""
        leaves = sorted(self.stale)
        for i, c in zip(leaves, counts):
            self.tokens[self.n + i] = c
        self.encoded += sum(bool(self.parts[i]) for i in leaves)
        self._sum_up(self.tokens, leaves)
        self.stale.clear()

    def stale_parts(self) -> list[str]:
        return [self.parts[i] for i in sorted(self.stale)]

    @property
    def count(self) -> int:
        if self.stale:
            self.settle(self.enc.sizes(self.stale_parts()))
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int]:
        """The segment that holds character `at` (the last one, if at the end), and where it starts."""
        i, start = 1, 0
        while i < self.n:
            i *= 2
            if at - start >= self.chars[i] and (at < self.chars[1] or self.chars[i + 1]):
                start += self.chars[i]
                i += 1
        return i - self.n, start

    def replace(self, start: int, end: int, new: str) -> None:
        """Put `new` in place of the characters from `start` to `end` of the text as it is now."""
        total = self.chars[1]
        start, end = max(0, min(start, total)), max(0, min(end, total))
        a, a0 = self._find(max(0, start - 1))  # the character before is context: a word may grow to the right
        b, b0 = self._find(min(end, max(0, total - 1)))
        old = "".join(self.parts[a : b + 1])
        text = old[: start - a0] + new + old[end - a0 :]
        # Words must not cross leaves: deal the new text over the same leaves, cut at blanks.
        cuts, step, at = [], max(1, -(-len(text) // (b - a + 1))), 0
        for _ in range(b - a):
            stop = min(len(text), at + step)
            while stop < len(text) and text[stop] not in BLANKS:
                stop += 1
            cuts.append(text[at:stop])
            at = stop
        cuts.append(text[at:])
        for i, part in zip(range(a, b + 1), cuts):
            self.parts[i], self.chars[self.n + i] = part, len(part)
        self.stale.update(range(a, b + 1))
        self._sum_up(self.chars, range(a, b + 1))


def standard_edits(text: str) -> list[tuple[int, int, str]]:
    """The query's edits, by character of the text before: numbers masked, a note put in the middle, the last word cut."""
    edits = [(m.start(), m.end(), "0") for m in re.finditer(r"[0-9]{4,}", text)]
    middle, last = len(text) // 2, len(text.rstrip(BLANKS))
    cut = max(text.rfind(c, 0, last) for c in BLANKS) + 1 if last else 0
    taken = [(s, e) for s, e, _ in edits]
    if not any(s < middle < e for s, e in taken):
        edits.append((middle, middle, " [edited] "))
    if last and cut >= middle and not any(s < last and cut < e for s, e in taken):
        edits.append((cut, last, ""))
    return sorted(edits)


def apply_edits(text: str, edits) -> str:
    for start, end, new in apart(edits, len(text)):
        text = text[:start] + new + text[end:]
    return text


def apart(edits, length: int) -> list[tuple[int, int, str]]:
    """The edits from the last to the first, inside the text; one that reaches into the next ends where that starts. Null
    bounds and texts count as the start and as nothing."""
    out, limit = [], length
    for start, end, new in sorted(((s or 0, e or 0, t or "") for s, e, t in edits), reverse=True):
        start = max(0, min(start, limit))
        end = max(start, min(end, limit))
        out.append((start, end, new))
        limit = start
    return out


def segment_trees(docs: DataFrame, tokenizer: str, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row for each row of `docs`: doc_id and its tree, to be written and taken up by edit_trees().

    segments are the pieces of the text, chars and tokens the lengths and counts of all nodes, tokens[1] the whole count. Null
    and empty texts are one empty segment. Rows stay apart, repeated or not; an empty table gives an empty table.
    """

    def build():
        enc = piece_encoder(tokenizer)

        def of(texts):
            parts = [cut_segments(t if isinstance(t, str) else "", segment_chars) for t in texts]
            counts = iter(enc.sizes([p for ps in parts for p in ps]))
            kept = [SegmentTree.of(ps, list(islice(counts, len(ps))), enc).kept() for ps in parts]
            return [list(c) for c in zip(*kept)] or [[]] * 3

        return of

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), build, _TREE)


def edit_trees(trees: DataFrame, edits: DataFrame | Callable[[str], list], tokenizer: str) -> DataFrame:
    """`trees` after edits, with n_tokens and n_tokens_after (counts before and after), n_edits, n_segments (before) and
    n_reencoded: only segments that an edit touches and their neighbours are encoded again.

    `edits` is a table (doc_id, start, end, text), by character of the text before, or a function from a text to such
    triples. Rows of `trees` that share a doc_id all take its edits; a null doc_id takes none from a table. Overlapping edits
    are told apart by apart(); trees without edits stay as they are. Chained calls go on from the trees that they return.
    """
    out = f"{_TREE}, n_tokens long, n_edits long, n_tokens_after long, n_segments long, n_reencoded long"
    names = [f.strip().split()[0] for f in out.split(",")]
    given = edits if callable(edits) else None
    if given is None:
        listed = edits.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text")).alias("__edits"))
        trees = trees.select("doc_id", "segments", "chars", "tokens").join(listed.hint("merge"), F.col("doc_id") == F.col("__id"), "left").drop("__id")
    # One struct takes the place of the text.
    rows = trees.select("doc_id", F.struct(*[c for c in trees.columns if c != "doc_id"]).alias("text"))

    def change():
        enc = piece_encoder(tokenizer)

        def of(kept):
            done, trees = [], []
            for t in kept:
                tree = SegmentTree.load(t["segments"], t["chars"], t["tokens"], enc)
                before = tree.count
                todo = given("".join(t["segments"])) if given else [(e["start"], e["end"], e["text"]) for e in t["__edits"] or []]
                for start, end, new in apart(todo, tree.chars[1]):
                    tree.replace(start, end, new)
                trees.append((tree, before, len(todo)))
            counts = iter(enc.sizes([p for tree, *_ in trees for p in tree.stale_parts()]))  # of all trees of the batch at once
            for tree, before, n_edits in trees:
                tree.settle(list(islice(counts, len(tree.stale))))
                done.append((*tree.kept(), before, n_edits, tree.count, tree.built, tree.encoded))
            return [list(c) for c in zip(*done)] or [[]] * len(names)

        return of

    return map_texts(rows, change, out)


def edited_counts(docs: DataFrame, tokenizer: str, edits: DataFrame | Callable[[str], list] | None = None, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Tokens of each whole text before and after its edits (by default standard_edits()), from trees that are built once,
    kept in a table and taken up for the edits. Null text is empty; its edits are those of the empty text."""
    trees = written(segment_trees(docs, tokenizer, segment_chars), "trees")
    return edit_trees(trees, standard_edits if edits is None else edits, tokenizer).select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_segments", "n_reencoded")


def op5_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edited_counts() of all documents under standard_edits()."""
    return edited_counts(table(spark, sf_dir, "documents"), word_tokenizer_path())
