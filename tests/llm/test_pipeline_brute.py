"""run() against plain Python on the smallest tables: all lines, all pairs, all stretches, the tokenizer itself."""

import math
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import regex
from tokenizers import Tokenizer

import corpus_pipeline
from strataframe.llm.common import table, word_tokenizer_path
from strataframe.llm.quality import line_features, train_line_field

BLANKS = " \t\n\x0b\x0c\r"


def accepted(text, field):
    words = [w for w in regex.split("[\x20\x09-\x0d]+", text or "") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    if len(words) < 10 or 100 * len(repeated) > 20 * len(words):
        return False
    feats, weight = line_features(text.split("\n"))
    return (weight * field.viterbi(feats)).sum() >= 0.5 * weight.sum()


def without_common_lines(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    holders = defaultdict(set)
    for i, text in rows.items():
        for line in text.split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    last = {k: max(ids) for k, ids in holders.items() if len(ids) >= 5}
    return {i: "\n".join(x for x in text.split("\n") if last.get(key(x), i) == i) for i, text in rows.items()}


def one_of_each_group(rows):
    sets, root = {}, {i: i for i in rows}
    for i, text in rows.items():
        w = regex.findall(r"\w+", text.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: t for i, t in rows.items() if find(i) == i}


def shingles(text):
    w = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


def without_benchmark(rows, items):
    items = [s for t in items if t and (s := shingles(t))]
    df = Counter(g for s in items for g in set(s))
    rare = math.log(1 + len(items))
    out = {}
    for i, text in rows.items():
        mine, hit = shingles(text), False
        for item in items:
            weight = {g: math.log(1 + len(items) / df[g]) for g in item}
            for at in {max(0, p - k) for p, g in enumerate(mine) if g in weight for k in range(len(item))}:
                part = set(mine[at : at + len(item)])
                both = sum(weight[g] for g in part if g in weight)
                other = rare * sum(g not in weight for g in part)
                hit = hit or both >= 0.8 * (sum(weight.values()) + other) - 1e-9
        if not hit:
            out[i] = text
    return out


def pieces_of(rows):
    tok = Tokenizer.from_file(word_tokenizer_path())
    for i, text in rows.items():
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            yield i, k, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))


def best_fit_bins(lengths):
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, n)
        insort(rooms, (rooms.pop(at) if at < len(rooms) else 2048) - n)
    return len(rooms)


def test_run_against_brute_force(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = train_line_field(docs, labels)
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    sizes = [len(rows)]
    rows = without_common_lines({i: t for i, t in rows.items() if accepted(t, field)})
    for stage in (one_of_each_group, lambda r: without_benchmark(r, [x["text"] for x in table(spark, sf_dir, "benchmark").collect()])):
        sizes.append(len(rows))
        rows = stage(rows)
    assert sizes[0] > sizes[1] > sizes[2] > len(rows) > 0  # each filter has something to do
    got = corpus_pipeline.run(spark, sf_dir).collect()
    want = set(pieces_of(rows))
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got} == want and len(got) == len(want)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) == best_fit_bins([p[3] for p in want])
