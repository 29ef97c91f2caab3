"""Token ids of whole texts from a table of pieces, looked up for a block of bytes at a time."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from .common import BLANKS, REMEMBERED, _tokenizer

BLOCK_BYTES = 1 << 20
#: What remembered ids and long pieces may take; beyond that all are forgotten before the next block.
HELD_BYTES = 32 << 20
_LONG_BYTES = 250  # of a long piece in the dictionary, besides its own bytes
_BLANK, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_SHORT = 15  # bytes of a key: 15 and the length
#: A special token of the tokenizer: text on both sides of it is encoded apart.
MARK = "<|startoftext|>"
_ANY_BLANK = re.compile(b"[\x20\x09-\x0d]")


def _classes() -> np.ndarray:
    """The class of each byte. In words of U+0021 to U+012F without U+007F to U+00BF, the bytes 0xC3, 0xC4 and those that
    follow them are letters, but for U+00D7 and U+00F7."""
    of = np.full(256, _ODD, np.uint8)
    of[0x21:0x7F] = _SIGN
    for first, last in ("az", "AZ", "\x80\xbf", "\xc3\xc4"):
        of[ord(first) : ord(last) + 1] = _LETTER
    of[ord("0") : ord("9") + 1] = _DIGIT
    of[[ord(c) for c in BLANKS]] = _BLANK
    return of


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: How many letters after an apostrophe belong to it: fixed values, the endings of the pre-tokenizer's pattern.
_ONE, _TWO = b"stmd", (b"re", b"ve", b"ll")
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class PieceEncoder:
    """Ids of texts by the tokenizer's own pieces, each encoded once while it is remembered.

    Right for `word_bpe_49k.json`, which lower-cases, drops white space and never joins text across it or across pieces.
    Words of plain characters are cut into pieces by the classes of their bytes; other words go to the tokenizer as they are.
    Keys of up to 15 bytes are compared as a whole, never by hash alone; longer ones are kept in a dictionary. Memory is
    bounded: `remember` pieces of each kind, `HELD_BYTES` of ids and long pieces and what one block adds (scripts without
    blanks make whole sentences into pieces), and about 40 bytes for a byte of a block. A text longer than a block is
    cut at blanks, so only a word longer than that is one block. Empty texts have no ids.
    """

    def __init__(self, path: str, remember: int = 1_000_000, block: int = BLOCK_BYTES):
        self.tok, self.remember, self.block = _tokenizer(path), remember, block
        self.bits = max(4, (2 * remember - 1).bit_length())
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.mark = self.tok.token_to_id(MARK)
        self._forget()

    def _forget(self) -> None:
        size = 1 << self.bits
        self.low, self.high = np.zeros(size, np.uint64), np.zeros(size, np.uint64)  # a free place has high 0
        self.first, self.number = np.zeros(size, np.int64), np.zeros(size, np.int32)
        self.pool, self.used, self.kept, self.long, self.long_bytes = np.zeros(1 << 16, "<u4"), 0, 0, {}, 0

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look_up(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it is not in the table."""
        slot, last = self._slot(low, high), (1 << self.bits) - 1
        open_ = np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high))
        while len(open_):
            at = slot[open_]
            free = self.high[at] == 0
            slot[open_[free]] = -1
            open_ = open_[~free]
            at = (at[~free] + 1) & last
            slot[open_] = at
            open_ = open_[(self.low[at] != low[open_]) | (self.high[at] != high[open_])]
        return slot

    def _insert(self, low: np.ndarray, high: np.ndarray, first: np.ndarray, number: np.ndarray) -> None:
        """Keys that are new and different."""
        slot, last, left = self._slot(low, high), (1 << self.bits) - 1, np.arange(len(low))
        while len(left):
            at = slot[left]
            free = self.high[at] == 0
            mine = left[free]
            self.first[at[free]] = -1 - mine  # of several keys for a place the last one has it
            won = np.zeros(len(left), bool)
            won[free] = self.first[at[free]] == -1 - mine
            k, place = left[won], at[won]
            self.low[place], self.high[place], self.first[place], self.number[place] = low[k], high[k], first[k], number[k]
            left = left[~won]
            slot[left] = (slot[left] + 1) & last
        self.kept += len(low)

    def _tokenize(self, pieces: list[bytes], odd: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Put the ids of pieces at the end of the pool; where they are and how many."""
        odd = np.array(odd)
        words = [p.decode() for p in pieces]
        number = np.zeros(len(pieces), np.int64)
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        split, found = int((~odd).sum()), []
        for lo, hi, apart in ((0, split, " "), (split, len(order), MARK)):
            for at in range(lo, hi, 1000):
                rows = order[at : min(at + 1000, hi)]
                part = [words[i] for i in rows.tolist()]
                ids, sizes = self._joined(part, apart)
                found.append(ids)
                number[rows] = sizes
        first = np.zeros(len(pieces), np.int64)
        first[order] = self.used + np.cumsum(number[order]) - number[order]
        total = int(number.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + total] = np.concatenate(found)
        self.used += total
        return first, number

    def _joined(self, part: list[str], apart: str) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts and how many each has. They go to the tokenizer as one text: pieces behind blanks, told apart by
        the token mark of a word's end, odd words behind a special token, which no part holds. One by one if the count is off."""
        if apart == " " or not any("<|" in p for p in part):
            ids = np.array(self.tok.encode_batch_fast([apart.join(part)], add_special_tokens=False)[0].ids, "<u4")
            if apart == " ":
                cut = np.flatnonzero(self.ends[ids]) + 1
                if len(cut) == len(part):
                    return ids, np.diff(cut, prepend=0)
            else:
                cut = np.flatnonzero(ids == self.mark)
                if len(cut) == len(part) - 1:
                    return np.delete(ids, cut), np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
        each = [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
        return np.concatenate(each), np.array([len(x) for x in each])

    def _cut(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of a block, whether each is an odd word, and the bytes they are to be read from.
        A blank and 16 zero bytes stand behind the block."""
        data = np.frombuffer(raw, np.uint8)
        kind, text = _CLASS[data], _LOWER[data]
        kind[-16:] = _BLANK
        blank = kind == _BLANK
        lead = np.flatnonzero((data == 0xC3) | (data == 0xC4))
        strange = [np.flatnonzero(kind == _ODD)]
        if len(lead):
            second, c3 = data[lead + 1], data[lead] == 0xC3
            upper = np.where(c3, second < 0x9F, (second < 0xB0) & (second % 2 == 0))
            text[lead + 1] = second + np.where(upper, np.where(c3, 32, 1), 0).astype(np.uint8)
            strange.append(lead[np.where(c3, (second == 0x97) | (second == 0xB7), second >= 0xB0)])
        if b"<|" in raw:
            strange.append(np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))))
        strange = np.concatenate(strange)
        odd_at = None
        if len(strange):
            edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
            if not blank[0]:
                edge = np.concatenate([[0], edge])
            begin, end = edge[::2], edge[1::2]
            words = np.zeros(len(begin), bool)
            words[np.searchsorted(begin, strange, "right") - 1] = True
            step = np.zeros(len(data), np.int8)
            step[begin[words]] = 1
            step[end[words]] = -1
            odd_at = np.cumsum(step, dtype=np.int8).view(bool)
            np.copyto(text, data, where=odd_at)
            kind[odd_at] = _ODD
        change = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) + 1  # each digit is a piece
        change = np.concatenate([[0], change])
        end = np.concatenate([change[1:], [len(data)]])
        keep = ~blank[change]
        start, end = change[keep], end[keep]
        quote = np.flatnonzero((end - start == 1) & (text[start] == ord("'")) & (kind[end] == _LETTER))
        if len(quote):
            a, b = text[start[quote] + 1], text[start[quote] + 2]
            more = np.isin(a, np.frombuffer(_ONE, np.uint8)).astype(np.int64)
            for x, y in _TWO:
                more[(a == x) & (b == y)] = 2
            end[quote] += more
            start[quote + (more > 0)] += more  # the letters follow the apostrophe directly
            full = start < end
            start, end = start[full], end[full]
        odd = np.zeros(len(start), bool) if odd_at is None else odd_at[start]
        return start, end, odd, text

    def _block(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the pieces of a block, where the ids of each are in the pool, and how many."""
        if 4 * self.used + self.long_bytes > HELD_BYTES:
            self._forget()
        raw += b" " + bytes(16)
        start, end, odd, text = self._cut(raw)
        size = end - start
        at_byte = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
        low = at_byte[start] & _MASK[np.minimum(size, 8)]
        high = at_byte[np.minimum(start + 8, len(text) - 8)] & _MASK[np.clip(size - 8, 0, 7)]
        high |= np.minimum(size, _SHORT + 1).astype(np.uint64) << np.uint64(56)
        is_long = size > _SHORT
        slot = self._look_up(low, high)
        slot[is_long] = -1
        missing = np.flatnonzero(slot < 0)
        spans = [text[a:b].tobytes() for a, b in zip(start[missing].tolist(), end[missing].tolist())]
        flags = list(zip(spans, is_long[missing].tolist(), missing.tolist()))
        new = {p: (i, far) for p, far, i in flags if not far or p not in self.long}
        n_long = sum(far for _, far in new.values())
        if self.kept + len(new) - n_long > self.remember or len(self.long) + n_long > self.remember:
            if self.kept or self.long:
                self._forget()
                return self._block(raw[:-17])
            while len(new) - n_long > 1 << (self.bits - 1):  # more in one block than are remembered: room for them
                self.bits += 1
            self._forget()
        if new:
            rows = np.array([i for i, _ in new.values()])
            first, number = self._tokenize(list(new), odd[rows].tolist())
            far = is_long[rows]
            near = rows[~far]
            self._insert(low[near], high[near], first[~far], number[~far])
            keys = [p for p, (_, x) in new.items() if x]
            self.long.update(zip(keys, zip(first[far].tolist(), number[far].tolist())))
            self.long_bytes += sum(map(len, keys)) + _LONG_BYTES * len(keys)
        near = missing[~is_long[missing]]
        slot[near] = self._look_up(low[near], high[near])
        first, number = self.first[slot], self.number[slot].astype(np.int64)
        for p, far, i in flags:
            if far:
                first[i], number[i] = self.long[p]
        return start, first, number

    def _parts(self, text: bytes):
        """A text in parts of about a block, cut at blanks."""
        at = 0
        while len(text) - at > self.block:
            blank = _ANY_BLANK.search(text, at + self.block)
            if not blank:
                break
            yield text[at : blank.start()]
            at = blank.start()
        yield text[at:]

    def _blocks(self, texts: list[str]):
        """Texts in blocks: which text each part belongs to, the places of the parts among the block's pieces, and of each piece
        where its ids are in the pool and how many."""
        owners, parts, size = [], [], 0

        def block():
            begin = np.cumsum([0] + [len(part) + 1 for part in parts])
            start, first, number = self._block(b" ".join(parts))
            return owners, np.searchsorted(start, begin), first, number

        for i, text in enumerate(texts):
            for part in self._parts(text.encode()):
                if parts and size + len(part) > self.block:
                    yield block()
                    owners, parts, size = [], [], 0
                owners.append(i)
                parts.append(part)
                size += len(part) + 1
        if parts:
            yield block()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        out = [[] for _ in texts]
        for owners, at, first, number in self._blocks(texts):
            after = np.cumsum(number)
            ids = self.pool[np.repeat(first - (after - number), number) + np.arange(int(number.sum()))]
            edge = np.concatenate([[0], after])[at].tolist()
            for i, a, b in zip(owners, edge, edge[1:]):
                out[i].append(ids[a:b].tobytes())
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def sizes(self, texts: list[str]) -> list[int]:
        """How many ids each text has."""
        out = [0] * len(texts)
        for owners, at, _, number in self._blocks(texts):
            edge = np.concatenate([[0], np.cumsum(number)])[at]
            for i, n in zip(owners, np.diff(edge).tolist()):
                out[i] += n
        return out


@lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker."""
    return PieceEncoder(path)


REMEMBERED.append(piece_encoder)
