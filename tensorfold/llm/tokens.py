"""Token ids of whole texts, equal to those that ``tokenizers`` gives each text, with each distinct part of the texts encoded once.

A byte-level tokenizer parts a text before it merges, and parts are encoded apart from each other. Texts are parted here for many rows at
once, by the classes of their code points (letter, number, space, other); a code point's class is asked of the tokenizer itself when it
is first met, so both follow the same version of Unicode. Parts are known by a 64-bit hash of their code points; ``tokenizers`` encodes those not
seen before. Added tokens (such as an end-of-text sign written out in a text) are found first, as the tokenizer does, and get their ids.
"""

from __future__ import annotations

import os

import numpy as np

from tensorfold.llm import text as X

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
KNOWN_PARTS = 2_000_000
RECENT_PARTS = 1 << 15
AT_ONCE = 500
#: Code points encoded at once; a longer text is cut where that changes no part.
TILE = 1 << 19
# What may follow an apostrophe that opens a part.
SHORT, LONG = "stmd", ("re", "ve", "ll")


def ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers of all ranges that have a start and a length, one after another."""
    return np.arange(many.sum()) + np.repeat(start - (np.cumsum(many) - many), many)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        resize = getattr(self.tokenizer.model, "_resize_cache", None)
        if resize:
            resize(0)  # each part is asked for once, so its own memory of parts only costs
        self.added = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.plain = not any(x.lstrip or x.rstrip or x.single_word for x in self.tokenizer.get_added_tokens_decoder().values())
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space, written as this sign
        self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.classes[32] = SPACE
        self.codes = X.mix(np.arange(1, 0x110001, dtype=np.uint64)) | X.U(1)
        self._forget()

    def _forget(self) -> None:
        # Known parts' hashes in order, and where their ids lie; those met lately apart, so that few merges are needed.
        self.main = self.recent = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def classed(self, points: np.ndarray) -> np.ndarray:
        found = self.classes[points]
        if (found == UNKNOWN).any():
            for point in np.unique(points[found == UNKNOWN]).tolist():
                c = chr(point)
                spans = [s for _, s in self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}1{c}!")]
                self.classes[point] = LETTER if (0, 2) in spans else NUMBER if (1, 4) in spans else OTHER if (3, 5) in spans else SPACE
            found = self.classes[points]
        return found

    def parts(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where parts of texts in a buffer of code points start, and the points' classes."""
        n = len(points)
        kind = self.classed(points)
        begins = np.zeros(n + 1, bool)
        begins[bounds] = True
        opens = begins[:-1].copy()
        opens[1:] |= kind[1:] != kind[:-1]
        gap = kind == SPACE
        blank = points == 32
        start = opens.copy()
        # One blank goes with what follows; of other white space the last character stands alone.
        joins = np.zeros(n, bool)
        joins[1:] = opens[1:] & ~gap[1:] & ~begins[1:n]
        start[1:] &= ~(joins[1:] & blank[:-1])
        start[:-1] |= joins[1:] & gap[:-1]
        # An apostrophe that opens a part takes some endings with it.
        at = np.flatnonzero((points == 39) & start)
        if len(at):
            row_end = bounds[np.searchsorted(bounds, at, "right")]
            first, second = (np.where(at + k < row_end, points[np.minimum(at + k, n - 1)], 0) for k in (1, 2))
            short, long_ = np.isin(first, [ord(c) for c in SHORT]), np.zeros(len(at), bool)
            for x, y in LONG:
                long_ |= (first == ord(x)) & (second == ord(y))
            hit, end = short | long_, at + np.where(short, 2, 3)
            start[at[hit] + 1] = False
            start[end[hit & (end < row_end)]] = True
        return np.flatnonzero(start), kind

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the texts' bounds among them (one more than texts)."""
        pieces, owner = [], []  # runs of text without added tokens, or an added token's id
        for k, t in enumerate(texts):
            for piece in self._split(t) if any(a in t for a in self.added) else _cut(t):
                pieces.append(piece)
                owner.append(k)
        found, counts = [], np.zeros(len(texts) + 1, np.int64)
        group: list[str] = []
        own: list[int] = []

        def flush():
            if group:
                ids, many = self._encode(group)
                found.append(ids)
                np.add.at(counts, np.array(own) + 1, many)
                group.clear()
                own.clear()

        size = 0
        for piece, k in zip(pieces, owner, strict=True):
            if not isinstance(piece, str):
                flush()
                found.append(np.array(piece, np.uint32))
                counts[k + 1] += len(piece)
                size = 0
                continue
            if size + len(piece) > TILE:
                flush()
                size = 0
            group.append(piece)
            own.append(k)
            size += len(piece)
        flush()
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum(counts)

    def _split(self, text: str) -> list:
        """A text's runs between added tokens, and lists of the tokens' ids."""
        if not self.plain:
            return [self.tokenizer.encode(text, add_special_tokens=False).ids]
        out, at = [], 0
        while True:
            hits = [(text.find(a, at), -len(a), a) for a in self.added if a]
            hits = [h for h in hits if h[0] >= 0]
            if not hits:
                return [*out, *_cut(text[at:])]
            place, _, token = min(hits)
            out += [*_cut(text[at:place]), [self.added[token]]]
            at = place + len(token)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without added tokens, and how many each has."""
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        start, kind = self.parts(points, bounds)
        end = np.append(start[1:], len(points))
        hashes = X.Runs(points, self.codes).of(start, end)
        each, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.main[0]) + len(self.recent[0]) > KNOWN_PARTS:
            self._forget()
        at, many = self._look_up(each)
        new = np.flatnonzero(at < 0)
        if len(new):
            a, b = start[first[new]], end[first[new]]
            word = (points[a] == 32) & (b - a > 1) & (kind[np.minimum(a + 1, len(points) - 1)] == LETTER)
            at[new], many[new] = self._learn(each[new], [joined[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], word)
        at, many = at[inverse], many[inverse].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(many)])
        cuts = total[np.searchsorted(start, bounds)]
        return self.ids[ranges(at, many)], np.diff(cuts)

    def _look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, many = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int32)
        for known, where, count in (self.main, self.recent):
            if len(known):
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[place] == hashes
                at[hit], many[hit] = where[place[hit]], count[place[hit]]
        return at, many

    def _learn(self, hashes: np.ndarray, parts: list[str], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of parts not known yet lie, and how many they are. Joined words that begin with a space are parted as they are alone, so one call serves many."""
        count = np.zeros(len(parts), np.int32)
        own: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(parts)
        for some in _slices(np.flatnonzero(word)):
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(parts[k] for k in some)], add_special_tokens=False)[0].ids, np.uint32)
            edges = [*np.flatnonzero(self.opens[ids]).tolist(), len(ids)]
            for k, a, b in zip(some.tolist(), edges[:-1], edges[1:], strict=True):
                own[k] = ids[a:b]
        for some in _slices(np.flatnonzero(~word)):
            for k, e in zip(some.tolist(), self.tokenizer.encode_batch_fast([parts[k] for k in some], add_special_tokens=False), strict=True):
                own[k] = np.array(e.ids, np.uint32)
        count[:] = [len(x) for x in own]
        flat = np.concatenate(own)
        at = self.used + np.cumsum(count, dtype=np.int64) - count
        if self.used + len(flat) > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), self.used + len(flat)), np.uint32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.recent = _merged(self.recent, (hashes, at, count))
        if len(self.recent[0]) > RECENT_PARTS:
            self.main, self.recent = _merged(self.main, self.recent), tuple(x[:0] for x in self.recent)
        return at, count


def _merged(a: tuple, b: tuple) -> tuple:
    place = np.searchsorted(a[0], b[0])
    return tuple(np.insert(x, place, y) for x, y in zip(a, b, strict=True))


def _slices(x: np.ndarray):
    """So many at once, as an encoding is far larger than its ids."""
    return (x[i : i + AT_ONCE] for i in range(0, len(x), AT_ONCE))


def _cut(text: str) -> list[str]:
    """A long text in runs of about ``TILE``, cut before a blank between two ASCII letters, where a part begins whatever stands around."""
    out = []
    while len(text) > TILE:
        at = TILE
        while True:
            at = text.find(" ", at)
            if at < 0 or at + 1 >= len(text):
                return [*out, text]
            before, after = text[at - 1], text[at + 1]
            if before.isascii() and before.isalpha() and after.isascii() and after.isalpha():
                break
            at += 1
        out.append(text[:at])
        text = text[at:]
    return [*out, text] if text else out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
