import hashlib
import random

import numpy as np

from tensorfold.llm import suffix_dedup as S
from tensorfold.llm.suffix_array import suffix_array


def test_suffix_array_matches_sorting():
    rng = random.Random(1)
    for _ in range(500):
        t = [rng.randint(0, rng.choice([1, 2, 10])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def brute(pairs):
    order = sorted({(2**63 - 1 if i is None else i, t or "") for i, t in pairs}, key=lambda p: (p[0],))
    seen, out = set(), {}
    for i, t in order:
        raw = t.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i, t] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé ", k=rng.randint(2, 9))) for _ in range(300)]
    say = lambda k: " ".join(rng.choices(words, k=k))
    shared = [say(rng.randint(10, 60)) for _ in range(5)]
    out = []
    for i in range(n):
        t = say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            t += rng.choice(shared) + say(rng.randint(0, 5))
        if out and rng.random() < 0.3:
            t = rng.choice(out)[1]
            k = rng.randint(0, len(t))
            t = t[:k] + rng.choice(["", "x", "yz"]) + t[k + rng.randint(0, 2) :]
        out.append((i, t))
    return out


def check(make, pairs):
    got = S.digests(make(pairs)).collect()
    want = brute(pairs)
    texts = {}
    for i, t in pairs:
        texts.setdefault(i, []).append(t or "")
    assert len(got) == len(pairs)
    found = sorted((str(r[0]), *r[1:]) for r in got)
    assert found == sorted((str(i), *want[2**63 - 1 if i is None else i, t or ""]) for i, t in pairs)


def test_matches_brute_force(make):
    check(make, corpus(1))
    check(make, corpus(2))


def test_hot_anchor_path(make, monkeypatch):
    docs = make(corpus(3))
    rows = S.identified(docs, "doc_id")
    whole = lambda most: {(r["doc"], r["fp"]): S.merged([x.asDict() for x in r["ranges"]]) for r in S.with_ranges(rows, S.repeated_ranges(rows, most)).where("ranges is not null").collect()}
    assert whole(0) == whole(S.MOST_KINDS) == whole(2)


def test_edges(make, spark):
    a = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(150))
    long = "".join(chr(97 + (k * k * 31 + k // 5) % 26) for k in range(30_000))
    check(make, [(1, None), (2, ""), (3, a), (4, a), (4, a), (None, a), (5, a[:99]), (6, a[:100]), (7, "z" * 400), (8, long), (9, long[:15_000] + "é" * 300 + long[15_000:])])
    assert S.digests(make([])).count() == 0
    extra = make([(1, a), (2, a + "new words stand here")]).selectExpr("*", "1 as ranges", "2 as doc", "3 as fp")
    out = S.deduplicated(extra)
    assert out.columns == extra.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert rows == {1: a, 2: "new words stand here"}


def test_anchors_do_not_depend_on_what_lies_around():
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 123, 400, dtype=np.uint8)
    seen = set()
    for size in (0, 3, 1000, 70_000, 600_000):
        data = np.concatenate([rng.integers(97, 123, size, dtype=np.uint8), passage, rng.integers(97, 123, size // 2, dtype=np.uint8)])
        _, start, n, rel, h, _ = S.segments(data, np.array([0, len(data)]))
        place = {int(w): int(s + r) for s, k, r in zip(start, n, rel, strict=True) for w in range(s, s + k)}
        seen.add(tuple(place[w] - size for w in range(size, size + 301)))
    assert len(seen) == 1


def test_long_texts_in_tiles(make, monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    shared = prose(400)
    pairs = [(1, prose(3000) + shared + prose(100)), (2, shared[300:1500]), (3, prose(50) + shared + prose(2000) + shared), (4, "x" * 5000)]
    want = sorted(map(str, S.digests(make(pairs)).collect()))
    monkeypatch.setattr(S, "TILE", 700)
    monkeypatch.setattr(S.X, "CHUNK_BYTES", 600)
    assert sorted(map(str, S.digests(make(pairs)).collect())) == want
