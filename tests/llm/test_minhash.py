import random
import re

import numpy as np

from tensorfold.llm import minhash as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(pairs, threshold=85):
    sets = [(i, shingles(t)) for i, t in pairs]
    label = {i: i for i, _ in sets if i is not None}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if None not in (i, j) and a and b and 100 * len(a & b) >= threshold * len(a | b):
                p, q = sorted((root(i), root(j)))
                label[q] = p
    return sorted((str(i), len(s), str(i if i is None else root(i)), i is None or root(i) == i) for i, s in sets)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(500)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            w = (rng.choice(out)[1] or "x").split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = rng.choices(words, k=rng.choice([3, 40, 120, 300]))
        out.append((i, " ".join(w)))
    rng.shuffle(out)
    return out


def check(make, pairs, **how):
    got = sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in M.groups(make(pairs), **how).collect())
    assert got == brute(pairs, how.get("threshold", 85))


def test_matches_brute_force(make):
    check(make, corpus(1))


def test_blocks_lose_no_link(make):
    check(make, corpus(2), block=3)


def test_other_thresholds(make):
    assert M.banding(85) == (21, 6) and M.banding(80) == (25, 5) and M.banding(100) == (1, 6)
    check(make, corpus(3, 80), threshold=80, block=4)


def test_large_buckets_of_many_components_lose_no_link(make):
    """Texts of one template: most share a bucket and few are similar, so the rounds leave them split."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(4000)]
    template = rng.choices(words, k=150)
    pairs = []
    for i in range(90):
        own = rng.choices(words, k=rng.randint(20, 45))
        pairs.append((i, " ".join(template + own)))
        if i % 3 == 0:
            pairs.append((1000 + i, " ".join(template + own[: -rng.randint(1, 8)])))
    check(make, pairs, block=8)


def family(m, seed=21):
    """Near copies of one text that share buckets and prefix words, some of them similar, and copies of its own words."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    base = rng.choices(words, k=150)
    out = []
    for i in range(m):
        w = base[:]
        for at in rng.sample(range(150), rng.randint(1, 6)):
            w[at] = rng.choice(words)
        out.append((i, " ".join(w)))
    return out


def test_groups_of_several_tasks_lose_no_link(make):
    check(make, family(60) + [(1000 + i, t) for i, t in corpus(14, 30)], block=4, words=1500)


def test_rows_of_tasks_grow_with_a_group_not_its_square(spark, make, monkeypatch):
    real, rows = M._link_blocks, []

    def counted(threshold):
        run, n = real(threshold), rows[-1]

        def count(key, table):
            n.add(table.num_rows)
            return run(key, table)

        return count

    monkeypatch.setattr(M, "_link_blocks", counted)
    for m in (50, 200):
        rows.append(spark.sparkContext.accumulator(0))
        M.groups(make(family(m)), block=8).collect()
    assert 0 < rows[0].value and rows[1].value <= 8 * rows[0].value


def test_edges(make):
    long = " ".join(f"w{k}" for k in range(20_000))
    check(make, [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, long), (8, long + " more"), (8, long + " more"), (None, long), (9, "É é x"), (10, "é é x")])
    assert M.groups(make([])).count() == 0
    extra = make([(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "z")]).selectExpr("*", "1 as doc", "2 as component")
    odd = make([(1, "a b c"), (1, "a b c"), (1, "a b d")]).selectExpr("doc_id", "text", "monotonically_increasing_id() % 3 as source")
    for _ in range(2):
        assert sorted(r["text"] for r in M.deduplicated(odd.repartition(3)).collect()) == ["a b c", "a b d"]
    out = M.deduplicated(extra)
    assert out.columns == extra.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_index_finds_all_links():
    rng = random.Random(5)
    sets = []
    for _ in range(80):
        s = set(rng.sample(range(300), 60)) if not sets or rng.random() < 0.4 else set(rng.choice(sets)) ^ set(rng.sample(range(300), rng.randint(0, 9)))
        sets.append(s)
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    joined = M.links_between(arrays, list(range(80)))
    label = list(range(80))
    for pairs in (joined, [(a, b) for a in range(80) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]):
        own = list(range(80))
        for a, b in pairs:
            x, y = own[a], own[b]
            own = [min(x, y) if o in (x, y) else o for o in own]
        label = own if pairs is joined else label
        assert pairs is joined or own == label


def test_coordinates_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 60, 2000).astype(np.uint64)
    b = np.concatenate([a[:1600], rng.integers(0, 1 << 60, 400).astype(np.uint64)])
    m = M.circulant_minhash(np.concatenate([a, b]), np.array([0, 2000, 4000]), 512)
    assert abs((m[0] == m[1]).mean() - 1600 / 2400) < 0.08
