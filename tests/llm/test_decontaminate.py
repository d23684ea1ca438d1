import random

import pytest
from pyspark.sql import functions as F

from tensorfold.llm import decontaminate as D


@pytest.fixture(scope="module")
def world():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 8))) for _ in range(4000)]
    often = words[:30]
    say = lambda k: " ".join(rng.choice(often) if rng.random() < 0.4 else rng.choice(words) for _ in range(k))
    items = [(k, say(rng.randint(15, 55))) for k in range(30)]
    docs, leaks, near = [], set(), set()
    for i in range(400):
        t = say(rng.randint(5, 400))
        if i % 4 == 0:
            k = rng.randrange(30)
            own = items[k][1].split()
            if i % 8 == 0:
                leaks.add((i, k))
            else:  # words dropped, none of the answer
                for x in sorted(rng.sample(range(len(own) - D.ANSWER), max(1, len(own) // 6)), reverse=True):
                    del own[x]
                near.add((i, k))
            cut = rng.randint(0, len(t.split()))
            t = " ".join([*t.split()[:cut], *own, *t.split()[cut:]])
        docs.append((i, t))
    return docs, items, leaks, near


def table(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_finds_leaks_and_paraphrases_and_nothing_else(spark, make, world):
    docs, items, leaks, near = world
    got = {(r["doc"], r["item_id"]) for r in D.matches(make(docs), table(spark, items)).collect()}
    assert leaks <= got
    assert len(near & got) >= 0.95 * len(near)
    assert got <= leaks | near
    kept = {r["doc_id"] for r in D.filtered(make(docs), table(spark, items)).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}


def test_latent_search_finds_copies_by_itself_and_bounds_find_the_rest(spark, make, world, monkeypatch):
    docs, items, leaks, near = world
    projection, idf = D.fit(D.identified(make(docs)))
    of = D.Items([k for k, _ in items], [t for _, t in items], projection, idf)
    h, first = D.X.word_hashes(*D.X.utf8(D.pa.array([t for _, t in docs], D.pa.string())))
    ids = D.np.array([i for i, _ in docs])
    pairs = lambda: {(x["doc"], x["item_id"]) for x in D._found(of, projection, h, first, ids, ids)}
    both = pairs()
    with monkeypatch.context() as m:
        m.setattr(D.Items, "candidates", lambda *_: (D.np.zeros(0, D.np.int64),) * 2)
        latent = pairs()
        m.setattr(D, "CANDIDATES", 30 * 7)  # tiles of 7 blocks
        assert pairs() == latent
    assert leaks <= latent <= both and len(latent) >= 0.95 * len(both)
    monkeypatch.setattr(D, "COSINE", 2)
    assert pairs() == both


def test_item_blocks(spark, make, world, monkeypatch):
    docs, items, leaks, near = world
    monkeypatch.setattr(D, "ITEM_BLOCK", 10)
    got = {(r["doc"], r["item_id"]) for r in D.matches(make(docs), table(spark, items)).collect()}
    assert leaks <= got <= leaks | near


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 30))] for _ in range(2))
        at = {}
        for k, w in enumerate(a):
            at[w] = at.get(w, 0) | 1 << k
        assert D.common(at, len(a), b) == lcs(a, b)


def test_edges(spark, make, world):
    docs, items, _, _ = world
    item = items[0][1]
    pairs = [(1, None), (2, ""), (3, item), (3, item), (None, item), (4, "x " * 30_000 + item + " y" * 30_000)]
    got = sorted((str(r["doc"]), r["item_id"]) for r in D.matches(make(docs + [(1000 + i if i else i, t) for i, t in pairs]), table(spark, items + [(900, None), (901, ""), (None, item), (902, "so few")])).where(F.col("doc") >= 1000).collect())
    assert got == [("1003", 0), ("1004", 0), (str(D.LAST_ID), 0)]
    assert D.matches(make([]), table(spark, items)).count() == 0 and D.matches(make(docs[:5]), table(spark, [])).count() == 0
    extra = make(docs[:10] + [(None, None)]).selectExpr("*", "1 as fp", "2 as doc", "3 as item_id")
    out = D.filtered(extra, table(spark, items))
    assert out.columns == extra.columns and out.where("doc_id is null").count() == 1


def everywhere(docs, items):
    """(doc, item_id, common words, answer), by the last rule alone at every block."""
    of = D.Items([k for k, _ in items], [t for _, t in items], D.np.zeros((D.TERMS + 1, D.RANK), "f4"), D.np.zeros(D.TERMS, "f4"))
    out = set()
    for i, t in docs:
        h = D.X.word_hashes(*D.X.utf8(D.pa.array([t], D.pa.string())))[0]
        for k, (key, _) in enumerate(items):
            hits = [x for x in (of.match(k, h, at) for at in range(0, len(h), D.STRIDE)) if x]
            if hits:
                out.add((i, key, *max(hits)))
    return out


def found(spark, make, docs, items):
    return {(r["doc"], r["item_id"], r["common_words"], r["answer"]) for r in D.matches(make(docs), table(spark, items)).collect()}


def test_paraphrases_without_the_rarest_words(spark, make, world):
    docs, items, _, _ = world
    docs = [(i, t) for i, t in docs if i % 4]
    rarity = {}
    for _, t in docs:
        for w in set(t.split()):
            rarity[w] = rarity.get(w, 0) + 1
    paraphrases = []
    for k, (key, text) in enumerate(items):
        own = text.split()
        free = len(own) - D.ANSWER
        for x in sorted(range(free), key=lambda x: rarity.get(own[x], 0))[: min(free, int(0.4 * len(own)))]:
            own[x] = f"other{x}"
        host = docs[k][1].split()
        paraphrases.append((1000 + k, " ".join([*host[: len(host) // 2], *own, *host[len(host) // 2 :]])))
    got = found(spark, make, docs + paraphrases, items)
    assert {(1000 + k, key) for k, (key, _) in enumerate(items)} <= {x[:2] for x in got}
    assert got == everywhere(docs + paraphrases, items)


def test_short_items_verbatim(spark, make, world):
    docs, _, _, _ = world
    rng = random.Random(8)
    hosts = [t.split() for _, t in docs if len(t.split()) > 100]
    items, copies = [], []
    for k in range(60):
        n = (4, 6, 8, 12)[k % 4]
        own, host = rng.choice(hosts), rng.choice(hosts)
        a, cut = rng.randint(0, len(own) - n), rng.randint(0, len(host))
        items.append((k, " ".join(own[a : a + n])))
        copies.append((1000 + k, " ".join([*host[:cut], *own[a : a + n], *host[cut:]])))
    got = found(spark, make, docs + copies, items)
    assert {(1000 + k, k) for k in range(60)} <= {x[:2] for x in got}
    assert got == everywhere(docs + copies, items)


def test_blocks_of_items_in_one_pass_and_in_several(spark, make, world, monkeypatch):
    docs, items, _, _ = world
    some = docs[:120]
    whole = found(spark, make, some, items)
    monkeypatch.setattr(D, "ITEM_BLOCK", 4)
    for at_once in (1, 3, 100):
        monkeypatch.setattr(D, "BLOCKS_A_PASS", at_once)
        assert found(spark, make, some, items) == whole
    assert whole == everywhere(some, items)

