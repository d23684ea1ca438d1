import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tensorfold.llm import packing as P
from tensorfold.llm import tokens as T


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.vocabulary_path())


def encoded(encoder, texts):
    ids, bounds = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


ODD = ["a <|endoftext|> x", "<|endoftext|><|endoftext|>", "<|endoftext", "", "'t's 're'x 'lll don't'd  's\t's '", "\u088f\U00010940 \u1c89 x", "a" + "\u00a0" * 3 + "b  \u2003c", "tail \n ", "a\x1cb \x1f\x85 x", "tab\t\tx  y \n\n z ", "it's we'll I'd ''s", "日本 語　x y z​q", "<|endoftext|> x", "٣٤ ½ x²", "é नमस्", " ", "\r\n", "👩‍👩 a"]


def test_parts_give_the_ids_of_whole_texts(reference):
    assert encoded(T.Encoder(P.vocabulary_path()), ODD) == [reference.encode(t, add_special_tokens=False).ids for t in ODD]


def test_tables_texts_have_the_ids_of_whole_texts(reference, monkeypatch):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    want = [e.ids for e in reference.encode_batch_fast(texts, add_special_tokens=False)]
    assert encoded(T.Encoder(P.vocabulary_path()), texts) == want
    # Small tiles, and a memory that is emptied and merged all the time.
    monkeypatch.setattr(T, "TILE", 300)
    monkeypatch.setattr(T, "KNOWN_PARTS", 200)
    monkeypatch.setattr(T, "RECENT_PARTS", 20)
    assert encoded(T.Encoder(P.vocabulary_path()), texts[:200]) == want[:200]


SIGNS = st.sampled_from(list("aZ09 ' \t\n.strvelmd'é٣日\u00a0\u0301") + ["<|endoftext|>", "'ll", "'re", "  "])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.lists(SIGNS, max_size=30).map("".join)), max_size=4))
def test_any_text(texts):
    from tokenizers import Tokenizer

    global KEPT
    KEPT = globals().get("KEPT") or (T.Encoder(P.vocabulary_path()), Tokenizer.from_file(P.vocabulary_path()))
    assert encoded(KEPT[0], texts) == [KEPT[1].encode(t, add_special_tokens=False).ids for t in texts]


def fewest(lengths, size):
    """Least number of bins, by trying all."""
    best = len(lengths)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= size:
                go(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best


def test_bound_never_exceeds_the_least():
    rng = random.Random(0)
    for _ in range(150):
        x = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        where, offset, used = P.best_fit(np.array(x), 20)
        assert P.lower_bound(np.array(x), 20) <= fewest(x, 20) <= len(used)
        for b in range(len(used)):
            own = sorted((offset[i], x[i]) for i in range(len(x)) if where[i] == b)
            assert [o for o, _ in own] == [0, *itertools.accumulate(s for _, s in own)][:-1] and used[b] <= 20


def check(docs, rows, reference, pairs):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_seq.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) <= 1024
    for i, t in pairs:
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert len(own) == max(1, -(-len(ids) // 1024)) and all(r["length"] == 1024 for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    return len(by_seq)


def test_packed(make, reference):
    rng = random.Random(2)
    pairs = [(k, "word " * rng.choice([0, 3, 100, 700, 1500, 5000])) for k in range(60)] + [(100, None), (101, "x" * 200_000), *((200 + k, t) for k, t in enumerate(ODD))]
    n = check(make(pairs), P.packed(make(pairs)).collect(), reference, pairs)
    many = check(make(pairs), P.packed(make(pairs), per_task=20).collect(), reference, pairs)
    lengths = [r["length"] for r in P.packed(make(pairs)).collect()]
    assert P.lower_bound(np.array(lengths)) <= n <= P.lower_bound(np.array(lengths)) + 1 and many <= n + 3
    assert P.packed(make([])).count() == 0
    for r in P.packed(make(pairs), per_task=20).collect():
        assert r["bins"] >= r["bound"] >= 1
    twice = P.packed(make([(1, "a b"), (1, "a b"), (None, "c")]).selectExpr("*", "1 as uid", "'x' as ids", "2 as piece", "3 as bound")).collect()
    assert len(twice) == 3 and len({r["sequence_id"] for r in twice}) == 1
    seqs = P.sequences(make([(1, "a b"), (2, "c")])).collect()
    assert sorted(seqs[0]["ids"]) == sorted([*reference.encode("a b").ids, 2, *reference.encode("c").ids, 2])


def test_rounds_lose_no_piece(spark):
    rng = random.Random(6)
    sizes = [rng.randint(200, 1023) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "uid bigint, length bigint")
    rows = P.placements(items, per_task=40).collect()
    assert sorted(r["uid"] for r in rows) == list(range(3000))
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], sizes[r["uid"]]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) <= 1024
    whole = P.best_fit(np.array(sizes))[2]
    alone = sum(len(P.best_fit(np.array(sizes[k : k + 40]))[2]) for k in range(0, 3000, 40))
    assert len(whole) - 5 <= len(by) < alone
