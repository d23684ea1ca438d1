"""Sharding, chats, rules, quality and HTML against plain versions on small tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from oracle import same
from pyspark.sql import functions as F

from tensorfold.llm import chat, html, quality, rules, sharding
from tensorfold.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_matches_the_published_loop():
    keys = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 2000)
    for n in (1, 2, 40, 41, 1000):
        assert sharding.jump(keys, n).tolist() == [jump(int(k) & (2**64 - 1), n) for k in keys]


def test_sharding(make, monkeypatch):
    pairs = [(k, "é" * (k % 7)) for k in range(3000)] + [(5000, None), (5001, ""), (None, "x"), (7, "again"), (7, "again")]
    for rows in (100_000, 10):
        monkeypatch.setattr(sharding, "CHUNK_ROWS", rows)
        got = sharding.sharded(make(pairs).selectExpr("*", "1 as shard", "2 as slot")).collect()
        assert len(got) == len(pairs)
        slots = {}
        for r in got:
            slots.setdefault(r["shard"], []).append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(40))
    by = {r["doc_id"]: r for r in got}
    assert by[5000]["size"] == 16 and by[5000]["text_crc32"] == 0 and by[6]["size"] == 28 and by[6]["text_crc32"] == zlib.crc32("éééééé".encode())
    assert sharding.sharded(make([])).count() == 0


def test_write_shards(make, spark, tmp_path):
    sharding.write(make([(k, "t") for k in range(200)]), str(tmp_path / "s"), 4, 2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 4
    own = make([(k, None if k == 3 else "t") for k in range(50)]).selectExpr("*", "doc_id + 99 as shard", "1 as SHARD_")
    assert sharding.write(own, str(tmp_path / "own"), 4) == "shard__"
    assert {r["doc_id"]: r["shard"] for r in spark.read.parquet(str(tmp_path / "own")).collect()} == {k: k + 99 for k in range(50)}


def test_chat_matches_sql(spark, data):
    assert same(spark, data, QUERIES["op7_chat_format"], SQL["op7_chat_format"]) > 0


def test_chat_cases(spark):
    rows = []

    def add(conv, *texts):
        rows.extend((conv, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts))

    add(1, "a", "b")
    add(2, "a", "b", "c")
    add(3, "a", "b", "c")
    add(4, "a", "x")
    add(5, "")
    add(6, None)
    add(None, "q")
    add(7, *map(str, range(500)))
    add(8, *map(str, range(499)))
    rows += [(2, 0, "user", "a"), (9, None, None, "n"), (9, 3, "user", None)]
    got = {r["conv_id"]: r for r in chat.rendered(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").selectExpr("*", "1 as place", "2 as n")).collect()}
    assert set(got) == {2, 4, 5, None, 7, 9}
    # Rows without an id are a conversation each, and equal or shorter ones collapse as any others do.
    rows += [(None, 0, "user", "a"), (None, 0, "user", "r"), (None, 1, "user", "r"), (None, 0, "user", "r")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    alone = sorted((r["n_turns"], r["rendered"]) for r in chat.rendered(table).where("conv_id is null").collect())
    assert alone == [(1, f"<|user|>\n{x}\n<|end|>\n") for x in "qr"]
    import duckdb

    want = duckdb.connect()
    conversations = table.toArrow()  # noqa: F841
    ours = sorted((str(r["conv_id"]), r["n_turns"], r["rendered"]) for r in chat.rendered(table).collect())
    assert ours == sorted((str(i), n, t) for i, n, t in want.execute(SQL["op7_chat_format"]).fetchall())
    assert got[4]["rendered"] == "<|user|>\na\n<|end|>\n<|assistant|>\nx\n<|end|>\n" and got[7]["n_turns"] == 500
    assert chat.rendered(spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")).count() == 0


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if n[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_rule_counts(make, spark):
    rng = random.Random(3)
    pairs = [(k, "".join(rng.choices(["a", "b c", " ", "\n", "é", "#", "<x>", "\t", "word ", " "], k=rng.randint(0, 150)))) for k in range(300)]
    pairs += [(900, None), (901, ""), (902, "\n\n"), (903, "a b c " * 5000), (None, "x y"), (904, "line\nline\n line\nline")]
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = rules.judged(make(pairs).selectExpr("*", "1 as symbols", "2 as rule"), labels).collect()
    assert Counter((str(r["doc_id"]), *[r[c] for c in rules.COUNTS]) for r in got) == Counter((str(i), *plain_counts(t)) for i, t in pairs)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    assert rules.judged(make([]), labels).count() == 0


def test_upper_limit_is_exact():
    for k, n in ((0, 50), (1, 50), (3, 400)):
        p = rules.upper_limit(k, n, 0.01)
        from math import comb

        assert abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - 0.01) < 1e-6
    assert rules.upper_limit(0, 0, 0.01) == 1 and rules.upper_limit(5, 5, 0.01) == 1


def prose(rng, junk):
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(rng.randint(60, 140))]
    return " ".join(w.upper() + "!!" if junk == 1 else w + "%%%" if junk == 2 else w for w in words)


def labelled(spark, make, n):
    rng = random.Random(8)
    kinds = [rng.choice([0, 0, 0, 1, 2]) for _ in range(n)]
    return make([(k, prose(rng, j)) for k, j in enumerate(kinds)]), spark.createDataFrame([(k, int(j == 0), 0) for k, j in enumerate(kinds)], "doc_id bigint, quality int, toxic int"), kinds


def test_binomial_shares_and_verdicts_by_plain_loops(spark, make):
    from math import comb

    for n, k, p in ((10, 3, 0.2), (400, 0, 0.01), (1000, 37, 0.04), (50_000, 480, 0.01)):
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if n <= 1000 else None
        if want is not None:
            assert abs(rules.at_most(k, n, p) - want) < 1e-9
    docs, labels, _ = labelled(spark, make, 1500)
    got = {r["doc_id"]: r for r in rules.judged(docs, labels).collect()}
    quality_of = {r["doc_id"]: r["quality"] for r in labels.collect()}
    shares = {}
    for r in docs.collect():
        data = np.frombuffer(r["text"].encode(), np.uint8)
        c = rules.count_texts(data, np.array([0, len(data)]))
        shares[r["doc_id"]] = {k: float(c[k][0]) for k in rules.RULES}
    stratum = {i: sum(r["n_words"] > top for top in rules.STRATA) for i, r in got.items()}
    cut = {}
    for s in range(len(rules.STRATA) + 1):
        for rule in rules.RULES:
            here = [(int(np.ceil(shares[i][rule] * rules.BINS)), quality_of[i]) for i, r in got.items() if stratum[i] == s and not r["base_failed"] and i in quality_of]
            n = sum(q for _, q in here)
            best, chosen = 0, None
            for b in range(rules.BINS, 0, -1):
                lost, caught = sum(q == 1 and x >= b for x, q in here), sum(q == 0 and x >= b for x, q in here)
                if not n or rules.upper_limit(lost, n, rules.LEVEL / (len(rules.RULES) * (len(rules.STRATA) + 1))) > rules.LIMIT / len(rules.RULES):
                    break
                if caught - rules.COST * lost > best:
                    best, chosen = caught - rules.COST * lost, b
            cut[s, rule] = chosen
    assert any(cut.values())
    for i, r in got.items():
        hit = any(c is not None and int(np.ceil(shares[i][rule] * rules.BINS)) >= c for rule in rules.RULES for c in [cut[stratum[i], rule]])
        assert r["kept"] == (not r["base_failed"] and not hit)


def test_rules_reject_junk_and_keep_the_rest(spark, make):
    docs, labels, kinds = labelled(spark, make, 3000)
    kept = {r["doc_id"]: r["kept"] for r in rules.judged(docs, labels).collect()}
    good = [kept[k] for k, j in enumerate(kinds) if not j]
    assert sum(good) >= (1 - rules.LIMIT) * len(good)
    assert sum(not kept[k] for k, j in enumerate(kinds) if j == 2) > 0.9 * kinds.count(2)


def test_quality_held_out(spark, make):
    docs, labels, kinds = labelled(spark, make, 1200)
    got = {r["doc_id"]: r for r in quality.scored(docs, labels).collect()}
    out = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert [k for k in range(1200) if got[k]["held_out"]] == out
    assert sum(got[k]["predicted"] == (kinds[k] == 0) for k in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_quality_votes_by_plain_loops(spark, make):
    docs, labels, _ = labelled(spark, make, 300)
    rows = docs.select("doc_id", "text")
    model = quality.fit(rows, labels)
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, labels).collect()}
    for r in docs.collect()[:60]:
        data = np.frombuffer(r["text"].encode(), np.uint8)
        term, value, _ = quality.term_rows(data, np.array([0, len(data)]))
        v = sum((model.projection[t] * x for t, x in zip(term, value, strict=True)), np.zeros(quality.RANK, "f4"))
        v = v / np.linalg.norm(v)
        votes = sorted(((float(v @ u), float(w), float(y)) for u, w, y in zip(model.vectors, model.weights, model.labels, strict=True)), reverse=True)
        near = [x for x in votes if x[0] >= votes[min(quality.NEIGHBOURS, len(votes)) - 1][0]]
        weight = [max(c, 0) ** 8 * w + 1e-9 for c, w, _ in near]
        assert abs(sum(w * y for w, (_, _, y) in zip(weight, near, strict=True)) / sum(weight) - got[r["doc_id"]]) < 1e-3


def test_quality_ignores_held_out_labels_and_edges(spark, make):
    docs, labels, _ = labelled(spark, make, 400)
    odd = docs.unionByName(make([(None, "x"), (9000, None), (9001, ""), (9002, "w " * 50_000), (3, "again")]))
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(str, quality.scored(odd.selectExpr("*", "1 as quality"), x).collect())) for x in (labels, flipped))
    assert a == b and len(a) == 405
    none = quality.scored(odd, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.scored(make([]), labels).count() == 0


PAGE = (
    '<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">X</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy</div>'
    "<article><h1>Head &amp; more</h1><p><b>One  two<br><p>th<i>r</i>ee&nbsp;four</p><div class='comments'><p>me too</p></div><form>name<input></form></article><aside>side</aside><footer>&copy; x</footer></body></html>"
)


def test_html_article(spark):
    rows = [(1, "https://a.example.com/1", PAGE), (2, None, None), (3, "odd", ""), (4, "https://a.example.com/2", "<p>plain &lt;b&gt; <div class='sidebar'>no</div>yes &am"), (5, "u", PAGE[: PAGE.index("me too")]), (1, "https://a.example.com/1", PAGE), (None, "x", "<p>t"), (6, "y", "<p>" + "w " * 40_000)]
    got = html.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as low", "2 as host")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert text[1] == text[5] == "Head & more One two three four"
    assert text[2] == text[3] == "" and text[4] == "plain <b> yes &am" and text[None] == "t" and len(text[6]) == 79_999
    assert html.extracted(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_html_tree_drops_what_a_site_repeats(spark):
    rng = random.Random(1)
    body = lambda k: " ".join(rng.choices(["sun", "rain", "hill", "road"], k=12)) + f" {k}"
    rows = [(k, f"https://s.example.org/{k}", f"<body><div class='box'>Our story since 1900</div><div class='story'><p>{body(k)}</p></div></body>") for k in range(30)]
    got = html.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert all("Our story" not in r["text"] and r["text"].endswith(str(r["page_id"])) for r in got)
    few = html.extracted(spark.createDataFrame(rows[:3], "page_id bigint, url string, html string")).collect()
    assert all(r["text"].startswith("Our story") for r in few)


def test_quality_by_words_alone(spark, make):
    rng = random.Random(5)
    own = [["".join(rng.choices("abcdefghij", k=6)) for _ in range(60)] for _ in range(2)]
    kinds = [k % 2 for k in range(400)]
    docs = make([(k, " ".join(rng.choice(own[j]) for _ in range(80))) for k, j in enumerate(kinds)])
    labels = spark.createDataFrame([(k, j, 0) for k, j in enumerate(kinds)], "doc_id bigint, quality int, toxic int")
    got = [(r["score"], kinds[r["doc_id"]]) for r in quality.scored(docs, labels).collect() if r["held_out"]]
    assert min(s for s, j in got if j) > max(s for s, j in got if not j)


def test_html_names_that_only_contain_a_noise_word():
    story = "<h1>Head</h1><p>" + "word " * 20 + "</p>"
    side = "<div class='sidebar'>Side</div>"
    texts = lambda h: " ".join(t for node, t in html.Page(h).texts if html.PRIOR[(node + (1 << 63)) & 7] > 0)
    whole = "Head " + "word " * 19 + "word"
    for name in ("content has-sidebar", "content no-sidebar", "layout right-sidebar"):
        assert texts(f"<body><div class='{name}'>{story}</div>{side}</body>") == whole
    assert texts(f"<body><article class='post comments-open'><div class='entry-header'><h1>Head</h1></div><p>{'word ' * 20}</p><div class='comments'>me too</div></article>{side}</body>") == whole
    assert texts(f"<body><div class='search'><article>{story}<div class='comments'>me too</div></article></div>{side}</body>") == whole
    assert texts(f"<body><article>{story}</article><div class='related'><article>{'other ' * 90}</article></div></body>") == whole
    assert texts(f"<body><div class='widget'>{story}</div>{side}</body>") == whole


def test_quality_sample_keeps_both_labels(spark, make, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 20)
    rng = random.Random(9)
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 != 2]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in ids], "doc_id bigint, quality int, toxic int")
    rows = [(k, prose(rng, 0 if k % 2 else 2)) for k in ids for _ in range(1 if k % 2 else 12)]
    model = quality.fit(make(rows).select("doc_id", "text"), labels)
    assert sorted(model.labels.tolist()) == [0] * 20 + [1] * 20
    again = quality.fit(make(rows + rows).select("doc_id", "text"), labels)
    assert again.labels.tolist() == model.labels.tolist() and (again.projection == model.projection).all()


def test_html_broken_markup_takes_no_longer():
    import time

    cases = ["<a " + '"' * 10_000, "<a x=\"" * 20_000, "<a '='" * 20_000, "<div class='ad'>" * 20_000 + "x" + "</p>" * 20_000, "<" * 50_000, "<script " * 20_000, "<script></script " * 20_000, "<!--" * 20_000, "<a class" + " " * 50_000, "<li><p>" * 20_000]
    for case in cases:
        began = time.perf_counter()
        html.Page(case)
        assert time.perf_counter() - began < 2, case[:20]
    assert [t for _, t in html.Page("<p>one <a \" href=x>two</a> <b <i>three < four").texts] == ["one two three < four"]


def test_html_evidence_matches_plain_entropy(spark):
    rng = random.Random(4)
    rows = [(k, f"https://{'ab'[k % 5 == 0]}.example.org/{k}", f"<body><div class='x'>{rng.choice(['same', 'same', 'other'])}</div><ul>{''.join(f'<li>{rng.randint(0, 9)}</li>' for _ in range(rng.randint(1, 4)))}</ul><p>text {k}</p></body>") for k in range(40)]
    rows += rows[:7]
    got = {(r["host"], r["node"]): r for r in html.style_tree(html.sites(spark.createDataFrame(rows, "page_id bigint, url string, html string"))).collect()}
    want = {}
    for host in ("a.example.org", "b.example.org"):
        pages = {}
        for h in {h for _, u, h in rows if f"//{host}/" in u}:
            page = html.Page(h)
            found = frozenset((node, kind, v) for kind, pairs in enumerate((page.texts, page.shown)) for node, v in pairs)
            pages[found] = None
        for node, kind in {x[:2] for found in pages for x in found}:
            values = [[v for n, k, v in found if (n, k) == (node, kind)] for found in pages]
            m = sum(map(bool, values))
            count = Counter(v for vs in values for v in vs)
            n = sum(count.values())
            h = -sum(c / n * np.log(c / n) for c in count.values())
            e = (h - np.log(n / m)) / np.log(m) if m > 1 else 1.0
            old = want.get((host, node), (0, 0.0))
            want[host, node] = max(old[0], m), max(old[1], min(max(e, 0), 1))
    assert {k: r["pages"] for k, r in got.items()} == {k: m for k, (m, _) in want.items()}
    for k, r in got.items():
        assert abs(r["evidence"] - want[k][1]) < 1e-6
        part = (k[1] + (1 << 63)) & 7
        assert abs(r["importance"] - html.importance(html.PRIOR[part], r["pages"], r["evidence"])) < 1e-9


def test_html_every_removal_is_the_trees(spark, monkeypatch):
    rng = random.Random(1)
    body = lambda k: " ".join(rng.choices(["sun", "rain", "hill", "road"], k=12)) + f" {k}"
    rows = [(k, f"https://s.example.org/{k}", f"<body><nav>Menu {k}</nav><div>Our story since 1900</div><section><p>{body(k)}</p></section></body>") for k in range(30)]
    pages = html.sites(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    low = html.removed_nodes(pages)
    cut = {r["page_id"]: r["text"] for r in html.cut(pages, low).collect()}
    whole = {r["page_id"]: r["text"] for r in html.cut(pages, low.limit(0)).collect()}
    assert all(whole[k].startswith(f"Menu {k} Our story since 1900 ") and whole[k].endswith(cut[k]) and not {"Menu", "story"} & set(cut[k].split()) for k in cut)
    monkeypatch.setattr(html, "BROADCAST_NODES", -1)
    assert {r["page_id"]: r["text"] for r in html.cut(pages, low).collect()} == cut
    # Without evidence the unnamed block stays: it goes by its entropy, not by a name.
    monkeypatch.setattr(html, "SLOPE", 0.0)
    assert all("Our story" in r["text"] and "Menu" not in r["text"] for r in html.extracted(pages.select("page_id", "url", "html")).collect())
