import random

import numpy as np
import pytest

from tensorfold.llm import language as L

VOCAB = {
    "en": "the of and to in that this with from house water there thing reading".split(),
    "de": "der die das und nicht mit von haus wasser schreiben über für königlich zwischen".split(),
    "fr": "le la les et dans avec pour maison eau être très où déjà français".split(),
    "es": "el los las y con por para casa agua niño señor mañana aquí también".split(),
}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        lang = rng.choice(list(VOCAB))
        rows.append((i, " ".join(rng.choices(VOCAB[lang], k=rng.randint(15, 80))), lang, f"src{i % 5}", 1))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_held_out_accuracy(spark, docs):
    table = L.fit(docs.where("doc_id % 2 = 0"))
    got = L.identify_documents(docs.where("doc_id % 2 = 1"), table).join(docs.selectExpr("doc_id as doc", "lang as want"), "doc")
    assert got.where("lang = want and kept").count() >= 0.99 * got.count()


def test_rejects_what_is_no_language_and_keeps_the_rest(spark, docs):
    odd = spark.createDataFrame([(1000, None, None, None, None), (1001, "", "en", "src1", 0), (1002, "8243 9921 $$$ ### 77213 0000 1111 <<>> 9999 " * 5, None, "src1", 9), (None, VOCAB["de"][0] * 3 + " der die das und nicht", None, None, 1)], docs.schema)
    every = docs.unionByName(odd).selectExpr("*", "1 as doc", "2 as kept")
    out = L.filtered(every)
    assert out.columns == every.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert not {1000, 1001, 1002} & set(kept) and None in kept and len(kept) >= 400
    assert L.filtered(docs.limit(0)).count() == 0
    assert L.filtered(docs.union(docs)).count() == 2 * L.filtered(docs).count()


def test_evidence_of_pages(spark, docs):
    table = L.fit(docs)
    pages = [(k, "https://host.example.fr/x", '<html lang="fr"><script>the the the</script><p>' + " ".join(VOCAB["fr"]) + "</p></html>") for k in range(30)]
    pages += [(100, "https://host.example.fr/x", '<html lang="fr"><p>la</p></html>'), (101, "https://other.example.de/", '<html lang="de"><p>la</p></html>'), (102, None, None)]
    got = {r["page_id"]: r for r in L.identify_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string"), table).collect()}
    assert all(got[k]["lang"] == "fr" and got[k]["kept"] for k in [*range(30), 100])
    assert got[101]["lang"] == "de" and not got[102]["kept"]


def plain_posterior(rows, table):
    """The same fusion by plain loops: {key: (lang, confidence)} of (key, text, host, domain, declared, suffix)."""
    k = len(L.LANGUAGES)
    classes = [*L.LANGUAGES, L.UND]

    def softmax(x):
        e = np.exp(np.array(x) - max(x))
        return e / e.sum()

    evidence = {}
    for key, text, _, _, declared, suffix in rows:
        raw = bytes(L.X.LOWER[np.frombuffer((text or "").encode(), np.uint8)])
        codes = [((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 0x9E3779B1 % 2**32) >> 18 for i in range(len(raw) - 2)]
        scale = min(1 / L.OVERLAP, L.TEXT_WEIGHT / max(len(codes), 1))
        evidence[key] = [scale * sum(float(table[c][x]) for x in codes) + np.log(L.DECLARED_ODDS) * (declared == name) + np.log(L.SUFFIX_ODDS) * (suffix == name) for c, name in enumerate(classes)]
    flat = [np.log((1 - L.UND_PRIOR) / k)] * k + [np.log(L.UND_PRIOR)]
    p = {key: softmax(np.array(e) + flat)[:k] for key, e in evidence.items()}
    total = sum(p.values())
    base = (total + L.SMOOTHING["all"] / k) / (total.sum() + L.SMOOTHING["all"])
    out = {}
    for key, _, host, domain, _, _ in rows:
        own = base
        if host is not None:
            d = sum((p[r[0]] for r in rows if r[3] == domain and r[2] is not None and domain is not None), np.zeros(k))
            h = sum((p[r[0]] for r in rows if r[2] == host), np.zeros(k))
            own = (d + L.SMOOTHING["domain"] * base) / (d.sum() + L.SMOOTHING["domain"])
            own = (h + L.SMOOTHING["host"] * own) / (h.sum() + L.SMOOTHING["host"])
        post = softmax(np.array(evidence[key]) + [*np.log(own * (1 - L.UND_PRIOR)), np.log(L.UND_PRIOR)])
        out[key] = classes[int(np.argmax(post))], float(post.max())
    return out


def test_posterior_matches_plain_loops(spark, docs, monkeypatch):
    rng = random.Random(3)
    table = L.fit(docs)
    rows, pages = [], []
    for k in range(60):
        lang = rng.choice(list(VOCAB))
        host = rng.choice([None, "a.example.de", "b.example.de", "c.site.org", "plain"])
        declared = rng.choice(["", "", "de", "es"])
        text = " ".join(rng.choices(VOCAB[lang], k=rng.randint(0, 30)))
        shown = text.replace("é", "&eacute;")
        pages.append((k, None if host is None else f"https://{host.upper()}/x?y=1", f"<html class=x lang='{declared}-xx'><script>if (a<b) der der</script>{shown}</html>" if declared else shown))
        domain = {"a.example.de": "example.de", "b.example.de": "example.de", "c.site.org": "site.org"}.get(host)
        body = L.plain_text(pages[-1][2])
        assert body.split() == text.split()
        rows.append((k, body, host, domain, declared, "de" if domain == "example.de" else None))
    want = plain_posterior(rows, table)
    for most in (L.BROADCAST_HOSTS, -1):
        monkeypatch.setattr(L, "BROADCAST_HOSTS", most)
        got = L.identify_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "2 as text", "'xx' as lang"), table).collect()
        assert {r["page_id"]: r["lang"] for r in got} == {k: v[0] for k, v in want.items()}
        assert all(abs(r["confidence"] - want[r["page_id"]][1]) < 1e-4 for r in got)


def test_pages_of_any_kind(spark, docs):
    table = L.fit(docs)
    rows = [(1, "http://[odd", "<p>" + " ".join(VOCAB["es"])), (1, "http://[odd", "<p>" + " ".join(VOCAB["es"])), (None, "", ""), (2, "x", "<p>" + "casa agua " * 50_000), (3, None, "<script>" * 1000)]
    got = L.identify_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"), table).collect()
    assert sorted(((r["page_id"] or 0), r["lang"], r["kept"]) for r in got if r["page_id"] in (1, 2)) == [(1, "es", True), (1, "es", True), (2, "es", True)]
    assert len(got) == 5 and not any(r["kept"] for r in got if r["page_id"] in (None, 3))
    assert L.identify_pages(spark.createDataFrame([], "page_id bigint, url string, html string"), table).count() == 0
    assert L.identify_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"), L.fit(docs.limit(0))).count() == 5


def test_markup_is_read_in_linear_time():
    import time

    for text in ("<script" * 50_000, "<script>" * 50_000, "<" * 100_000, "<a " * 50_000, "</style " * 50_000):
        began = time.perf_counter()
        L.plain_text(text)
        assert time.perf_counter() - began < 1, text[:9]
