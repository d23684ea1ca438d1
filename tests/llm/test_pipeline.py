import random

import corpus_pipeline
from test_minhash import brute as near
from test_suffix_dedup import brute as repeated



def test_stages_on_planted_cases(spark, make, tmp_path):
    """Clean documents stay; one of each group of copies, no leak and no repeated passage reaches the sequences."""
    rng = random.Random(6)
    words = {lang: ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(3000)] for lang, letters in (("en", "theringansou"), ("de", "schderübeitz"))}
    say = lambda lang, k: " ".join(rng.choices(words[lang], k=k))
    items = [(k, say("en", 30)) for k in range(5)]
    clean = [(i, say("en" if i % 2 else "de", 120)) for i in range(60)]
    copies = [(100 + i, clean[i][1] + " end") for i in range(8)]
    passage = say("en", 60)
    shared = [(200 + i, say("en", 90) + " " + passage + " " + say("en", 60)) for i in range(3)]
    leaks = [(300 + i, say("en", 60) + " " + items[i][1] + " " + say("en", 50)) for i in range(4)]
    pairs = clean + copies + shared + leaks + [(400, None), (401, "")]
    docs = make(pairs)
    langs = {i: "en" if i % 2 or i >= 100 else "de" for i, _ in pairs}
    rows = [(r["doc_id"], r["text"], langs[r["doc_id"]], r["source"], r["n_chars"]) for r in docs.collect()]
    spark.createDataFrame(rows, docs.schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, d, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        before, d = d, spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = d
        if k < 4:
            assert d.columns == before.columns
    ids = lambda x: {r["doc_id"] for r in x.select("doc_id").distinct().collect()}
    assert ids(seen["language"]) == {i for i, t in pairs if t}
    stays = {int(r[0]) for r in near([(i, t) for i, t in pairs if t]) if r[3]}
    assert ids(seen["near duplicates"]) == stays
    after = {r["doc_id"]: r["text"] for r in seen["repeated passages"].collect()}
    want = repeated([(i, t) for i, t in pairs if i in stays])
    assert {i: len(t.encode()) for i, t in after.items()} == {i: n - gone for (i, _), (n, gone, _, _) in want.items()}
    assert ids(seen["benchmark passages"]) == stays - {i for i, _ in leaks}
    assert ids(seen["packing"]) == stays - {i for i, _ in leaks} and {i for i, _ in clean} <= ids(seen["packing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()
