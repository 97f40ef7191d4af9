"""The whole pipeline on a small corpus against what its stages must keep: toxic texts, exact and near copies, several sources."""

from collections import defaultdict

import numpy as np

import corpus_pipeline
from factloom.llm import mixing, packing, queries, toxicity


def test_run(spark, tmp_path):
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in "bra ket lum nor pis".split() for b in "ado eli imo una oro ibu".split()]
    text = lambda n: " ".join(rng.choice(words, n))
    clean = [text(int(n)) for n in rng.integers(20, 120, 90)]
    rude = [f"{text(12)} scumbag {text(8)} vermin {text(9)} loathsome {text(6)}" for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(200 + i, t) for i, t in enumerate(rude)]
    rows += [(400 + i, clean[i]) for i in range(10)]  # exact copies: the larger id stays
    rows += [(500 + i, clean[20 + i] + " end") for i in range(10) if len(clean[20 + i].split()) > 30]  # near copies: the least id stays
    rows += [(600, None), (601, "")]
    docs = spark.createDataFrame([(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(200 <= i < 300)) for i, _ in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    # Stage by stage in plain Python, but for the trained score and the plan of the mix, which have tests of their own.
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 0").collect()}
    assert not good & set(range(200, 260)) and len(good) == len(rows) - 60
    last = {}
    for i, t in rows:
        if i in good:
            last[t or ""] = max(i, last.get(t or "", -1))
    kept = [(i, t) for i, t in rows if i in last.values()]
    sets = {i: {tuple((t or "").split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set() for i, t in kept}
    group = {i: i for i, _ in kept}
    for i, _ in kept:
        for j, _ in kept:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    left = docs.filter(docs.doc_id.isin([i for i in group if group[i] == i]))
    copies = {r.doc_id: r.copies for r in mixing.mix(left).collect()}
    library = packing.Encoder(queries.tokenizer_path())

    fill, found = defaultdict(list), defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        fill[r.sequence_id].append((r.offset, r.length))
        found[r.doc_id] += r.length
    texts = dict(rows)
    assert dict(found) == {i: n * (len(library.encode([texts[i] or ""])[0]) + 1) for i, n in copies.items() if n}
    for places in fill.values():
        at = 0
        for start, n in sorted(places):
            assert start == at
            at += n
        assert at <= packing.CAPACITY


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
