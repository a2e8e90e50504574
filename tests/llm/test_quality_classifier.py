import numpy as np

from catalogspark.llm import quality_classifier as qc


def tables(spark, tmp_path, seed=1, n=900):
    rng = np.random.default_rng(seed)
    vocab, bad = [f"w{i}" for i in range(300)], ["vile", "rude"]
    docs, labels = [], []
    for i in range(n):
        kind = rng.random()
        words = list(rng.choice(vocab, int(rng.integers(20, 120))))
        if kind < 0.15:
            words = [w + "###" for w in words]
        elif kind < 0.3:
            for k in rng.integers(0, len(words), 3):
                words[k] = str(rng.choice(bad))
        good = kind >= 0.3
        source = "clean" if (good if rng.random() < 0.8 else not good) else "dirty"
        docs.append((i, " ".join(words), "en", source, len(words)))
        if i % 2 == 0:
            labels.append((i, int(kind >= 0.15), int(0.15 <= kind < 0.3)))
    truth = [d[3] for d in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = {i: not ("###" in d[1] or any(b in d[1].split() for b in bad)) for i, d in enumerate(docs)}
    return want, truth


def auc(score, good):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = good.sum()
    return (rank[good].sum() - n * (n + 1) / 2) / (n * (len(good) - n))


def test_rows_without_label_are_told_apart(spark, tmp_path):
    want, _ = tables(spark, tmp_path)
    got = {r.doc_id: r for r in qc.op2_quality_classifier(spark, str(tmp_path)).collect()}
    ids = [i for i in want if i % 2]
    good = np.array([want[i] for i in ids])
    assert auc(np.array([got[i].score for i in ids]), good) > 0.97
    assert np.mean([got[i].kept == want[i] for i in ids]) > 0.9
    assert auc(np.array([got[i].meta_score for i in ids]), good) > 0.65
    again = {r.doc_id: r.score for r in qc.op2_quality_classifier(spark, str(tmp_path)).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", qc.F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in qc.scored(docs, none).collect()] == [0.5] * 3
    one = spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(qc.scored(docs, one).collect()) == 3
    assert qc.scored(docs.limit(0), one).count() == 0


def test_exchange_counts_all_documents_outside_the_sample(spark, tmp_path):
    """Evidence equals that of a plain loop over the documents, however they are partitioned."""
    tables(spark, tmp_path, seed=3, n=300)
    docs, labels = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels"))
    docs = docs.unionByName(docs.filter("doc_id % 10 = 1")).unionByName(spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "clean", 0)], docs.schema))
    fit = qc.Fit(labelled=80, rounds=1)
    model = qc.fitted(docs, labels, "doc_id", "text", fit)
    rows = qc.columns(docs, "doc_id", "text")
    some = labels.select(qc.F.col("doc_id").alias("key")).limit(40)
    got = qc.exchanged(rows.repartition(5), some, model, fit)
    left_out = {r.key for r in some.collect()}
    counts = np.zeros((2, 2, qc.SLOTS + 1))
    for r in rows.collect():
        if r.key in left_out:
            continue
        (slots, at, dense), = qc.text_features(qc.pa.array([r.text], qc.pa.string()))
        meta = qc.meta_features([r.lang], [r.source], [r.n_chars])[0]
        odds = [model.text.odds(slots, at, dense)[0], model.meta.odds(meta, np.array([0, 3]), np.ones((1, 1)))[0]]
        for learner, mine in enumerate((slots, meta)):
            moved = odds[1 - learner] - model.prior
            if abs(moved) >= np.log(fit.sure):
                np.add.at(counts[learner, int(moved > 0)], mine, 1)
                counts[learner, int(moved > 0), -1] += 1
    assert counts[0].sum() and counts[1].sum()
    for mine, c in zip(got, counts, strict=True):
        assert np.allclose(mine, qc.ratios(c[1], c[0]))


def test_exchange_teaches_words_too_rare_among_labelled_rows(spark):
    """Each of 400 telling words is in one labelled row or two, but in many documents whose metadata tell their class."""
    rng = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(2400):
        bad = i % 3 == 0
        words = [*rng.choice([f"w{k}" for k in range(80)], 12), *(f"{'vile' if bad else 'fine'}{k}" for k in rng.integers(0, 200, 3))]
        docs.append((i, " ".join(words), "en", "dirty" if bad else "clean", 100))
        if i < 200:
            labels.append((i, int(not bad), 0))
    data = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ids = np.arange(200, 2400)

    def found(rounds):
        got = {r.doc_id: r.text_score for r in qc.scored(data, known, fit=qc.Fit(rounds=rounds)).collect()}
        return auc(np.array([got[i] for i in ids]) + ids * 1e-12, ids % 3 != 0)

    assert found(2) > max(0.8, found(0) + 0.1)


def test_clashing_names_and_a_long_text(spark):
    docs = spark.createDataFrame([(i, ("good words " * (200000 if i == 1 else 5)) if i % 2 else "bad ### " * 5, "en", "s", 9) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: qc.F.lit("x") for c in ("key", "y", "rank", "row", "learner", "slot", "text_score", "kept")})
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in qc.scored(docs, labels).collect()}
    assert len(got) == 60 and min(got[i] for i in got if i % 2) > max(got[i] for i in got if i % 2 == 0)
