import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import perspectives, rulequality, toxicity


def labelled(spark, n=600):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("aeioutrnsl") for _ in range(rnd.randint(2, 7)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rnd.randint(5, 60))]
        insult, group = rnd.random() < 0.4, rnd.random() < 0.4
        for yes, term in ((insult, "zzidiot"), (group, "qqgroup")):
            if yes:
                w.insert(rnd.randrange(len(w)), term)
        loud = rnd.random() < 0.3
        docs.append((i, " ".join(w).upper() + "!!" if loud else " ".join(w).capitalize() + "."))
        labels.append((i, int(not loud), int(insult and group)))
    docs += [(n, None), (n + 1, ""), (None, "zzidiot")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(n, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_machine_learns_the_pair(spark):
    docs, labels = labelled(spark)
    machine = toxicity.train(docs, labels, "toxic")
    rows = toxicity.score(docs.withColumn("score", F.lit("old")), machine).join(labels, "doc_id").filter(~toxicity.in_training() & F.col("toxic").isNotNull()).collect()
    right = np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows])
    assert len(rows) > 80 and right > 0.95
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, machine).collect())
    kept = toxicity.drop_toxic(docs.withColumn("score", F.lit(7)), labels)
    assert kept.columns == ["doc_id", "text", "score"] and kept.filter("score <> 7").count() == 0 and kept.filter("text is null").count() == 1
    assert toxicity.score(docs.limit(0), machine).count() == 0


def test_rare_insults_beside_many_stronger_terms(spark):
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    plain, loud = [word(5) for _ in range(60)], [word(10) for _ in range(300)]  # with their beginnings some 1,500 loud terms
    docs, labels = [], []
    for i in range(1200):
        kind = "insult" if i < 48 else "loud" if i % 4 == 0 else "clean"
        words = rnd.sample(plain, 12) + (["zzq"] if kind == "insult" else loud if kind == "loud" else [])
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind != "clean")))
    new = [(10_000 + i, " ".join(rnd.sample(plain, 12) + ["zzq"] * (i % 2))) for i in range(40)]
    docs, labels = spark.createDataFrame(docs + new, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    for changed in ({}, {"block_rows": 300}):
        settings = toxicity.Settings(**changed)
        machine = toxicity.train(docs, labels, "toxic", settings=settings)
        scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, machine).filter("doc_id >= 10000").collect()}
        assert all((x >= 0.5) == (i % 2 == 1) for i, x in scored.items()) and len(machine.weights) > 1500
        held = toxicity.buckets(["zzq " + " ".join(plain)], settings.hash_bits, settings.prefixes)
        assert (machine.slot[next(held)] >= 0).all()


def test_settings_are_compared_inside_the_training_rows(spark):
    """Held-out labels turned round change no figure; a machine that learns nothing is worse; no rows, no figure."""
    docs, labels = labelled(spark, 300)
    choices = [toxicity.Settings(), toxicity.Settings(least_rows=10**6)]
    found = toxicity.compared(docs, labels, "toxic", choices)
    turned = labels.withColumn("toxic", F.when(toxicity.in_training(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    again = toxicity.compared(docs, turned, "toxic", choices[:1])
    assert again[0] == found[0]
    assert found[0]["rows"] == docs.join(labels, "doc_id").filter(toxicity.in_training() & F.col("toxic").isNotNull()).count()
    assert found[0]["wrong"] < found[1]["wrong"] and found[0]["log_loss"] < found[1]["log_loss"]
    assert toxicity.compared(docs.limit(0), labels, "toxic", choices[:1]) == [{"settings": choices[0], "rows": 0, "wrong": 0, "log_loss": None}]


def test_machine_over_sparse_rows():
    """Margins and gradients of sparse batches against dense sums and differences."""
    rng = np.random.default_rng(3)
    x = (rng.random((50, 9)) < 0.3).astype(float)
    x[7] = 0
    rows = toxicity.Rows(np.nonzero(x)[1], np.count_nonzero(x, axis=1), 9)
    k, p, y, weight = rng.permutation(50)[:20], rng.normal(size=(9, 4)), rng.integers(0, 2, 20), rng.random(20)
    k[0] = 7
    batch = toxicity.Batch(rows[k], y, weight)

    def margin(p):
        pairs = [sum(p[i, 1:] @ p[j, 1:] for i in np.flatnonzero(r) for j in np.flatnonzero(r) if i < j) for r in x[k]]
        return 0.3 + x[k] @ p[:, 0] + np.array(pairs)

    loss = lambda p: (weight * (np.log1p(np.exp(margin(p))) - y * margin(p))).mean()
    assert np.allclose(batch.margin(0.3, p[batch.touched])[0], margin(p))
    _, grads = batch.gradient(0.3, p[batch.touched])
    for i in range(4):
        for j, column in enumerate(batch.touched):
            step = np.zeros_like(p)
            step[column, i] = 1e-5
            assert abs((loss(p + step) - loss(p - step)) / 2e-5 - grads[j, i]) < 1e-6
    empty = toxicity.Batch(toxicity.Rows(np.zeros(0, int), np.zeros(3, int), 9), np.ones(3), np.ones(3))
    assert empty.gradient(0.0, p[:0])[1].shape == (0, 4) and empty.margin(0.5, p[:0])[0].tolist() == [0.5] * 3


def test_columns_of_the_same_rows_are_met_once():
    """A word and its beginnings are one group for the rows that hold them, and so is all that one row alone holds; names that clash join nothing."""
    rng = np.random.default_rng(4)
    x = (rng.random((40, 30)) < 0.2).astype(float)
    x[:, 10:25] = x[:, [0, 1, 2, 3, 4] * 3]
    x[:, 25:] = np.eye(40)[:, [5, 5, 5, 9, 9]]
    rows = toxicity.Rows(np.nonzero(x)[1], np.count_nonzero(x, axis=1), 30)
    batch = toxicity.Batch(rows, np.ones(40), np.ones(40))
    patterns = {tuple(c) for c in x.T if c.any()}
    assert len(batch.columns) == len(patterns) and len(batch.group) == sum(map(sum, patterns)) < x.sum()
    row, column = np.nonzero(x)[0][np.argsort(np.nonzero(x)[1], kind="stable")], np.sort(np.nonzero(x)[1])
    starts = np.flatnonzero(np.diff(column, prepend=-1))
    order, first = toxicity._alike(row, starts, np.diff(starts, append=len(row)), np.zeros(40, np.uint64))
    held = [tuple(x[:, column[starts[k]]]) for k in order]
    assert all(new or a == b for new, a, b in zip(first[1:], held, held[1:], strict=False))


def test_without_one_of_the_labels(spark):
    docs, labels = labelled(spark, 20)
    for some in (labels.limit(0), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(None).cast("int")), labels.withColumn("doc_id", F.lit(None).cast("long"))):
        machine = toxicity.train(docs, some, "toxic")
        assert {r["score"] for r in toxicity.score(docs, machine).collect()} == {0.0}
        assert toxicity.drop_toxic(docs, some).count() == docs.count() == 23
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels.withColumn("toxic", F.lit(1)), "toxic")).collect()} == {1.0}
    assert {r["score"] for r in rulequality.score(docs, rulequality.train(docs, labels.limit(0))).collect()} == {0.5}


def test_score_of_a_text_by_hand(spark):
    """Terms, slots and the sum over all pairs, one at a time."""
    docs, labels = labelled(spark)
    machine = toxicity.train(docs, labels, "toxic")
    s = machine.settings

    def term(word: bytes, prefix: int | None = None) -> int:
        found = list(toxicity.buckets([word.decode()], s.hash_bits, () if prefix is None else (prefix,)))[0].tolist()
        plain = list(toxicity.buckets([word.decode()], s.hash_bits))[0].tolist()
        return plain[0] if prefix is None else next((x for x in found if x not in plain), plain[0])

    for text in ("ZZIDIOT qqgroup, and x", "zzidiots' friend", "", None, "zzidiot"):
        words = "".join(c if c.isalnum() or c in "_'" else " " for c in (text or "").lower()).encode().split()
        held = {term(w) for w in words} | {term(w, n) for w in words for n in s.prefixes if len(w) >= n}
        at = [machine.slot[t] for t in held if machine.slot[t] >= 0]
        margin = machine.bias + sum(float(machine.weights[i]) for i in at)
        margin += sum(float(machine.factors[i] @ machine.factors[j]) for n, i in enumerate(at) for j in at[:n])
        assert abs(machine.score([text])[0] - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))) < 1e-5


def test_factors_learn_what_weights_cannot():
    """Either term, but not both: no sum of weights separates that; with factors held at 0 the same fit fails."""
    rng = np.random.default_rng(1)
    x = (rng.random((800, 6)) < 0.5).astype(np.uint8)
    y = (x[:, 0] ^ x[:, 1]).astype(float)
    s = toxicity.Settings(epochs=150, decay=0.0)

    def right(start):
        w0, w, v = toxicity.fit_machine(x, y, s, start)
        rows = toxicity.Batch(toxicity.Rows(np.nonzero(x)[1], np.count_nonzero(x, axis=1), 6), y, y)
        return ((rows.margin(w0, np.concatenate([w[:, None], v], 1))[0] > 0) == (y > 0)).mean()

    assert right(None) > 0.98
    assert right((0.0, np.zeros(6), np.zeros((6, s.factors)))) < 0.85  # factors of 0 have no gradient: only weights learn


def test_rules_score_like_columns(spark):
    docs, labels = labelled(spark)
    e = rulequality.train(docs, labels)
    assert 0 < len(e.rules) < 200
    measured = rulequality._measured(docs, "text")
    rows = measured.withColumn("score", e.column()).collect()
    x = np.array([[r[f"__s_{n}"] for n in rulequality.NAMES] for r in rows])
    margin = e.bias + sum(w * rulequality.holds(r, x) for w, r in e.rules)
    assert np.allclose(1 / (1 + np.exp(-margin)), [r["score"] for r in rows])
    held = rulequality.score(docs, e).join(labels, "doc_id").filter(~toxicity.in_training() & F.col("quality").isNotNull()).collect()
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in held]) > 0.95
    assert "score" in rulequality.score(docs.limit(0), e).columns and list(rulequality.statistics(F.lit(""))) == rulequality.NAMES


def test_perspectives(spark):
    turns = [("a", 0, "system", "Be kind"), ("a", 1, "ann", "hi"), ("a", 2, "bob", None), ("a", 3, "ann", "so é"), ("b", 0, "system", "x"), (None, 1, "ann", "q"), ("c", None, "cy", "late"), ("c", 5, None, "who")]
    df = spark.createDataFrame([(*t, "k") for t in turns], "conv_id string, turn int, role string, text string, start string")
    rows = perspectives.rotate(df).collect()
    assert {(r["conv_id"], r["perspective"]) for r in rows} == {("a", "ann"), ("a", "bob"), (None, "ann"), ("c", "cy")}
    for c, p, want, learnt in (
        ("a", "ann", "<|system|>\nBe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user|> bob\n<|end|>\n<|assistant|>\nso é<|end|>\n", ["hi<|end|>", "so é<|end|>"]),
        ("a", "bob", "<|system|>\nBe kind<|end|>\n<|user|> ann\nhi<|end|>\n<|assistant|>\n<|end|>\n<|user|> ann\nso é<|end|>\n", ["<|end|>"]),
        ("c", "cy", "<|user|> unknown\nwho<|end|>\n<|assistant|>\nlate<|end|>\n", ["late<|end|>"]),
    ):
        own = sorted((r for r in rows if (r["conv_id"], r["perspective"]) == (c, p)), key=lambda r: r["start"])
        text = "".join(r["rendered"] for r in own)
        assert text == want and all(text[r["start"] : r["end"]] == r["rendered"] for r in own)
        assert [text[r["mask_start"] : r["mask_end"]] for r in own if r["mask_start"] is not None] == learnt
    assert perspectives.rotate(df.limit(0)).count() == 0
    long = spark.createDataFrame([("z", i, "ab"[i % 2], "t" * (i % 5)) for i in range(700)], "conv_id string, turn int, role string, text string")
    own = sorted(perspectives.rotate(long).filter("perspective = 'a'").collect(), key=lambda r: r["turn"])
    assert all(x["end"] == y["start"] for x, y in zip(own, own[1:], strict=False)) and own[0]["start"] == 0


def test_lasso_is_at_its_optimum():
    """The conditions of an optimum: a gradient of the penalty's size against each weight, and no larger one where the weight is 0."""
    rng = np.random.default_rng(2)
    r = rng.random((500, 12)) < 0.4
    y = (rng.random(500) < 1 / (1 + np.exp(-(2.0 * r[:, 0] - 1.5 * r[:, 3] - 0.3)))).astype(float)
    s = rulequality.Settings(penalty=0.02, rounds=4000)
    bias, w = rulequality.lasso(r, y, s)
    d = 1 / (1 + np.exp(-(r @ w + bias))) - y
    grad = r.T.astype(float) @ d / len(y)
    assert abs(d.mean()) < 1e-4 and 0 < (w != 0).sum() < 12
    assert np.allclose(grad[w != 0], -s.penalty * np.sign(w[w != 0]), atol=1e-4) and (np.abs(grad[w == 0]) <= s.penalty + 1e-4).all()


def test_quality_sample_counts_training_rows_only(spark, monkeypatch):
    """Labels of other corpora do not thin the sample; clashing columns stay."""
    docs, labels = labelled(spark, 200)
    more = labels.unionByName(spark.range(10_000, 60_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic"))
    seen = []
    real = rulequality.propose
    monkeypatch.setattr(rulequality, "propose", lambda x, y, s: seen.append(len(y)) or real(x, y, s))
    e = rulequality.train(docs, more, settings=rulequality.Settings(fit_rows=100))
    rulequality.train(docs, labels, settings=rulequality.Settings(fit_rows=100))
    assert seen[0] == seen[1] == 100
    clash = docs.withColumn("__s_words", F.lit("mine")).withColumn("_score", F.lit(1))
    assert {r["__s_words"] for r in rulequality.score(clash, e).collect()} == {"mine"}
