import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, jaccard, texthash


def shingles(text, k=5):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in low.translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, percent=80):
    sets = [(i, shingles(t)) for i, t in docs]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(s), least.get(root(k), i) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def corpus(seed, groups=6, size=12):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    common = [word() for _ in range(14)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.choice([3, 6, 20, 60, 150]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                w[rnd.randrange(len(w))] = word()
            if rnd.random() < 0.4:
                w += common
            if rnd.random() < 0.3:
                w = w[: int(len(w) * 0.85) + 1]
            out.append(" ".join(w))
    return out + [None, "", " \n\t", "One Two", "one two", "one two three", out[0].upper(), out[0], " ".join(common), "x " * 3000]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(docs_of, seed):
    texts = corpus(seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    ids[3] = None
    ids[5] = ids[4]
    df = docs_of(texts, ids).repartition(3)
    got = sorted((tuple(r) for r in jaccard.jaccard_components(df).collect()), key=str)
    assert got == brute(list(zip(ids, texts, strict=True)))


def test_split_columns_hubs_and_parts(docs_of, monkeypatch):
    """A family around one text, a chain, and texts below the bound that share most words, with every limit at a few rows."""
    monkeypatch.setattr(jaccard, "SPLIT", 5)
    monkeypatch.setattr(jaccard, "REST_ROWS", 3)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    monkeypatch.setattr(common, "FEW_ROWS", 2)
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(80)]
    texts = []
    for i in range(40):  # near the base, each with one word of its own
        w = list(base)
        w[rnd.randrange(80)] = word()
        texts.append(" ".join(w))
    for i in range(25):  # a chain: each near the next one only
        texts.append(" ".join(base[40:] + [f"c{k}" for k in range(i * 3, i * 3 + 60)]))
    for i in range(30):  # one template, too many words of their own
        texts.append(" ".join([f"t{k}" for k in range(30)] + [word() for _ in range(12)]))
    texts += [texts[0]] * 5
    got = sorted((tuple(r) for r in jaccard.jaccard_components(docs_of(texts).repartition(3)).collect()), key=str)
    assert got == brute(list(enumerate(texts)))


def test_joins_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW_ROWS", 10)
    many = common.stored(spark.createDataFrame([(None if i % 7 == 0 else 5 if i % 3 else i % 11, i) for i in range(300)], "k long, i long"), "many")
    one = spark.createDataFrame([(k, f"v{k}") for k in range(9)] + [(5, "w5")], "k long, v string")
    for how in ("inner", "left"):
        want = sorted((tuple(r) for r in many.join(one, "k", how).collect()), key=str)
        assert sorted((tuple(r) for r in common.spread_join(many, one, "k", how).collect()), key=str) == want and len(want) > 250


def test_one_of_each_and_empty(docs_of):
    df = docs_of(["a b c d e f g", "A b c d e f g", "", None, "z y x w v u"], [9, 4, 1, 2, 7])
    kept = jaccard.one_per_component(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 7] and kept.columns == df.columns
    assert jaccard.jaccard_components(df.limit(0)).count() == 0
    assert jaccard.jaccard_components(df.filter(F.col("text").isNull())).collect()[0]["component_id"] == 2
    clash = df.withColumnsRenamed({"slot": "__id", "extra": "__times"}).withColumns({"__kept": F.lit(1), "__digest": F.lit("d"), "__salt": F.lit(2), "label": F.lit(3), "node": F.lit(4)})
    assert sorted(r["doc_id"] for r in jaccard.one_per_component(clash.unionAll(clash)).collect()) == [1, 1, 2, 2, 4, 7] and jaccard.one_per_component(clash).columns == clash.columns


def test_one_of_each_with_repeated_and_null_ids(spark):
    a, b, c = ("a b c d e f g h i j k l", "m n o p q r s t u v w x", "one two three four five six")
    rows = [(5, a, "x"), (5, a, "x"), (5, a, "y"), (3, b, "x"), (5, b.upper(), "x"), (None, c, "x"), (None, c + " ", "x"), (None, c, "x"), (None, "other words here", "x"), (None, "A " + a[2:], "x"), (None, "", "x"), (None, None, "x"), (8, " ", "x"), (8, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("more", F.create_map(F.lit("k"), F.col("source"))).repartition(3)
    kept = jaccard.one_per_component(df)
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    worded = sorted(((i, t.strip()) for i, t in found if (t or "").strip()), key=str)
    assert worded == sorted([(5, a), (3, b), (None, c), (None, "other words here")], key=str)
    assert sorted((x for x in found if not (x[1] or "").strip()), key=str) == sorted([(None, ""), (None, None), (8, " "), (8, " ")], key=str)
    assert kept.columns == df.columns and kept.schema["more"].dataType == df.schema["more"].dataType


def test_word_hashes_follow_words():
    texts = ["a bb  ccc", "", None, "Hello, WORLD x", "word " * 300_000 + "end", "x" * 2_000_000, " lead\ttab\x0bv"]
    hashed = list(texthash.words(texts))
    assert [len(h) for h in hashed] == [len((t or "").split()) for t in texts]
    assert all((a == next(texthash.words([t]))).all() for a, t in zip(hashed, texts, strict=True))
    assert next(texthash.words(["AbC"]))[0] == next(texthash.words(["aBc"]))[0] != next(texthash.words(["É"]))[0]
