import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(prints, radius=2):
    """(id, fingerprint) rows: each row's component, by all pairs."""
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= radius:
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((-1 if d is None else d, f"{f:016x}", least.get(root(i), -1)) for i, (d, f) in enumerate(prints))


def rows_of(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fingerprint"], -1 if r["component_id"] is None else r["component_id"]) for r in df.collect())


def test_fingerprints(spark):
    rnd = random.Random(1)
    texts = [None, "", " \n", "One", "one two", "A b C", "a b c d", "é À b\x1cc d e f g", "x " * 500, *(" ".join(rnd.choice(["a", "bb", "Wörd", "x1"]) for _ in range(rnd.randint(1, 400))) for _ in range(40))]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    s = "some words hashed"
    assert simhash.fingerprint(s) == spark.range(1).select(F.xxhash64(F.lit(s)).alias("h")).first()["h"] % 2**64


def test_long_texts_are_cut_between_words(monkeypatch):
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abc\té") for _ in range(rnd.randint(1, 30))) for _ in range(300))
    whole = simhash.fingerprint(text)
    for piece in (1, 7, 50, 1000):
        monkeypatch.setattr(simhash, "_PIECE", piece)
        assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


def scattered(rnd, n):
    """Clouds of fingerprints some bits apart, and lone ones."""
    out = set()
    while len(out) < n:
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 30])):
            x ^= 1 << rnd.randrange(64)
            if rnd.random() < 0.5:
                x ^= 1 << rnd.randrange(64)
            out.add(x)
    return list(out)


def test_trees_find_all_within_the_radius():
    rnd = random.Random(3)
    for n in (1, 2, 50, 2000):
        every = np.array(scattered(rnd, n), np.uint64)
        for is_odd in (False, True):
            values = every[simhash._odd(every) == is_odd]
            tree = simhash.BkTree(values)
            assert sorted(tree.value) == sorted(values)
            asked = np.concatenate([every, values ^ np.uint64(1), values ^ np.uint64(6)])
            got = {(int(asked[i]), int(tree.value[j])) for q, at in tree.search(asked, 2) for i, j in zip(q, at)}
            assert got == {(int(a), int(v)) for a in asked for v in values if (int(a) ^ int(v)).bit_count() <= 2}


def test_search_visits_a_part_of_the_tree():
    rnd = np.random.default_rng(4)
    values = rnd.integers(0, 2**64, 40_000, np.uint64)
    tree = simhash.BkTree(values[~simhash._odd(values)])
    met = sum(len(q) for (q, _, _), _, _ in tree._descend(tree.value[:200], 2)) / 200
    assert met < len(tree.value) / 20


def test_links_are_complete_however_the_tree_is_dealt(spark):
    rnd = random.Random(5)
    prints = [(i, x) for i, x in enumerate(scattered(rnd, 600))]
    signed = [(x - 2**64 if x >> 63 else x,) for _, x in prints]
    found = spark.createDataFrame(signed, "fp long")
    want = {}
    for d, f, c in brute_components(prints):
        want.setdefault(c, set()).add(f)
    for sample, shard, asked in ((4096, 32768, 131072), (8, 5, 7), (1, 1000, 20), (64, 3, 1000)):
        rows = simhash.links(found, 2, sample, shard, asked).collect()
        label = {f"{x:016x}": f"{x:016x}" for _, x in prints}

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for r in rows:
            a, b = (root(f"{x % 2**64:016x}") for x in (r["a"], r["b"]))
            label[max(a, b)] = min(a, b)
        got = {}
        for x in label:
            got.setdefault(root(x), set()).add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_documents(spark, docs_of):
    rnd = random.Random(6)
    texts, ids = [None, "", " ", "same", "same", "Same"], [None, 5, 9, 8, None, 8]
    for i in range(25):
        base = [rnd.choice("abcdefghijklm") * rnd.randint(1, 3) for _ in range(rnd.randint(3, 900))]
        for j in range(rnd.randint(1, 6)):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = rnd.choice(["new", "abc"])
            texts.append(" ".join(copy))
            ids.append(100 * i + j + 10)
    order = list(range(len(texts)))
    rnd.shuffle(order)
    df = docs_of([texts[i] for i in order], [ids[i] for i in order])
    got = simhash.near_components(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = brute_components([(i, brute_fingerprint(t)) for i, t in zip(ids, texts)])
    assert rows_of(got) == want and len({c for *_, c in want}) < len(want) - 20
    assert simhash.near_components(df.limit(0)).count() == 0


def test_the_query_on_the_smallest_tables(spark):
    from tessera.llm import queries

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(queries.queries()["op12_simhash_bk_trees"](spark, data)) == brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in docs])
