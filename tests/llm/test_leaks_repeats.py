import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from tessera.llm import decontaminate as d
from tessera.llm import suffixdedup
from tessera.workspace import shared_dir


def least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers_is_the_edit_distance():
    rnd = random.Random(1)
    for _ in range(300):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 90)))
        t = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 120)))
        best, end = d.myers(a, t)
        assert best == least_edits(a, t) and least_edits(a, t[:end]) == best


def test_leaks_against_brute_force(spark, docs_of):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    items = [" ".join(word() for _ in range(rnd.randint(3, 30))) for _ in range(12)] + [None, "", "!!"]
    items.append(items[0])
    docs = [None, "", "..."]
    for _ in range(60):
        w = list(rnd.choice(items[:12]))
        for _ in range(rnd.randint(0, 12)):
            k = rnd.randrange(len(w))
            w[k : k + 1] = rnd.choice([[], ["x"], [w[k], "y"]])
        docs.append(" ".join(word() for _ in range(rnd.randint(0, 40))) + " " + "".join(w).upper() + ", " + " ".join(word() for _ in range(20)))
    df = docs_of(docs)
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for i, t in enumerate(docs):
        for k, item in enumerate(items):
            a, n = d.normal(item), d.normal(t)
            if a and n:
                e = least_edits(a, n)
                if e <= d.budget(len(a)):
                    want.add((i, k, e))
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in d.find_leaks(df, table).collect()}
    assert got == want and len({e for _, _, e in got}) > 2
    kept = d.drop_leaks(df, table)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(docs))) - {i for i, _, _ in got} and kept.columns == df.columns
    assert d.find_leaks(df, table.limit(0)).count() == 0 and d.find_leaks(df.limit(0), table).count() == 0 and d.drop_leaks(df, table.limit(0)).count() == len(docs)


def test_blocks_of_items(spark, docs_of, monkeypatch):
    items = ["the first passage of the test", "a second one that is longer", "third and last passage here"]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(d, "BLOCK_CHARS", 10)
    df = docs_of([f"so {x} it goes" for x in items] + ["clean text of no concern"])
    assert {(r["doc_id"], r["item_id"]) for r in d.find_leaks(df, table).collect()} == {(0, 0), (1, 1), (2, 2)}
    assert [r["doc_id"] for r in d.drop_leaks(df, table).collect()] == [3]


def brute(texts):
    docs, n = [(t or "").encode() for t in texts], Counter()
    for x in docs:
        n.update(x[i : i + 200] for i in range(len(x) - 199))
    out = []
    for x in docs:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - 199):
            if n[x[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((len(x), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def mixed_corpus(seed):
    rnd = random.Random(seed)
    some = lambda n: "".join(rnd.choice("abcdefghij é") for _ in range(n))
    passages = [some(rnd.randint(150, 700)) for _ in range(6)]
    texts = ["".join(some(rnd.randint(0, 400)) + (rnd.choice(passages) if rnd.random() < 0.7 else "") for _ in range(rnd.randint(0, 4))) for _ in range(60)]
    texts += texts[:3] + ["ab" * 300, "x" * 199, "x" * 200, "x" * 201, "é" * 150, None, "", passages[0][:199], passages[1] + "q" + passages[1], "hello " * 200]
    hot = some(260)
    return texts + [some(180) + hot + some(180) for _ in range(90)]


@pytest.mark.parametrize(("many", "batches"), [(4096, 2), (20, 3), (256, 5), (256, 9)])
def test_repeats_against_brute_force(docs_of, monkeypatch, many, batches):
    monkeypatch.setattr(suffixdedup, "MANY", many)
    texts = mixed_corpus(many)
    df = docs_of(texts).repartition(2 if many == 20 else 1)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixdedup.remove_repeats(df, batches=batches).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_levels_merge_as_batches_come(docs_of):
    texts = mixed_corpus(3)
    family, sizes = suffixdedup.SuffixFamily(), []
    for b in range(7):
        family.add(docs_of(texts[b::7], list(range(len(texts)))[b::7]))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]
    heads = []
    for row in sorted(family.levels[0][1].collect(), key=lambda r: r["block"]):
        (own,) = suffixdedup._loaded(pd.DataFrame([row.asDict()]), {"heads": "S50"})
        heads += own.tolist()
    assert heads == sorted(set(heads)) and len(heads) > 300  # one order of suffixes over all blocks
    spans, data = {}, {i: (t or "").encode() for i, t in enumerate(texts)}
    keys = {r["key"]: r["doc_id"] for b in family.batches for r in b.selectExpr("doc_id", "xxhash64(doc_id, text) AS key").collect()}
    for r in family.marks().collect():
        spans.setdefault(keys[r["key"]], []).append((r["first"], r["last"]))
    gone = []
    for i, x in data.items():
        mask = np.zeros(len(x), bool)
        for a, b in spans.get(i, ()):
            mask[a:b] = True
        gone.append(int(mask.sum()))
    assert gone == [r[1] for r in brute(texts)]


def test_repeats_of_equal_rows_and_nothing(docs_of):
    df = docs_of(["k" * 250 + "z", "k" * 250 + "z", "solo " + "".join(map(str, range(200)))], [None, None, 3])
    rows = sorted(suffixdedup.remove_repeats(df).collect(), key=lambda r: str(r["doc_id"]))
    assert [r["n_removed"] for r in rows] == [0, 251, 251] and rows[1]["kept"] == b""
    assert suffixdedup.remove_repeats(df.limit(0)).count() == 0


def test_repeats_leave_only_what_the_result_reads(spark, docs_of):
    folder = Path(shared_dir(spark))
    tables, files = {t.name for t in spark.catalog.listTables()}, set(folder.iterdir())
    passage = "".join(chr(97 + k * k % 23) for k in range(300))
    got = suffixdedup.remove_repeats(docs_of([passage + "x", "y" + passage, None, "z" * 150])).drop("kept").collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {0: 300, 1: 300, 2: 0, 3: 0}
    assert {t.name for t in spark.catalog.listTables()} == tables
    assert [p.name.split("-")[0] for p in set(folder.iterdir()) - files] == ["spans"]


def test_periodic_megabyte_makes_few_marks(docs_of):
    text = "tick tock " * 100_000
    rows = [r.asDict() for r in suffixdedup.remove_repeats(docs_of([text, "x" + text[:300], "alone " + "".join(map(str, range(90)))])).collect()]
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"]) for r in sorted(rows, key=lambda r: r["doc_id"])] == [(1_000_000, 1_000_000, 1), (301, 300, 1), (176, 0, 0)]
    family = suffixdedup.SuffixFamily()
    family.add(docs_of([text]))
    assert family.marks().count() < 20


def test_matches_are_read_from_common_prefixes():
    rnd = random.Random(4)
    base = bytes(rnd.choice(b"abcdef") for _ in range(350))
    rows = []
    for _ in range(40):
        before, after = rnd.randint(0, 150), rnd.randint(50, 200)
        body = bytearray(base[150 - before : 150 + after])
        for _ in range(rnd.randint(0, 2)):
            k = rnd.randrange(len(body))
            if not before <= k < before + 50:
                body[k] = rnd.choice(b"xyz")
        rows.append((1, len(rows), 1000, before, bytes(body)))
    rows = pd.DataFrame(rows, columns=["gram", "key", "p", "before", "bytes"])
    hashes, there, shared = suffixdedup._strings(rows)
    n = Counter(hashes[there].tolist())
    want = {(i, 1000 - d) for i in range(len(rows)) for d in range(151) if there[i, d] and n[int(hashes[i, d])] > 1}
    got = {(k, s) for k, first, last in suffixdedup._matches(rows).tolist() for s in range(first, last - 199)}
    assert want and got == want
    of = {}
    for i, d in zip(*np.nonzero(there), strict=True):  # equal strings meet in one block
        assert of.setdefault((int(hashes[i, d])), shared[i, d // suffixdedup.STEP]) == shared[i, d // suffixdedup.STEP]


def test_runs():
    rnd = random.Random(8)
    rows = np.array([(rnd.choice((-5, 0, 7)), a := rnd.randint(0, 300), a + rnd.randint(0, 30)) for _ in range(80)])
    inside = {(k, x) for k, a, b in rows.tolist() for x in range(a, b)}
    got = suffixdedup._runs(*rows.T).tolist()
    assert {(k, x) for k, a, b in got for x in range(a, b)} == inside and all(k != m or b < c for (k, _, b), (m, c, _) in zip(got, got[1:], strict=False))
    assert len(suffixdedup._runs(*rows[:0].T)) == 0


def test_long_texts_are_cut_without_seams(monkeypatch):
    rnd = random.Random(9)
    text = bytes(rnd.choice(b"abcd") for _ in range(30_000))
    whole = [np.concatenate(c) for c in zip(*suffixdedup.entries([b"short", text]), strict=True)]
    monkeypatch.setattr(suffixdedup, "CHUNK", 1000)
    parts = [np.concatenate(c) for c in zip(*suffixdedup.entries([b"short", text]), strict=True)]
    both = [sorted(set(zip(*(x.tolist() for x in side), strict=True))) for side in (whole, parts)]
    assert both[0] == both[1]
