import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    return slow, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_of():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}


def brute(texts, tokenizers):
    """Per text its links and groups, by comparing byte ranges of all tokens."""
    slow, pieces = tokenizers
    table, out = byte_of(), []
    for text in texts:
        a, b = (slow.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        bytes_a = [bytes(table[c] for c in slow.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in map(pieces.id_to_piece, b)]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
            out.append(([], [], [], []))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b))
        links = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(([0] + ends_a)[i], ([0] + ends_b)[j]) < min(ends_a[i], ends_b[j])]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        out.append((a, b, [(a[i], b[j]) for i, j in links], groups))
    count = Counter(p for _, _, links, _ in out for p in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    rows = []
    for a, b, links, groups in out:
        joined = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(joined.encode()).hexdigest() if a else ""))
    return rows


def some_texts(seed=1):
    rnd = random.Random(seed)
    words = ["there", "tion", "naïve", "été", "x1", "12345", "日本語", "🙂", "don't", "<|endoftext|>", "</s>", "<0x41>", "a▁b", "aaaaaaa", ".", "\n", "  ", "\t", "Ünïcödé", "q́"]
    made = ["".join(rnd.choice(words) + rnd.choice(["", " "]) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    return [None, "", " ", "a", "a", "  two  spaces ", "new\nline", *made, "plain words here " * 30]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("sent", [alignment.SENT, 0])
def test_against_byte_ranges(spark, docs_of, tokenizers, sent):
    texts = some_texts()
    df = docs_of(texts, [None, *range(1, len(texts))])
    got = alignment.align(df, sent=sent)
    assert got.columns == ["doc_id", *COLUMNS]
    want = brute(texts, tokenizers)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got.collect()} == dict(zip([None, *range(1, len(texts))], want, strict=True))
    assert sum(w[0] > 0 for w in want) > 20 and want[0] == (0,) * 6 + ("",)
    assert alignment.align(df.limit(0), sent=sent).count() == 0


def test_repeated_rows_are_documents_of_their_own(spark, docs_of, tokenizers):
    df = docs_of(["same words here"] * 3, [7, 7, 7])
    want = brute(["same words here"] * 3, tokenizers)
    for sent in (alignment.SENT, 0):
        assert sorted(tuple(r[c] for c in COLUMNS) for r in alignment.align(df, sent=sent).collect()) == sorted(want)


def test_lanes_and_chunks_change_nothing(monkeypatch):
    va, vb = alignment.byte_vocabulary(A), alignment.piece_vocabulary(B)
    texts = [t for t in some_texts(2)] + ["one word after the other " * 400]
    whole = alignment.aligned(texts, va, vb, lane=10**9)
    for lane in (1, 2, 7, 512):
        frame, codes, times = alignment.aligned(texts, va, vb, lane)
        assert frame.equals(whole[0]) and all((x == y).all() for x, y in zip(codes + times, whole[1] + whole[2], strict=True))
    for most in (1, 100, 10**9):
        parts = list(alignment._chunks(texts, most))
        assert [i for s in parts for i in range(s.start, s.stop)] == list(range(len(texts)))


def test_a_step_moves_all_texts():
    """Steps are as many as the longest lane has links, not as all texts have."""
    ends = [np.arange(1, 101), np.array([100])]
    link_a, link_b, cut_a, cut_b = alignment.merged([ends[0]] * 3, [ends[1]] * 3)
    assert link_a[:3].tolist() == [0, 100, 200] and len(link_a) == 300 and cut_a.sum() == cut_b.sum() == 3
    assert sorted(link_b.tolist()) == [0] * 100 + [1] * 100 + [2] * 100


def test_wide_ids_are_kept():
    for top in (9, 70_000):
        code, n = np.array([3 << 32 | 5, top << 32 | 70_000], np.int64), np.array([1, 2])
        back = alignment._unpacked(*alignment._packed(code, n))
        assert (back[0] == code).all() and (back[1] == n).all()
