import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from tessera.llm import mpegaudio as m
from tessera.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_streams_round_trip():
    rnd = random.Random(1)
    for text in [None, "", "a", "é" * 31, "x" * 64, "y" * 5000, "".join(chr(rnd.randrange(1, 0x2FF)) for _ in range(20_000))]:
        payload, n = m.padded_payload(text)
        assert len(payload) % 64 == 0 and payload and payload[:n] == (text or "").encode()
        s = m.read_stream(m.write_stream(payload))
        assert s["payload"] == payload and not s["crc_bad"] and not s["resyncs"] and not s["skipped"]
        assert s["vbr"]["frames"] == s["frames"] == len(s["offsets"]) and s["vbr"]["tag_crc"]
        assert s["duration_num"] * 32000 == s["samples"] * s["duration_den"]


def test_payload_like_a_trailing_tag_comes_back():
    most = m.read_stream(m.write_stream(bytes(5000)))["offsets"]
    most = most[1] - most[0] - 23  # the payload bytes of the largest frame
    for mark in ("TAG", "APETAGEX", "APETAGEX\xd0\x07" + "~" * 20 + "TAG"):
        for n in (92, 157, 300, most - 128, most - 1, most, most + 1, 2 * most, 2 * most + 60):
            for back in {*range(20, 40), *range(118, 138), 160} & set(range(n + 1)):
                payload = ("a" * (n - back) + mark).encode("latin-1").ljust(n, b"b")[:n]
                s = m.read_stream(m.write_stream(payload))
                assert s["payload"] == payload and s["frames"] == s["vbr"]["frames"] and not s["skipped"] and not s["resyncs"] and set(s["tags"]) == {"PAYLOAD_BYTES"}
    payload, n = m.padded_payload("a" * 29 + "TAG" + "b" * 60)
    assert m.read_stream(m.write_stream(payload))["payload"] == payload and n == 92


def test_damage_is_seen_and_skipped():
    media = m.write_stream(m.padded_payload("text " * 2000)[0])
    whole = m.read_stream(media)
    cut = whole["offsets"][3]
    lost = m.read_stream(media[:cut] + b"\xff\xfbjunk" * 5 + media[cut:])
    assert lost["resyncs"] == 1 and lost["skipped"] == 30 and lost["frames"] == whole["frames"] and lost["payload"] == whole["payload"]
    bad = bytearray(media)
    bad[cut + 8] ^= 1  # in the side information, which the checksum covers
    assert m.read_stream(bytes(bad))["crc_bad"] == 1
    none = m.read_stream(b"not audio at all \xff\xff")
    assert none["frames"] == 0 and none["duration_num"] == 0 and none["duration_den"] == 1 and m.read_stream(None)["frames"] == 0


def test_foreign_layers_and_tags():
    # layer II, 48 kHz, 192 kbit/s, stereo, no checksum; layer I, 32 kbit/s, 44.1 kHz mono; MPEG-2 layer III
    for head, length, samples, hz in ((b"\xff\xfd\xa4\x00", 576, 1152, 48000), (b"\xff\xff\x10\xc0", 32, 384, 44100), (b"\xff\xf3\x80\xc0", 208, 576, 22050)):
        frame = head + bytes(length - 4)
        s = m.read_stream(frame * 5 + b"TAG" + b"Song".ljust(30, b"\0") + bytes(95))
        assert (s["frames"], s["samples"], s["sample_rate"], s["tags"]) == (5, 5 * samples, hz, {"TIT2": "Song"}) and s["offsets"] == [length * i for i in range(5)]
    vbri = b"\xff\xfb\x90\xc0" + bytes(32) + b"VBRI" + bytes(6) + (417 * 3).to_bytes(4, "big") + (2).to_bytes(4, "big") + bytes([0, 3, 0, 10, 0, 2, 0, 1, 0, 42, 0, 41, 0, 42])
    s = m.read_stream(vbri.ljust(417, b"\0") + (b"\xff\xfb\x90\xc0" + bytes(413)) * 2)
    assert s["vbr"]["kind"] == "VBRI" and s["vbr"]["frames"] == s["frames"] == 2 and s["vbr"]["seek"] == [0, 420, 830]
    # catalogue values of the two checksums: MSB first from 0 (BUYPASS), and reflected (ARC)
    assert m.crc16(b"123456789", 0, 0) == 0xFEE8 and m.tag_crc16(b"123456789") == 0xBB3D


def bitwise(bits, polynomial=0x8005, crc=0xFFFF):
    """CRC-16 a bit at a time, apart from the tables of the reader."""
    for bit in bits:
        crc = (crc << 1 ^ (polynomial if (crc >> 15) ^ bit else 0)) & 0xFFFF
    return crc


def frame_of(head, bits, length):
    """A protected frame with these bits after its checksum, and the number of them that the checksum covers."""
    covered, every = bits
    crc = bitwise([x >> (7 - i) & 1 for x in head[2:] for i in range(8)] + every[:covered])
    body = int("".join(map(str, every)), 2).to_bytes(len(every) // 8, "big")
    return (head + crc.to_bytes(2, "big") + body).ljust(length, b"\0")


def test_checksums_of_layers_one_and_two():
    rnd = random.Random(6)
    noise = lambda n: [rnd.randint(0, 1) for _ in range(n)]
    # layer I, 32 kbit/s, 44.1 kHz: 32 allocations of 4 bits each channel; joint stereo from subband 8 on
    cases = [(b"\xff\xfe\x10\xc0", 32, lambda: (128, noise(128))), (b"\xff\xfe\x60\x00", 208, lambda: (256, noise(256))), (b"\xff\xfe\x60\x50", 208, lambda: (4 * (2 * 8 + 24), noise(256)))]

    # layer II, 48 kHz, 192 kbit/s, stereo: 4 bits for 11 subbands, 3 for 12, 2 for 4; two bits more for each one in use
    def second():
        bits, used = [], 0
        for width in [4] * 11 + [3] * 12 + [2] * 4:
            for _ in range(2):
                own = noise(width)
                used += any(own)
                bits += own
        return len(bits) + 2 * used, bits + noise(2 * used + (-len(bits) - 2 * used) % 8)

    cases.append((b"\xff\xfc\xa4\x00", 576, second))

    # MPEG-2 layer II, 24 kHz, 64 kbit/s, mono
    def lower():
        bits, used = [], 0
        for width in [4] * 4 + [3] * 7 + [2] * 19:
            own = noise(width)
            used += any(own)
            bits += own
        return len(bits) + 2 * used, bits + noise(2 * used + (-len(bits) - 2 * used) % 8)

    cases.append((b"\xff\xf4\x84\xc0", 384, lower))
    for head, length, bits in cases:
        assert m.header(head)["length"] == length and m.header(head)["protected"]
        frames = [frame_of(head, bits(), length) for _ in range(6)]
        s = m.read_stream(b"".join(frames))
        assert (s["frames"], s["crc_checked"], s["crc_bad"]) == (6, 6, 0)
        hurt = bytearray(b"".join(frames))
        hurt[length + 8] ^= 0x40
        assert m.read_stream(bytes(hurt))["crc_bad"] == 1


def test_tags_and_tables_made_by_hand():
    sound = (b"\xff\xfb\x90\xc0" + bytes(413)) * 4
    item = lambda key, value, kind=0: len(value).to_bytes(4, "little") + (kind << 1).to_bytes(4, "little") + key + b"\0" + value
    items = item(b"Title", "Lied é".encode()) + item(b"Cover", b"\xff\xfb", 1) + item(b"Artist", b"One\0Two")
    part = lambda flags: b"APETAGEX" + (2000).to_bytes(4, "little") + (len(items) + 32).to_bytes(4, "little") + (3).to_bytes(4, "little") + flags.to_bytes(4, "little") + bytes(8)
    for tag in (items + part(0), part(0xA0000000) + items + part(0x80000000)):
        for behind in (b"", b"TAG" + b"Old".ljust(30, b"\0") + bytes(95)):
            s = m.read_stream(sound + tag + behind)
            assert s["frames"] == 4 and not s["skipped"] and s["tags"] == {"Title": "Lied é", "Artist": "One"} | ({"TIT2": "Old"} if behind else {})
    size = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    text = b"\0" + "ÿ\0".encode("latin-1")[:1] + b"\xe0x"  # 0xFF 0xE0 would look like a header
    loose = text.replace(b"\xff", b"\xff\0")
    for major, frame in ((3, b"TIT2" + len(text).to_bytes(4, "big") + b"\0\0" + loose), (4, b"TIT2" + size(len(loose) + 4) + b"\0\3" + size(len(text)) + loose)):
        s = m.read_stream(b"ID3" + bytes([major, 0, 0x80]) + size(len(frame)) + frame + sound)
        assert s["tags"] == {"TIT2": "ÿàx"} and s["frames"] == 4
    squeezed = zlib.compress(b"\3long long title")
    s = m.read_stream(b"ID3\4\0\0" + size(len(squeezed) + 14) + b"TALB" + size(len(squeezed) + 4) + b"\0\x09" + size(16) + squeezed + sound)
    assert s["tags"] == {"TALB": "long long title"}
    # an Info frame with a LAME tag, its checksum by the reflected polynomial bit by bit
    info = b"\xff\xfb\x90\xc0" + bytes(17) + b"Info" + (15).to_bytes(4, "big") + (4).to_bytes(4, "big") + (417 * 5).to_bytes(4, "big") + bytes(range(0, 200, 2)) + bytes(4)
    lame = (b"LAME3.100".ljust(21, b"\0") + bytes([0x24, 0x01, 0x80])).ljust(34, b"\0")
    crc = 0
    for x in info + lame:
        for i in range(8):
            crc = crc >> 1 ^ (0xA001 if (crc ^ x >> i) & 1 else 0)
    s = m.read_stream((info + lame + crc.to_bytes(2, "big")).ljust(417, b"\0") + sound)
    assert s["vbr"]["tag_crc"] and (s["vbr"]["delay"], s["vbr"]["padding"]) == (576, 384) and s["vbr"]["seek"][:3] == [0, 2 * 2085 // 256, 4 * 2085 // 256] and len(s["vbr"]["seek"]) == 100
    assert (s["duration_num"], s["duration_den"]) == ((4 * 1152 - 960) // 12, 44100 // 12)
    wrong = (info + lame + (crc ^ 1).to_bytes(2, "big")).ljust(417, b"\0") + sound
    assert m.read_stream(wrong)["vbr"]["tag_crc"] is False


def test_damaged_streams_in_a_column(spark):
    whole = m.write_stream(m.padded_payload("text " * 2000)[0])
    at = m.read_stream(whole)["offsets"]
    rows = [("whole", whole), ("junk", whole[: at[2]] + b"\xff\xfbjunk" * 7 + whole[at[2] :]), ("cut", whole[: at[-1] + 9]), ("gap", whole[: at[1] + 30] + whole[at[2] :]), ("none", None), ("other", b"\xff" * 50)]
    got = {r["name"]: r["audio"] for r in m.describe_media(spark.createDataFrame(rows, "name string, media binary"), "media").collect()}
    n = len(at)
    assert [(got[k]["frames"], got[k]["resyncs"], got[k]["skipped_bytes"]) for k, _ in rows] == [(n, 0, 0), (n, 1, 42), (n - 1, 1, 9), (n - 1, 1, 30), (0, 0, 0), (0, 1, 50)]
    assert got["whole"]["seek_offsets"] == at and got["whole"]["vbr_agrees"] and got["whole"]["tag_crc_good"] and not got["gap"]["vbr_agrees"] and got["none"]["table_offsets"] is None
    assert got["junk"]["seek_offsets"][2:] == [x + 42 for x in at[2:]] and len(got["whole"]["table_offsets"]) == 100


def test_media_column(spark, docs_of):
    df = docs_of(["a", None, "a", "long " * 3000])
    stored = df.select("doc_id", m.media_of_text("text").alias("media"))
    rows = {r["doc_id"]: r["audio"] for r in m.describe_media(stored, "media").collect()}
    assert rows[0]["frames"] == 1 and rows[0] == rows[2] and rows[3]["crc_bad"] == 0 and rows[3]["vbr_agrees"] and rows[1]["tags"] == {"PAYLOAD_BYTES": "64"}
    d = {r["doc_id"]: r["d"] for r in stored.select("doc_id", m.media_digest(stored["media"]).alias("d")).collect()}
    payload = b"a".ljust(64, b"\0")
    assert d[0]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and d[0]["tail_crc32"] == zlib.crc32(payload) and d[0]["media_bytes"] == len(m.write_stream(payload))
    assert m.describe_media(stored.limit(0), "media").count() == 0


def test_ids_are_the_tokenizers():
    slow = packing._encoders(PATH)[0]
    rnd = random.Random(2)
    texts = ["", " a  b", "x\n y z", "it's we'll 12 34,5 !! ??", "a <|endoftext|> b", "tab\t x ", "é" * 50, "a" * 5000, "日本語 text 🙂", *("".join(rnd.choice("ab éñ\n\t.,'12!🙂") for _ in range(200)) for _ in range(50))]
    for t in texts:
        assert packing.token_ids(t, PATH) == np.array(slow.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_patterns_place_every_piece():
    rnd = random.Random(3)
    for n in (1, 7, 64, 1024):
        h = {i: rnd.randint(0, 500) for i in range(1, n + 1)}
        found = packing.patterns(h, n)
        placed = Counter()
        for packs, inside in found:
            assert packs > 0 and sum(inside) <= n and inside == sorted(inside, reverse=True)
            for size in inside:
                placed[size] += packs
        assert placed == +Counter(h)
    assert len(found) <= 2 * 1024 + 1


def test_packing_against_texts(spark, docs_of):
    rnd = random.Random(4)
    texts = [None, "", "short", "short", *(" ".join(rnd.choice(["tion", "there", "x1", "\n", "wé"]) for _ in range(rnd.randint(0, 900))) for _ in range(60))]
    df = docs_of(texts, [None, *range(1, len(texts))])
    rows = packing.pack(df, length=128, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in zip([None, *range(1, len(texts))], texts, strict=True):
        ids = [*np.frombuffer(packing.token_ids(t or "", PATH), "<u4").tolist(), 0]
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        assert [x for r in parts for x in r["ids"]] == ids and all(r["doc_tokens"] == len(ids) and r["length"] == len(r["ids"]) for r in parts)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in parts)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 128
    assert sum(r["length"] for r in rows) / (128 * len(by_seq)) > 0.95
    assert packing.pack(df.limit(0)).count() == 0


def test_patterns_are_what_piece_by_piece_packing_gives():
    """Each piece, longest first, into the open pack with the least in it, or a new one: the same packs, by their fill."""
    rnd = random.Random(5)
    for _ in range(30):
        length = rnd.choice([8, 20, 64])
        pieces = sorted((rnd.randint(1, length) for _ in range(rnd.randint(0, 120))), reverse=True)
        packs: list[list[int]] = []
        for size in pieces:
            open_ = [p for p in packs if sum(p) + size <= length]
            if open_:
                min(open_, key=sum).append(size)
            else:
                packs.append([size])
        found = packing.patterns(Counter(pieces), length)
        assert sum(n for n, _ in found) == len(packs)
        assert Counter(x for n, p in found for x in p * n) == Counter(pieces)
        assert sorted(sum(p) for n, p in found for _ in range(n)) == sorted(map(sum, packs))


def test_equal_pieces_fill_new_packs():
    """Histograms where no open pack has room: a new pack takes as many pieces of the length as fit."""
    for histogram, packs in (({200: 1000}, 200), ({300: 7}, 3), ({511: 11}, 6), ({400: 9, 100: 4}, 5)):
        found = packing.patterns(histogram)
        assert sum(n for n, _ in found) == packs
        assert Counter({s: sum(n * p.count(s) for n, p in found) for s in histogram}) == Counter(histogram)


def test_short_documents_leave_little_padding(spark, docs_of):
    rows = packing.pack(docs_of([" the" * 199] * 1000)).collect()
    assert {r["length"] for r in rows} == {200}
    assert sum(r["length"] for r in rows) / (1024 * len({r["sequence_id"] for r in rows})) > 0.97
