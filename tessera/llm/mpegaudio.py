"""MPEG audio columns: read streams of layers I to III, and write payloads as layer III streams.

Reading finds frame headers (and finds them again after damage), reads ID3v2, ID3v1 and APEv2 tags and
the Xing/Info/LAME and VBRI tables with their seek points, checks the CRC-16 of protected frames and of
the LAME tag, and gives the exact duration as a fraction of samples and every frame's byte offset for
seeking. Free-format streams (bitrate index 0) are not frames here.

Writing puts payload bytes into the ancillary part of silent, protected, variable-bitrate layer III
frames behind an ID3v2 tag and an Info frame, so that any decoder plays the stream and the payload
reads back byte for byte. Both run row by row in Arrow batches; no row meets another one. A stream is
one cell and has to fit into a task; reading holds it and its frames' offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from math import gcd

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: kbit/s by version group and layer, Hz by version, samples a frame.
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
#: Layer II: runs of (subbands, bits of allocation) of the standard's tables.
ALLOCATION = {"a": [(11, 4), (12, 3), (4, 2)], "b": [(11, 4), (12, 3), (7, 2)], "c": [(2, 4), (6, 3)], "d": [(2, 4), (10, 3)], "lsf": [(4, 4), (7, 3), (19, 2)]}

#: Written streams: MPEG-1 layer III, 32 kHz, mono, protected.
_WRITE_RATE, _SIDE = 32000, 17
_PAYLOAD_TAG = "PAYLOAD_BYTES"
#: Zeros written behind a payload, as many as an ID3v1 tag is long: none of its own bytes lie where readers look for a trailing tag.
_TAIL = bytes(128)


def _table(polynomial: int) -> list[int]:
    rows = []
    for top in range(256):
        crc = top << 8
        for _ in range(8):
            crc = (crc << 1) ^ (polynomial if crc & 0x8000 else 0)
        rows.append(crc & 0xFFFF)
    return rows


_CRC = _table(0x8005)


@lru_cache(maxsize=4096)
def crc16(data: bytes, bits: int = 0, start: int = 0xFFFF) -> int:
    """CRC-16 of whole bytes and then of the first bits of the last one."""
    crc = start
    for b in data[:-1] if bits else data:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ b]
    for i in range(bits):
        bit = (data[-1] >> (7 - i)) & 1
        crc = ((crc << 1) & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ bit else 0)
    return crc


@lru_cache(maxsize=4096)
def header(head: bytes) -> dict | None:
    """The fields of a 4-byte frame header, None if it isn't one."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = (head[1] >> 3) & 3, 4 - ((head[1] >> 1) & 3)
    index, rate = head[2] >> 4, (head[2] >> 2) & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3 or head[3] & 3 == 2:
        return None
    group = 1 if version == 3 else 2
    kbit, hz, padded, mode = BITRATES[group, layer][index], RATES[version][rate], (head[2] >> 1) & 1, head[3] >> 6
    samples = SAMPLES[group, layer]
    length = (12 * kbit * 1000 // hz + padded) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hz + padded
    side = ((17 if mode == 3 else 32) if group == 1 else (9 if mode == 3 else 17)) if layer == 3 else 0
    return {
        "version": {3: "1", 2: "2", 0: "2.5"}[version], "layer": layer, "protected": not head[1] & 1, "kbit": kbit, "hz": hz, "channels": 1 if mode == 3 else 2,
        "joint": (head[3] >> 4) & 3 if mode == 1 else None, "samples": samples, "length": length, "side": side, "alike": (version, layer, hz), "group": group,
    }


def _covered(frame: bytes, h: dict) -> tuple[bytes, int] | None:
    """What the frame's CRC covers after the header: bytes, and how many bits of the last one (0: all)."""
    body = frame[6:]
    if h["layer"] == 3:
        return body[: h["side"]], 0
    if h["layer"] == 1:
        bound = 32 if h["joint"] is None else 4 * (h["joint"] + 1)
        bits = 4 * (bound * h["channels"] + 32 - bound)
    else:
        each = h["kbit"] // h["channels"]
        if h["group"] == 2:
            kind = "lsf"
        elif each <= 48:
            kind = "d" if h["hz"] == 32000 else "c"
        else:
            kind = "a" if each <= 80 or h["hz"] == 48000 else "b"
        widths = [w for n, w in ALLOCATION[kind] for _ in range(n)]
        bound = len(widths) if h["joint"] is None else min(len(widths), 4 * (h["joint"] + 1))
        at, chosen = 0, 0
        whole = int.from_bytes(body[:40], "big")
        for band, w in enumerate(widths):
            for _ in range(h["channels"] if band < bound else 1):
                value = (whole >> (320 - at - w)) & ((1 << w) - 1)
                chosen += (value > 0) * (1 if band < bound else h["channels"])
                at += w
        bits = at + 2 * chosen
    size = (bits + 7) // 8
    return (body[:size], bits % 8) if len(body) >= size else None


def _reflected_table(polynomial: int) -> list[int]:
    rows = []
    for crc in range(256):
        for _ in range(8):
            crc = (crc >> 1) ^ (polynomial if crc & 1 else 0)
        rows.append(crc)
    return rows


_TAG_CRC = _reflected_table(0xA001)


def tag_crc16(data: bytes) -> int:
    """The CRC-16 of LAME tags: the frames' polynomial, but bits in reverse and from 0 on."""
    crc = 0
    for b in data:
        crc = (crc >> 8) ^ _TAG_CRC[(crc ^ b) & 0xFF]
    return crc


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, at: int, tags: dict) -> int:
    """Reads a tag at `at` into tags; its end. Unsynchronised tags and frames are undone, compressed frames inflated, encrypted ones passed over."""
    major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
    end = at + 10 + size + (10 if flags & 0x10 else 0)
    body, p = data[at + 10 : at + 10 + size], 0
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and len(body) >= 4:
        p = int.from_bytes(body[:4], "big") + 4 if major == 3 else _syncsafe(body[:4])
    wide, head = (3, 6) if major == 2 else (4, 10)
    while p + head <= len(body) and body[p] != 0:
        name = body[p : p + wide].decode("latin-1")
        n = int.from_bytes(body[p + 3 : p + 6], "big") if major == 2 else _syncsafe(body[p + 4 : p + 8]) if major == 4 else int.from_bytes(body[p + 4 : p + 8], "big")
        own = 0 if major == 2 else body[p + 9]
        p += head
        if name[0] == "T" and 0 < n <= len(body) - p and not own & (4 if major == 4 else 0x40):
            _text_frame(name, body[p : p + n], major, own, bool(flags & 0x80), tags)
        p += n
    return end


def _text_frame(name: str, value: bytes, major: int, own: int, unsynchronised: bool, tags: dict) -> None:
    """Reads one text frame's body into tags, what its flags changed undone first."""
    squeezed = own & (8 if major == 4 else 0x80 if major == 3 else 0)
    value = value[bool(own & (0x40 if major == 4 else 0x20)) :]  # the group's byte
    if major == 4:
        value = value[4 * bool(own & 1) :]  # the length without the changes
        if own & 2 or unsynchronised:
            value = value.replace(b"\xff\0", b"\xff")
    elif squeezed:
        value = value[4:]
    if squeezed:
        try:
            value = zlib.decompress(value)
        except zlib.error:
            return
    if not value:
        return
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1")
    parts = value[1:].decode(code, "replace").split("\0")
    if name in ("TXXX", "TXX") and len(parts) > 1:
        tags[parts[0]] = parts[1]
    else:
        tags[name] = parts[0]


def _ape(data: bytes, at: int, end: int, tags: dict) -> int:
    """Reads the APEv2 tag whose footer ends at `end` into tags that earlier ones left free; the tag's start."""
    size, count, flags = struct.unpack("<III", data[end - 20 : end - 8])
    start = max(at, end - size - (32 if flags >> 31 else 0))
    p, stop = max(at, end - size), end - 32
    for _ in range(count):
        cut = data.find(b"\0", p + 8, stop)
        if cut < 0:
            break
        n, kind = struct.unpack("<II", data[p : p + 8])
        if cut + 1 + n <= stop and not kind >> 1 & 3:  # a text, not binary or a link
            tags.setdefault(data[p + 8 : cut].decode("latin-1"), data[cut + 1 : cut + 1 + n].decode("utf-8", "replace").split("\0")[0])
        p = cut + 1 + n
    return start


def _vbr(frame: bytes, h: dict) -> dict | None:
    """The Xing, Info or VBRI table in a first frame; seek: byte offsets of equal parts of the playing time, counted from this frame."""
    for at in {4 + h["side"], 6 + h["side"]} if h["layer"] == 3 else ():
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            out = {"kind": frame[at : at + 4].decode(), "frames": None, "bytes": None, "delay": 0, "padding": 0, "tag_crc": None, "seek": []}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], p = int.from_bytes(frame[p : p + 4], "big"), p + 4
            if flags & 4:
                out["seek"] = [x * out["bytes"] // 256 for x in frame[p : p + 100]] if out["bytes"] is not None else []
                p += 100
            p += 4 * bool(flags & 8)
            lame = frame[p : p + 36]
            if len(lame) == 36 and lame[:9].strip(b"\0"):
                out["delay"], out["padding"] = lame[21] << 4 | lame[22] >> 4, (lame[22] & 15) << 8 | lame[23]
                out["tag_crc"] = tag_crc16(frame[: p + 34]) == int.from_bytes(lame[34:], "big")
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        entries, scale, wide = struct.unpack(">HHH", frame[54:60])
        seek, to = [], 0
        for p in range(62, min(len(frame) - wide + 1, 62 + entries * wide), max(1, wide)) if wide in (1, 2, 3, 4) else ():
            seek.append(to)
            to += int.from_bytes(frame[p : p + wide], "big") * scale
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big"), "delay": 0, "padding": 0, "tag_crc": None, "seek": seek}
    return None


def read_stream(data: bytes | None) -> dict:
    """Everything about one stream; a null or foreign one has no frames and a duration of 0/1."""
    data = data or b""
    tags: dict[str, str] = {}
    at, end = 0, len(data)
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        at = _id3v2(data, at, tags)
    if data[max(at, end - 128) :][:3] == b"TAG" and end - at >= 128:
        end -= 128
        for name, x, y in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            if text := data[end + x : end + y].split(b"\0")[0].decode("latin-1").rstrip():
                tags.setdefault(name, text)
    if data[end - 32 : end - 24] == b"APETAGEX" and end - at >= 32:
        end = _ape(data, at, end, tags)
    out = {"version": None, "layer": None, "sample_rate": None, "channels": None, "frames": 0, "samples": 0, "kbits": 0, "crc_checked": 0, "crc_bad": 0, "resyncs": 0, "skipped": 0, "vbr": None}
    offsets, bodies, alike, lost, usual_form = [], [], None, False, None
    first = True
    while at + 4 <= end:
        h = header(data[at : at + 4])
        good = h and at + h["length"] <= end and (alike is None or h["alike"] == alike)
        if good:  # the frame after it vouches for a header; in sync, so does being just like the frames before
            after = at + h["length"]
            then = header(data[after : after + 4])
            usual = not first and not lost and usual_form == (h["protected"], h["channels"])
            good = usual or end - after < 4 or bool(then and then["alike"] == h["alike"])
        if not good:
            out["resyncs"] += not lost
            lost = True
            to = data.find(b"\xff", at + 1, end)
            to = end if to < 0 else to
            out["skipped"] += to - at
            at = to
            continue
        frame = data[at : at + h["length"]]
        lost, alike = False, h["alike"]
        if h["protected"]:
            covered = _covered(frame, h)
            out["crc_checked"] += 1
            out["crc_bad"] += covered is None or crc16(covered[0], covered[1], crc16(frame[2:4])) != int.from_bytes(frame[4:6], "big")
        table = _vbr(frame, h) if first else None
        first = False
        if table:
            out["vbr"] = table
        else:
            usual_form = (h["protected"], h["channels"])
            offsets.append(at)
            bodies.append(frame[4 + 2 * h["protected"] + h["side"] :])
            out["frames"] += 1
            out["samples"] += h["samples"]
            out["kbits"] += h["kbit"]
        if out["version"] is None:
            out |= {"version": h["version"], "layer": h["layer"], "sample_rate": h["hz"], "channels": h["channels"]}
        at += h["length"]
    out["skipped"] += max(0, end - at)
    played = max(0, out["samples"] - (out["vbr"]["delay"] + out["vbr"]["padding"] if out["vbr"] else 0))
    g = gcd(played, out["sample_rate"] or 1) or 1
    out |= {"duration_num": played // g, "duration_den": (out["sample_rate"] or 1) // g, "tags": tags, "offsets": offsets, "payload": b"".join(bodies)}
    if (n := tags.get(_PAYLOAD_TAG, "")).isdigit():
        out["payload"] = out["payload"][: int(n)]
    return out


@lru_cache(maxsize=64)
def _frame_start(index: int) -> bytes:
    head = bytes([0xFF, 0xFA, index << 4 | 2 << 2, 0xC0])
    return head + crc16(bytes(_SIDE), 0, crc16(head[2:])).to_bytes(2, "big") + bytes(_SIDE)


def write_stream(payload: bytes) -> bytes:
    """The payload as a silent layer III stream."""
    rooms = [(144 * k * 1000 // _WRITE_RATE - 6 - _SIDE, i) for i, k in enumerate(BITRATES[1, 3]) if k]
    most = rooms[-1]
    frames = []
    body = payload + _TAIL
    for at in range(0, len(body), most[0]):
        piece = body[at : at + most[0]]
        room, index = next(r for r in rooms if r[0] >= len(piece))
        frames.append(_frame_start(index) + piece.ljust(room, b"\0"))
    text = b"\0" + _PAYLOAD_TAG.encode() + b"\0" + str(len(payload)).encode()
    frame = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    n = len(frame)
    tag = b"ID3\3\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + frame
    size = sum(map(len, frames))
    marks, ends = [0] * 100, 0
    ends_at = []
    for f in frames:
        ends_at.append(ends)
        ends += len(f)
    for i in range(100):
        marks[i] = min(255, ends_at[min(len(frames) - 1, i * len(frames) // 100)] * 256 // max(1, size))
    index = 5  # 64 kbit/s: room for the table
    length = 144 * BITRATES[1, 3][index] * 1000 // _WRITE_RATE
    info = bytes([0xFF, 0xFB, index << 4 | 2 << 2, 0xC0]) + bytes(_SIDE) + b"Info" + (15).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + (size + length).to_bytes(4, "big") + bytes(marks) + bytes(4)
    lame = b"tessera01" + bytes(25)
    info += lame + tag_crc16(info + lame).to_bytes(2, "big")
    return tag + info.ljust(length, b"\0") + b"".join(frames)


def padded_payload(text: str | None, unit: int = 64) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % unit or (0 if raw else unit)), len(raw)


def _write(texts: pd.Series) -> pd.Series:
    return pd.Series([write_stream(padded_payload(t)[0]) for t in texts], dtype=object)


def media_of_text(text: str) -> Column:
    """The stream that stores a text column's padded UTF-8; a null text is an empty one."""
    return F.pandas_udf(_write, "binary")(text)


_DESCRIPTION = (
    "version string, layer int, sample_rate int, channels int, frames long, duration_num long, duration_den long, mean_kbit double, vbr_kind string, vbr_agrees boolean, "
    "tag_crc_good boolean, crc_checked long, crc_bad long, resyncs long, skipped_bytes long, tags map<string,string>, seek_offsets array<long>, table_offsets array<long>"
)
_NAMES = [c.split()[0] for c in _DESCRIPTION.split(", ")]


def _row(s: dict) -> dict:
    vbr = s["vbr"]
    return {
        "version": s["version"], "layer": s["layer"], "sample_rate": s["sample_rate"], "channels": s["channels"], "frames": s["frames"], "duration_num": s["duration_num"], "duration_den": s["duration_den"],
        "mean_kbit": s["kbits"] / s["frames"] if s["frames"] else None, "vbr_kind": vbr and vbr["kind"], "vbr_agrees": None if not vbr or vbr["frames"] is None else vbr["frames"] == s["frames"],
        "tag_crc_good": vbr and vbr["tag_crc"], "crc_checked": s["crc_checked"], "crc_bad": s["crc_bad"], "resyncs": s["resyncs"], "skipped_bytes": s["skipped"], "tags": s["tags"], "seek_offsets": s["offsets"],
        "table_offsets": vbr and vbr["seek"],
    }


def _describe(media: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_row(read_stream(m)) for m in media], columns=_NAMES, dtype=object)


def describe_media(df: DataFrame, media_col: str) -> DataFrame:
    """df with a struct `audio` of what its streams hold; null or foreign bytes have 0 frames. An old `audio` column is replaced.

    seek_offsets are the frames' places in the stream, table_offsets the seek points of its own table,
    null without one.
    """
    return df.withColumn("audio", F.pandas_udf(_describe, _DESCRIPTION)(media_col))


_DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_num long, duration_den long, seek_offsets array<long>"


def _digest(media: pd.Series) -> pd.DataFrame:
    def one(m: bytes) -> tuple:
        s = read_stream(m)
        p, v = s["payload"], s["vbr"]
        feature = (
            f"mpeg{s['version']}/L{s['layer']} {s['sample_rate']}Hz frames={s['frames']} duration={s['duration_num']}/{s['duration_den']} kbits={s['kbits']} vbr={v and v['kind']}:{v and v['frames']} "
            f"tag_crc={v and v['tag_crc']} crc={s['crc_checked'] - s['crc_bad']}/{s['crc_checked']} resyncs={s['resyncs']}")
        return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature, s["duration_num"], s["duration_den"], s["offsets"]

    return pd.DataFrame([one(m if m is not None else b"") for m in media], columns=[c.split()[0] for c in _DIGEST.split(", ")])


def media_digest(media: Column) -> Column:
    """Struct of the payload read back from stored streams, the streams' own size and hash, their features as text, durations and seek offsets. Null is an empty stream."""
    return F.pandas_udf(_digest, _DIGEST)(media)
