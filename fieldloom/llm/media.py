"""Media columns: AVI motion-JPEG files of 8-bit samples, their frames, shots and clip rows.

Writing: every 576 samples are one frame of 24 x 24 blocks. A block is flat, so its only coefficient is the
DC one; at a DC quantiser of 8 its quantised value is the sample less 128, exactly (the DC coefficient is the
format's unit). Frames are baseline grey JPEG images (JFIF) with Huffman tables of their own: a difference of
category s gets a code of 10 - s bits, so that code plus value always take 10 bits, and the end of block takes
one. Such streams pack and unpack as arrays.

Reading: :func:`parse_avi` walks the RIFF chunks and takes the frames from the ``idx1`` index (offsets from the ``movi``
list or from the file's start), or from the list itself where there is none. ``functions.jpeg`` reads any baseline
JPEG image: one or three components with their sampling factors, AC coefficients, restart intervals. Progressive and
arithmetic images and frames without Huffman tables of their own raise. Frames of this module's own header have blocks
whose every symbol has the same width; :func:`decode_frames` unpacks them as arrays.

Shots: a frame starts a shot when its grey histogram differs from the one before by more than the mean plus
``SIGMAS`` standard deviations of the differences in the window before it, and by ``LEAST`` at least.

A null text is an empty one; an empty payload is one frame of padding.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from fieldloom.functions import jpeg

from .common import map_texts, text_rows

SIDE, BLOCK, FPS = 24, 576, 25
BINS, WINDOW, SIGMAS, LEAST = 32, 8, 3.0, 0.25
_CODE_BITS = {s: 10 - s for s in range(9)}


def _canonical(bits: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length) by the rule of the JPEG standard: by length, then in the order given."""
    code, length, out = 0, 0, {}
    for symbol, n in sorted(bits.items(), key=lambda x: x[1]):
        code <<= n - length
        length = n
        out[symbol] = (code, n)
        code += 1
    return out


def _dht(kind: int, bits: dict[int, int]) -> bytes:
    ordered = sorted(bits.items(), key=lambda x: x[1])
    counts = bytes(sum(n == k for _, n in ordered) for k in range(1, 17))
    body = bytes([kind]) + counts + bytes(s for s, _ in ordered)
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


def _header() -> bytes:
    side = SIDE * 8
    quant = bytes([8]) + bytes([1]) * 63
    return b"".join([
        b"\xff\xd8", b"\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00",
        b"\xff\xdb\x00\x43\x00" + quant,
        b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, side, side, 1) + b"\x01\x11\x00",
        _dht(0x00, _CODE_BITS), _dht(0x10, {0: 1}),
        b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00",
    ])


def _codewords() -> np.ndarray:
    """The 11 bits of each difference -255..255, with the end of block."""
    codes, out = _canonical(_CODE_BITS), np.zeros(511, np.uint64)
    for diff in range(-255, 256):
        s = abs(diff).bit_length()
        value = diff if diff >= 0 else diff + (1 << s) - 1
        out[diff + 255] = ((codes[s][0] << s | value) << 1)
    return out


HEADER, WORDS = _header(), _codewords()


def encode_frames(payload: np.ndarray) -> list[bytes]:
    """JPEG images of an (n, 576) array of samples."""
    n = len(payload)
    values = payload.astype(np.int16) - 128
    diffs = np.diff(values, axis=1, prepend=np.zeros((n, 1), np.int16))
    words = WORDS[diffs + 255].reshape(n * BLOCK // 8, 8)  # 8 words of 11 bits are 11 bytes
    high = np.zeros(len(words), np.uint64)
    low = np.zeros(len(words), np.uint64)
    for k in range(4):
        high = high << np.uint64(11) | words[:, k]
        low = low << np.uint64(11) | words[:, k + 4]
    out = np.empty((len(words), 11), np.uint8)  # 44 bits and 44 bits
    for k in range(5):
        out[:, k] = (high >> np.uint64(36 - 8 * k)).astype(np.uint8)
    out[:, 5] = ((high & np.uint64(15)) << np.uint64(4) | low >> np.uint64(40)).astype(np.uint8)
    for k in range(5):
        out[:, 6 + k] = (low >> np.uint64(32 - 8 * k)).astype(np.uint8)
    scans = out.reshape(n, BLOCK // 8 * 11)
    return [HEADER + s.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for s in scans]


def _tables(segments: list[bytes]) -> dict[int, dict[int, tuple[int, int]]]:
    """Huffman tables by class and id: symbol -> (code, length)."""
    out = {}
    for body in segments:
        while body:
            kind, counts = body[0], body[1:17]
            symbols, bits, at = body[17 : 17 + sum(counts)], {}, 0
            for length, c in enumerate(counts, 1):
                bits |= {s: length for s in symbols[at : at + c]}
                at += c
            out[kind], body = _canonical(bits), body[17 + sum(counts) :]
    return out


_PARSED: dict[bytes, tuple] = {}


def _parsed(head: bytes, found: dict) -> tuple:
    if head not in _PARSED:
        _PARSED.clear()
        tables = _tables(found[0xC4])
        _, height, width = struct.unpack_from(">BHH", found[0xC0][0])
        dc, ac, q = tables[0], tables[0x10], found[0xDB][0][1]
        widths = {n + s for s, (_, n) in dc.items()}
        even = widths.pop() if len(widths) == 1 and set(ac) == {0} else 0
        _PARSED[head] = (dc, ac, q, height // 8 * (width // 8), even)
    return _PARSED[head]


def _decode_even(scans: list[bytes], dc: dict, eob: int, blocks: int, width: int) -> np.ndarray:
    """Differences of streams in which each block takes ``width + eob`` bits: (frames, blocks)."""
    n = width + eob
    data = np.frombuffer(b"".join(scans), np.uint8).reshape(len(scans), -1)
    at = np.arange(blocks) * n
    wide = np.concatenate([data, np.zeros((len(data), 3), np.uint8)], axis=1).astype(np.uint32)
    byte, shift = at >> 3, (32 - n - (at & 7)).astype(np.uint32)
    word = (wide[:, byte] << 24 | wide[:, byte + 1] << 16 | wide[:, byte + 2] << 8 | wide[:, byte + 3]) >> shift
    word = (word & np.uint32((1 << n) - 1)) >> np.uint32(eob)
    table = np.zeros(1 << width, np.int16)
    for s, (code, _) in dc.items():
        first = code << s
        values = np.arange(1 << s)
        table[first : first + (1 << s)] = np.where(values >= (1 << s) // 2, values, values - (1 << s) + 1) if s else 0
    return table[word]


def decode_image(image: bytes) -> np.ndarray:
    """A baseline JPEG image as (h, w) grey or (h, w, 3) RGB samples; subsampled planes are repeated."""
    return jpeg.decode(image)


def grey_frames(images: list[bytes]) -> list[np.ndarray]:
    """Brightness samples of each frame: of the arrays of :func:`decode_frames` for this module's own frames, of the whole first plane for others."""
    if images and all(i.startswith(HEADER) for i in images):
        return list(decode_frames(images))
    return [jpeg.planes(i)[0].astype(np.uint8).ravel() for i in images]


def decode_frames(images: list[bytes]) -> np.ndarray:
    """Samples (frames, blocks) of this module's own JPEG images; a block is flat, so its DC value stands for all of it."""
    found, scans, first = None, [], images[0].index(b"\xff\xda")
    head = images[0][:first]
    for image in images:
        if found is None or image[:first] != head:
            found, scan = jpeg.segments(image)
            scans.append(scan.replace(b"\xff\x00", b"\xff"))
        else:  # the same tables again
            at = first + 2 + struct.unpack_from(">H", image, first + 2)[0]
            scans.append(image[at : image.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff"))
    dc, ac, q, blocks, even = _parsed(head, found)
    if not even:
        raise ValueError("not a frame of flat blocks of one width")
    diffs = _decode_even(scans, dc, ac[0][1], blocks, even)
    return (np.cumsum(diffs, axis=1, dtype=np.int32) * q // 8 + 128).astype(np.uint8)


def write_avi(images: list[bytes]) -> bytes:
    """A RIFF AVI file of JPEG frames with its index."""
    side, n = SIDE * 8, len(images)
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    largest = max(map(len, images))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, side, side, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", side * side, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    body, index, at = [], [], 4
    for image in images:
        body.append(chunk(b"00dc", image))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        at += len(body[-1])
    movi = chunk(b"LIST", b"movi" + b"".join(body))
    return chunk(b"RIFF", b"AVI " + header + movi + chunk(b"idx1", b"".join(index)))


def parse_avi(data: bytes) -> tuple[list[bytes], float]:
    """Frames of a motion-JPEG AVI file in index order, and frames per second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, movi, index, fps = 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]), (0, 0), b"", float(FPS)
    while at + 8 <= end:
        tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if tag == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            k = data.find(b"vids", at, at + 8 + size)
            if k < 0 or data[k + 4 : k + 8].upper() != b"MJPG":
                raise ValueError("not a motion-JPEG stream")
            scale, rate = struct.unpack_from("<II", data, k + 20)
            fps = rate / scale if scale and rate else fps
        elif tag == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8, at + 8 + size
        elif tag == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    video = lambda tag: tag[2:] in (b"dc", b"db")
    if not index:
        return _listed_frames(data, movi[0] + 4, movi[1], video), fps
    frames = []
    for tag, _, offset, size in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]):
        if video(tag):
            base = movi[0] if data[movi[0] + offset : movi[0] + offset + 4] == tag else 0
            frames.append(data[base + offset + 8 : base + offset + 8 + size])
    return frames, fps


def _listed_frames(data: bytes, at: int, end: int, video) -> list[bytes]:
    """Frames of a ``movi`` list in its own order, ``rec`` lists included."""
    out = []
    while at + 8 <= end:
        tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if tag == b"LIST":
            at += 12
            continue
        if video(tag):
            out.append(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    return out


def shots(frames: np.ndarray | list[np.ndarray]) -> list[tuple[int, int]]:
    """Clips ``[first, last)`` of frames of samples, cut where histograms differ more than lately."""
    n = len(frames)
    if isinstance(frames, np.ndarray):
        bins = frames.astype(np.int64) * BINS // 256 + np.arange(n)[:, None] * BINS
        hist = np.bincount(bins.ravel(), minlength=n * BINS).reshape(n, BINS) / frames.shape[1]
    else:  # frames may differ in size
        hist = np.stack([np.bincount(f.astype(np.int64) * BINS // 256, minlength=BINS) / len(f) for f in frames])
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts, first = [0], 0
    for k, d in enumerate(diff.tolist()):
        lately = diff[max(first, k - WINDOW) : k]
        limit = max(LEAST, lately.mean() + SIGMAS * lately.std()) if len(lately) else LEAST
        if d > limit:
            cuts.append(k + 1)
            first = k + 1
    return list(zip(cuts, [*cuts[1:], n]))


def payload_of(text: str) -> tuple[int, np.ndarray]:
    """Bytes of the text, and its samples padded by 255 to whole frames."""
    raw = text.encode()
    frames = max(1, -(-len(raw) // BLOCK))
    return len(raw), np.frombuffer(raw + b"\xff" * (frames * BLOCK - len(raw)), np.uint8).reshape(frames, BLOCK)


def media_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, media binary)``: the AVI file of every text."""

    def kernel():
        return lambda ids, texts: {"doc_id": ids, "media": [write_avi(encode_frames(payload_of(t)[1])) for t in texts]}

    return map_texts(text_rows(docs, id_col, text_col), kernel, "doc_id long, media binary")


def clip_rows(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Timed clips ``(doc_id, clip, first_frame, n_frames, start_s, end_s)`` of AVI files; null files give none."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is None:
                    continue
                images, fps = parse_avi(data)
                for k, (a, b) in enumerate(shots(grey_frames(images)) if images else []):
                    for column, v in zip(out, (doc_id, k, a, b - a, a / fps, b / fps)):
                        column.append(v)
            kinds = [pa.int64()] * 4 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "clip", "first_frame", "n_frames", "start_s", "end_s"])

    return media.select(id_col, media_col).mapInArrow(run, "doc_id long, clip long, first_frame long, n_frames long, start_s double, end_s double")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write each text as AVI, read it back, and describe both; the files never leave the worker."""

    def kernel():
        def apply(ids, texts):
            out = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_clips")}
            for t in texts:
                n, samples = payload_of(t)
                data = write_avi(encode_frames(samples))
                images, fps = parse_avi(data)
                frames = decode_frames(images)
                back, clips = frames.tobytes(), shots(frames)
                mean = float(frames.mean())
                times = ",".join(f"{a / fps:.2f}-{b / fps:.2f}" for a, b in clips)
                out["n_bytes"].append(n)
                out["payload_bytes"].append(len(back))
                out["payload_sha256"].append(hashlib.sha256(back).hexdigest())
                out["tail_crc32"].append(zlib.crc32(back[-32:]))
                out["media_bytes"].append(len(data))
                out["media_sha256"].append(hashlib.sha256(data).hexdigest())
                out["feature"].append(f"frames={len(frames)};mean={mean:.4f};clips={times}")
                out["n_clips"].append(len(clips))
            return out | {"doc_id": ids}

        return apply

    return map_texts(
        text_rows(docs, id_col, text_col), kernel,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips long",
    )
