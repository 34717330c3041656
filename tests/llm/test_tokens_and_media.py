from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm import media, packing, sentencepiece_codec
from fieldloom.llm.queries import tokenizer_path

PIECES, WORDS = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")
TEXTS = st.text(alphabet=st.sampled_from(list("aAbBéÉß œŒİſKµ.,'st !?\n\t́<|endoftxs>12½日Σσ…▁")), max_size=60)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  a  b \n", "y"), (3, "  a  b \n", "y"), (4, "word " * 30_000, "z"), (5, "ﬁ Ⅷ 日本 ▁▁ <|endoftext|>, <|ENDOFTEXT|>", "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_sentencepiece_rows(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sentencepiece_codec.encode_decode(odd, PIECES).collect()
    assert len(got) == 6
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in got:
        want = sp.encode(texts[r.doc_id])
        assert list(r.ids) == want and r.decoded == sp.decode(want)
    d = {r.doc_id: r for r in sentencepiece_codec.digests(odd, PIECES).collect()}
    assert d[1].n_tokens == 0 and d[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert sentencepiece_codec.digests(odd.limit(0), PIECES).count() == 0


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_sentencepiece_exact(text):
    table = _table()
    want = table.model.encode(text)
    assert table.encode(text) == want
    assert " ".join(table.text[w] for w in table.chunks(text)) == table.model.decode(want)


_T = []


def _table():
    if not _T:
        _T.append(sentencepiece_codec.ChunkTable(PIECES, limit=50))
    return _T[0]


_W = []


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_word_ids_exact(text):
    if not _W:
        _W.append(packing.WordIds(WORDS, limit=50))
    want = _W[0].tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(_W[0].encode([text])[0], "<u4").tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9000), min_size=1, max_size=60))
def test_pack_block(lengths):
    pieces = packing.pack_block(lengths, 2048, 1 / 2048)
    used, seen = {}, {}
    for d, start, n, seq, offset in pieces:
        seen.setdefault(d, []).append((start, n))
        used.setdefault(seq, []).append((offset, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[d]):
            assert start == at and k > 0
            at += k
        assert at == n
    for own in used.values():
        at = 0
        for offset, k in sorted(own):
            assert offset == at
            at += k
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)  # full, or a power of two: no padding


def test_pack_rows(spark, odd):
    got = packing.pack(odd, WORDS, block_tokens=5_000).toPandas()
    assert set(got.doc_id) == {1, 2, 3, 4, 5}
    assert (got[got.doc_id == 1].length == 1).all()
    assert got[got.doc_id == 4].length.sum() == 30_001
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.pack(odd.limit(0), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_avi_round_trip(raw):
    n = max(1, -(-len(raw) // 576))
    samples = np.frombuffer(raw + b"\xff" * (n * 576 - len(raw)), np.uint8).reshape(n, 576)
    data = media.write_avi(media.encode_frames(samples))
    frames, fps = media.parse_avi(data)
    assert fps == 25 and len(frames) == n
    assert media.decode_frames(frames).tobytes() == samples.tobytes()
    # the general decoder: flat blocks of 8 x 8
    whole = media.decode_image(frames[0])
    assert np.array_equal(whole[::8, ::8].ravel(), samples[0]) and np.array_equal(whole, whole[::8, ::8].repeat(8, 0).repeat(8, 1))


def test_shots():
    dark, light = np.full((6, 576), 10, np.uint8), np.full((5, 576), 200, np.uint8)
    assert media.shots(np.concatenate([dark, light])) == [(0, 6), (6, 11)]
    assert media.shots(dark[:1]) == [(0, 1)]


def test_media_rows(spark, odd):
    rows = media.media_rows(odd)
    clips = media.clip_rows(rows).toPandas()
    assert set(clips.doc_id) == {1, 2, 3, 4, 5} and (clips.end_s > clips.start_s).all()
    got = {r.doc_id: r for r in media.round_trip(odd).collect()}
    assert got[1].payload_bytes == 576 and got[1].tail_crc32 == zlib.crc32(b"\xff" * 32) and got[1].n_bytes == 0
    assert got[1].media_sha256 == got[2].media_sha256
    with pytest.raises(ValueError):
        media.parse_avi(b"nothing of the kind")


def plain_jpeg(r, height, width, factors, every):
    """A baseline image of random coefficients, written bit by bit, and its planes by the cosine sum itself."""
    dc, ac = {k: 4 for k in range(12)}, {x: 8 for x in (0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11)))}
    codes = [media._canonical(t) for t in (dc, ac)]
    quant = [[r.randint(1, 9) for _ in range(64)] for _ in factors]
    across, down = max(h for h, _ in factors), max(v for _, v in factors)
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    planes = [np.zeros((rows * v * 8, columns * h * 8)) for h, v in factors]
    # zigzag, walked
    walk, y, x = [], 0, 0
    for _ in range(64):
        walk.append((y, x))
        if (y + x) % 2 == 0:
            y, x = (y + 1, x) if x == 7 else (y, x + 1) if y == 0 else (y - 1, x + 1)
        else:
            y, x = (y, x + 1) if y == 7 else (y + 1, x) if x == 0 else (y + 1, x - 1)

    def number(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    scan, bits, before = b"", "", [0] * len(factors)
    for mcu in range(rows * columns):
        if every and mcu and mcu % every == 0:
            bits += "1" * (-len(bits) % 8)
            scan += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") + bytes([0xFF, 0xD0 + (mcu // every - 1) % 8])
            bits, before = "", [0] * len(factors)
        for i, (h, v) in enumerate(factors):
            for k in range(h * v):
                c = [r.randint(-40, 40)] + [r.choice([0] * 12 + [r.randint(-6, 6)]) for _ in range(63)]
                if r.random() < 0.2:
                    c[1:40] = [0] * 39  # runs of over 16 zeros
                n, tail = number(c[0] - before[i])
                before[i] = c[0]
                bits += format(codes[0][n][0], "04b") + tail
                run = 0
                last = max((j for j in range(1, 64) if c[j]), default=0)
                for j in range(1, last + 1):
                    if c[j] == 0:
                        run += 1
                        continue
                    while run > 15:
                        bits, run = bits + format(codes[1][0xF0][0], "08b"), run - 16
                    n, tail = number(c[j])
                    bits += format(codes[1][run << 4 | n][0], "08b") + tail
                    run = 0
                if last < 63:
                    bits += format(codes[1][0][0], "08b")
                f = np.zeros((8, 8))
                for (yy, xx), value, q in zip(walk, c, quant[i]):
                    f[yy, xx] = value * q
                n8 = np.arange(8)
                own = np.zeros((8, 8))
                for u in range(8):
                    for w in range(8):
                        own += (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if w == 0 else 1) / 4 * f[u, w] * np.outer(np.cos((2 * n8 + 1) * u * np.pi / 16), np.cos((2 * n8 + 1) * w * np.pi / 16))
                top, left = (mcu // columns * v + k // h) * 8, (mcu % columns * h + k % h) * 8
                planes[i][top : top + 8, left : left + 8] = np.clip(np.rint(own + 128), 0, 255)
    bits += "1" * (-len(bits) % 8)
    scan += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    part = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    n = len(factors)
    image = b"\xff\xd8" + part(0xFE, b"a comment") + b"".join(part(0xDB, bytes([i]) + bytes(q)) for i, q in enumerate(quant))
    image += part(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, h << 4 | v, i]) for i, (h, v) in enumerate(factors)))
    image += media._dht(0x00, dc) + media._dht(0x10, ac) + (part(0xDD, struct.pack(">H", every)) if every else b"")
    image += part(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\x00\x3f\x00") + scan + b"\xff\xd9"
    return image, [p.repeat(down // v, 0).repeat(across // h, 1)[:height, :width] for p, (h, v) in zip(planes, factors)]


@pytest.mark.parametrize(("factors", "every"), [([(1, 1)], 0), ([(2, 2), (1, 1), (1, 1)], 2), ([(2, 1), (1, 1), (1, 1)], 1), ([(1, 1)] * 3, 0)])
def test_baseline_images(factors, every):
    r = random.Random(len(factors) * 10 + every)
    image, planes = plain_jpeg(r, 37, 45, factors, every)
    got = media.decode_image(image)
    if len(factors) == 1:
        assert np.abs(got.astype(int) - planes[0]).max() <= 1
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2), 0, 255)
        assert got.shape == (37, 45, 3) and np.abs(got - want).max() <= 2.5


def test_foreign_files(spark):
    """Colour frames with AC coefficients; absolute offsets, no index, and what can't be read."""
    r = random.Random(2)
    images = [plain_jpeg(r, 16, 24, [(2, 2), (1, 1), (1, 1)], 1)[0] for _ in range(3)]
    data = media.write_avi(images)
    movi = data.index(b"movi")
    at = data.index(b"idx1")
    absolute = bytearray(data)
    for k in range(3):
        place = at + 8 + 16 * k + 8
        struct.pack_into("<I", absolute, place, struct.unpack_from("<I", data, place)[0] + movi)
    assert media.parse_avi(data)[0] == media.parse_avi(bytes(absolute))[0] == media.parse_avi(data[:at])[0] == images
    clips = media.clip_rows(spark.createDataFrame([(1, data), (2, None)], "doc_id long, media binary")).collect()
    assert clips[0].doc_id == 1 and clips[-1].first_frame + clips[-1].n_frames == 3
    with pytest.raises(ValueError):
        media.decode_image(images[0].replace(b"\xff\xc0", b"\xff\xc2"))
