import zlib
from hashlib import sha256

import numpy as np
import pytest

from tests.llm.data import table, texts
from waywarden.llm import media, webp


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(1)


def picture(rng, h, w, colours):
    base = rng.integers(0, 256, (colours, 4), dtype=np.uint8)
    x = base[rng.integers(0, colours, (h, w))]
    x[h // 2 :] = x[: h - h // 2]
    return x


TRANSFORMS = [(), (webp.SUBTRACT_GREEN,), (webp.PREDICTOR,), (webp.CROSS_COLOR,), (webp.PALETTE,), (2, 0), (0, 1, 2), (1, 0, 2), (3, 0), (3, 2)]


@pytest.mark.parametrize("size", [(1, 1), (1, 7), (9, 1), (13, 17), (32, 20)])
@pytest.mark.parametrize("transforms", TRANSFORMS)
def test_decoder_inverts_the_format(rng, size, transforms):
    for colours in (1, 2, 3, 9, 40, 200):
        x = picture(rng, *size, colours)
        for cache, references, groups in ((0, True, 1), (5, True, 1), (0, False, 3), (3, True, 4)):
            data = webp.encode(x, transforms, modes=list(range(16)), elements=[0x123456, 0xFF80FF7F, 0], cache_bits=cache, references=references, groups=groups)
            assert (webp.decode(data) == x).all()


def test_noise(rng):
    y = rng.integers(0, 256, (64, 64, 4), dtype=np.uint8)
    assert (webp.decode(webp.encode(y, (0, 2))) == y).all() and (webp.decode(webp.encode_plain(y)) == y).all()
    # the plain stream reads the same pixel by pixel
    bits = webp._Bits(webp._chunk(webp.encode_plain(y)))
    bits.at = 40 + 3
    codes = [webp._read_code(bits, n) for n in (280, 256, 256, 256, 40)]
    first = [codes[k].read(bits) for k in range(4)]
    assert first == y[0, 0, [1, 0, 2, 3]].tolist()


def test_bytes_by_hand():
    """One red pixel, written out bit by bit: signature, 1x1, alpha, no transform, five simple codes of one symbol."""
    bits = "".join(f"{v:0{n}b}"[::-1] for v, n in [(0x2F, 8), (0, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)])
    for symbol in (0, 255, 0, 255):  # green, red, blue, alpha
        bits += "1" + "0" + "1" + f"{symbol:08b}"[::-1]
    bits += "1" + "0" + "0" + "0"
    stream = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    assert webp.decode(webp._file(stream)).tolist() == [[[255, 0, 0, 255]]]


@pytest.mark.parametrize("data", [b"", b"RIFF", b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0", webp.encode_plain(np.zeros((4, 4, 4), np.uint8))[:60]])
def test_broken_files_raise(data):
    with pytest.raises(webp.BadImage):
        webp.decode(data)


def test_texts_round_trip(spark):
    rows = [*texts(), "x" * 1_100_000]
    stored = media.store(table(spark, rows, extra=True))
    for r in media.read(stored).join(stored.select("doc_id", "payload_bytes"), "doc_id").collect():
        raw = (rows[r["doc_id"]] or "").encode()
        assert bytes(r["pixels"])[: r["payload_bytes"]] == media.padded(raw) and r["n_bytes"] == len(raw) and not any(bytes(r["pixels"])[len(raw) :])
    d = stored.mapInArrow(media._digest, media.DIGEST).filter("doc_id = 0").head()
    p = media.padded(rows[0].encode())
    assert d["payload_sha256"] == sha256(p).hexdigest() and d["tail_crc32"] == zlib.crc32(p[-64:])
    assert media.store(table(spark, [])).count() == 0
