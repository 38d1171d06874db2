import numpy as np
import pytest

from tests.llm.data import table, texts
from waywarden.llm import media, webp, webp_batch


def pictures():
    rng = np.random.default_rng(2)
    out = [rng.integers(0, k, (h, w, 4), dtype=np.uint8) for k in (1, 2, 3, 9, 256) for h, w in ((1, 1), (1, 7), (9, 1), (13, 17), (64, 40))]
    rows = rng.integers(0, 256, (6, 16, 4), dtype=np.uint8)
    out += [rows[rng.integers(0, 6, h)] for h in (3, 40, 700)]
    return [*out, np.zeros((700, 16, 4), np.uint8)]


def test_batch_and_single_decoders_agree():
    x = pictures()
    files = webp_batch.encode_all(x)
    for image, data, read in zip(x, files, webp_batch.decode_all(files), strict=True):
        assert (read == image).all() and (webp.decode(data) == image).all()


def test_batch_reads_what_the_general_encoder_writes():
    x = pictures()[-12:]
    files = [webp.encode(i, t, modes=list(range(16)), elements=[0x123456], cache_bits=c, groups=g) for i in x for t, c, g in (((), 0, 1), ((2,), 11, 1), ((2,), 0, 1), ((0, 2), 5, 1), ((), 3, 3))]
    files += [webp.encode_plain(i) for i in x]
    for data, read in zip(files, webp_batch.decode_all(files), strict=True):
        assert (read == webp.decode(data)).all()


def test_broken_streams_raise_among_whole_ones():
    files = webp_batch.encode_all(pictures())
    for i in (4, 20, 26):
        chunk = webp._chunk(files[i])
        with pytest.raises(webp.BadImage):
            webp_batch.decode_all([*files, webp._file(chunk[: len(chunk) * 2 // 3])])


def test_lengths_are_complete_and_bounded():
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    counts = np.zeros((4, 300), np.int64)
    counts[0, :30], counts[1, 7], counts[2, :300] = fib, 5, 1
    n = webp_batch._lengths(counts).astype(float)
    assert n.max() <= webp_batch.LONGEST and n[1, 7] == 1 and not n[3].any()
    assert all((0.5 ** n[i][n[i] > 0]).sum() == 1 for i in (0, 2))


def test_stored_media_take_every_step_of_the_decoder(spark, monkeypatch):
    """Transform, cache hits, references and codes of several lengths all stand in what the query stores."""
    text = "".join(f"line {i % 7} of the page, word {i * i % 997}; " for i in range(400))
    data = bytes(media.store(table(spark, [text, *texts()[:3]])).filter("doc_id = 0").head()["media"])
    seen, lengths = set(), set()
    read = webp._Code.read

    def watched(self, bits):
        symbol = read(self, bits)
        if len(self.lengths) >= 280:
            seen.add("literal" if symbol < 256 else "reference" if symbol < 280 else "hit")
            lengths.update(self.lengths)
        return symbol

    monkeypatch.setattr(webp._Code, "read", watched)
    for name in ("_green_all", "_cross_all", "_predicted", "_unbundle"):
        monkeypatch.setattr(webp, name, lambda *a, f=getattr(webp, name), name=name: (seen.add(name), f(*a))[1])
    image = webp.decode(data)
    assert image.tobytes()[: len(text)] == text.encode() and seen == {"literal", "reference", "hit", "_green_all", "_cross_all", "_predicted"} and len(lengths) > 4
    small = bytes(media.store(table(spark, ["abcdabcd" * 40])).head()["media"])
    assert webp.decode(small).tobytes()[:320] == b"abcdabcd" * 40 and "_unbundle" in seen
    # and the query's own decoder walks both rather than passing them on
    files = [webp._chunk(x) for x in (data, small) for _ in range(webp_batch.FEW)]
    assert all(i is not None for i in webp_batch._decode(files))


def test_the_batch_inverts_transforms_itself():
    """No image that the writer makes is left to the single decoder, but for the last few pixels of the longest."""
    rng = np.random.default_rng(5)
    x = [np.cumsum(rng.integers(0, 3, (h, 16, 4)), axis=axis, dtype=np.uint8) for h in (4, 30) for axis in (0, 1) for _ in range(10)]
    x += [rng.integers(0, k, (8, w, 4), dtype=np.uint8) for k in (1, 2, 4) for w in (5, 16) for _ in range(10)]
    files = webp_batch.encode_all(x)
    read = webp_batch._decode([webp._chunk(f) for f in files])
    assert all(r is not None and (r == i).all() for r, i in zip(read, x, strict=True))
    # prediction pays: smooth images are a fraction of their noise
    assert len(files[0]) < 0.75 * x[0].size + 300
