"""BPE against the tiktoken library; WebP against an encoder of every tool of the format."""

from __future__ import annotations

import hashlib
import random
import sys
import tracemalloc
import zlib

import numpy as np
import pytest

from codeloom.llm import bpe, media, webp

SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def codecs():
    import public_tokenizers as public
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    ranks = bpe.read_ranks(path)
    ours = bpe.Codec(ranks, bpe.serialise_model(ranks), pattern)
    return ours, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_token_is_reached(codecs):
    ours, _ = codecs
    ids = ours.processor.encode([bpe.letters(t) for t in ours.tokens], num_threads=1)
    assert ids == [[i] for i in range(len(ours.tokens))]


def test_encodes_like_the_library(codecs):
    ours, library = codecs
    random.seed(3)
    letters = "ab 's't \t\n\x0b\r\x85\xa0 　\x1c\x1f​﻿é中9.!,😀_|"
    texts = ["", " ", "  ", "a ", "a  ", " \n ", "don't", "<|endoftext|>", "x" * 3000, "the cat, the\n\n dog."]
    texts += ["".join(random.choice(letters) for _ in range(random.randrange(40))) for _ in range(1500)]
    for t in texts:
        ids = ours.encode(t)
        assert ids == library.encode_ordinary(t), repr(t)
        assert ours.decode(ids) == t.encode()


def test_cache_limit_changes_nothing(codecs):
    ours, library = codecs
    small = bpe.Codec({t: i for i, t in enumerate(ours.tokens)}, bpe.serialise_model({t: i for i, t in enumerate(ours.tokens)}), bpe.default_vocabulary()[1], cache_cuts=3)
    for t in ("one two three four five", "six seven"):
        assert small.encode(t) == library.encode_ordinary(t)


def test_bpe_digests(spark, codecs):
    _, library = codecs
    rows = [(1, "Hello world"), (2, None), (3, ""), (3, "é" * 20_000), (None, "x")]
    df = spark.createDataFrame([(*r, "y") for r in rows], SCHEMA + ", n_tokens string")
    out = {(r.doc_id, r.n_tokens): (r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digest(df).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()
        assert out[i, len(ids)] == want
    assert bpe.bpe_digest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert bpe.bpe_encode(df).where("doc_id = 1").first().token_ids == library.encode_ordinary("Hello world")


class Writer(webp.BitWriter):
    """Writes entropy-coded images with any of the format's tools, with codes of nearly equal lengths."""

    def code(self, alphabet):
        length = max(1, (alphabet - 1).bit_length())
        short = (1 << length) - alphabet
        lengths = [length - 1] * short + [length] * (alphabet - short)
        used = sorted(set(lengths))
        self.write(0, 1)
        order = webp._CODE_LENGTH_ORDER
        self.write(15, 4)
        for i in range(19):
            self.write(1 if order[i] in used else 0, 3)
        self.write(0, 1)
        for n in lengths:
            if len(used) > 1:
                self.write(used.index(n), 1)
        codes, code, last = {}, 0, 0
        for s in sorted(range(alphabet), key=lambda s: (lengths[s], s)):
            code <<= lengths[s] - last
            last = lengths[s]
            codes[s] = (lengths[s], code)
            code += 1
        return codes

    def symbol(self, codes, s):
        n, code = codes[s]
        for i in reversed(range(n)):
            self.write(code >> i & 1, 1)

    def number(self, codes, base, value):
        """A length or distance by its prefix code."""
        if value <= 4:
            self.symbol(codes, base + value - 1)
            return
        v = value - 1
        extra = v.bit_length() - 2
        self.symbol(codes, base + 2 * (extra + 1) + (v >> extra & 1))
        self.write(v & ((1 << extra) - 1), extra)

    def image(self, pixels, main=False, cache_bits=0, copies=False, meta_bits=0):
        height, width = pixels.shape[:2]
        flat = [int.from_bytes(p.tobytes(), "big") for p in pixels.reshape(-1, 4)]
        self.write(int(cache_bits > 0), 1)
        if cache_bits:
            self.write(cache_bits, 4)
        groups = 1
        if main:
            self.write(int(meta_bits > 0), 1)
            if meta_bits:
                self.write(meta_bits - 2, 3)
                h, w = -(-height >> meta_bits), -(-width >> meta_bits)
                meta = np.zeros((h, w, 4), np.uint8)
                meta[:, :, 2] = np.arange(h * w).reshape(h, w) % 2
                self.image(meta)
                groups = int(meta[:, :, 2].max()) + 1
        sizes = [280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
        own = [[self.code(n) for n in sizes] for _ in range(groups)]
        cache, at = {}, 0
        while at < len(flat):
            y, x = divmod(at, width)
            green, red, blue, alpha, far = own[int(meta[y >> meta_bits, x >> meta_bits, 2]) if groups > 1 else 0]
            run = 0
            for back in (width, 1, 7) if copies else ():
                if back <= at:
                    while at + run < len(flat) and flat[at + run] == flat[at + run - back]:
                        run += 1
                if run > 2:
                    break
                run = 0
            slot = (0x1E35A7BD * flat[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
            if run > 2:
                run = min(run, 4096)
                self.number(green, 256, run)
                near = [k for k in range(1, 121) if webp._distance(k, width) == back]
                self.number(far, 0, near[0] if near else back + 120)
            elif cache_bits and cache.get(slot) == flat[at]:
                self.symbol(green, 280 + slot)
                run = 1
            else:
                a, r, g, b = flat[at].to_bytes(4, "big")
                for codes, s in ((green, g), (red, r), (blue, b), (alpha, a)):
                    self.symbol(codes, s)
                run = 1
            for p in flat[at : at + run]:
                if cache_bits:
                    cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            at += run

    def header(self, pixels):
        for value, n in ((0x2F, 8), (pixels.shape[1] - 1, 14), (pixels.shape[0] - 1, 14), (1, 1), (0, 3)):
            self.write(value, n)


def picture(seed, height, width):
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 256, (height, width, 4), dtype=np.uint8)
    out[height // 3 : height // 2] = out[0]
    return out


@pytest.mark.parametrize("cache_bits", [0, 1, 6])
@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("meta_bits", [0, 2])
def test_codes_references_cache_and_entropy_images(cache_bits, copies, meta_bits):
    pixels = picture(1, 19, 13)
    w = Writer()
    w.header(pixels)
    w.write(0, 1)
    w.image(pixels, True, cache_bits, copies, meta_bits)
    assert (webp.decode_stream(w.bytes()) == pixels).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    pixels = picture(mode, 9, 11)
    residual = np.zeros_like(pixels)
    for y in range(9):
        for x in range(11):
            residual[y, x] = (pixels[y, x].astype(int) - webp.predictions(pixels.astype(np.int32), y, x, mode)) & 255
    modes = np.zeros((3, 3, 4), np.uint8)
    modes[:, :, 2] = mode
    w = Writer()
    w.header(pixels)
    w.write(1, 1)
    w.write(0, 2)
    w.write(0, 3)
    w.image(modes)
    w.write(0, 1)
    w.image(residual, True)
    assert (webp.decode_stream(w.bytes()) == pixels).all()


def test_predictions_by_hand():
    p = np.zeros((2, 3, 4), np.int32)
    p[0, :, 0], p[1, 0, 0] = [10, 200, 50], 100
    at = {m: int(webp.predictions(p, 1, 1, m)[0]) for m in range(14)}
    # left 100, top 200, top right 50, top left 10
    assert at == {0: 255, 1: 100, 2: 200, 3: 50, 4: 10, 5: 137, 6: 55, 7: 150, 8: 105, 9: 125, 10: 90, 11: 200, 12: 255, 13: 220}
    assert webp.predictions(p, 1, 2, 3)[0] == 100  # right of the last pixel comes the row's first


def test_colour_and_green_and_both():
    pixels = picture(5, 8, 8)
    blocks = np.zeros((2, 2, 4), np.uint8)
    blocks[:, :, 1:] = [[[20, 200, 7], [1, 2, 3]], [[255, 128, 64], [0, 0, 9]]]
    f = np.repeat(np.repeat(blocks, 4, 0), 4, 1)
    coded = pixels.copy()
    coded[:, :, 1] -= pixels[:, :, 2]
    coded[:, :, 3] -= pixels[:, :, 2]
    red, green, blue = (coded[:, :, c].copy() for c in (1, 2, 3))
    coded[:, :, 1] = (red - webp.colour_delta(f[:, :, 3], green)).astype(np.uint8)
    coded[:, :, 3] = (blue - webp.colour_delta(f[:, :, 2], green) - webp.colour_delta(f[:, :, 1], red)).astype(np.uint8)
    w = Writer()
    w.header(pixels)
    w.write(1, 1)
    w.write(2, 2)
    w.write(1, 1)
    w.write(1, 2)
    w.write(0, 3)
    w.image(blocks)
    w.write(0, 1)
    w.image(coded, True, 4, True)
    assert (webp.decode_stream(w.bytes()) == pixels).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 11, 16, 17, 200])
def test_palette(colours):
    rng = np.random.default_rng(colours)
    palette = rng.integers(0, 256, (colours, 4), dtype=np.uint8)
    index = rng.integers(0, colours, (7, 13))
    pack = webp.palette_pack(colours)
    each = 8 >> pack
    coded = np.zeros((7, -(-13 >> pack), 4), np.uint8)
    for x in range(13):
        coded[:, x >> pack, 2] |= (index[:, x] << each * (x & ((1 << pack) - 1))).astype(np.uint8)
    deltas = palette.copy()
    deltas[1:] -= palette[:-1]
    w = Writer()
    w.header(index)
    w.write(1, 1)
    w.write(3, 2)
    w.write(colours - 1, 8)
    w.image(deltas[None])
    w.write(0, 1)
    w.image(coded, True)
    assert (webp.decode_stream(w.bytes()) == palette[index]).all()


def test_broken_streams():
    good = webp.encode_payload(webp.pad_payload(b"abc"))
    for bad in (b"", b"RIFF", good[:-20], good[:20] + b"\0" + good[21:]):
        if bad:
            with pytest.raises((webp.WebPError, ValueError)):
                webp.decode_files(bad)


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 40_000, webp.MAX_SIDE * webp.ROW_BYTES + 5])
def test_payloads_come_back(size):
    raw = np.random.default_rng(size).bytes(size)
    n, payload, sha, crc, *_ = media.digest(raw)
    padded = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
    assert (n, payload) == (size, len(padded))
    assert sha == hashlib.sha256(padded).hexdigest()
    assert crc == zlib.crc32(padded[-32:])


def test_media_columns(spark):
    df = spark.createDataFrame([(1, "héllo", "m"), (2, None, "m"), (3, "", "m")], SCHEMA + ", feature string")
    out = {r.doc_id: r for r in media.media_digest(df).collect()}
    assert out[1].n_bytes == 6 and out[2].n_bytes == 0 and out[2].media_sha256 == out[3].media_sha256
    back = media.from_media(media.to_media(df)).where("doc_id = 1").first()
    assert bytes(back.pixels)[:6].decode() == "héllo" and (back.width, back.rows) == (192, 1)
    assert media.media_digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_media_digests_by_hand(spark):
    """media_bytes and media_sha256 are those of the stored form, feature is computed from what is read back."""
    texts = ["héllo", None, "", "x" * 5000, "the cat sat on the mat. " * 400, "".join(chr(65 + i * i % 57) for i in range(3000)), "x" * 5000]
    out = {r.doc_id: r for r in media.media_digest(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    stored = {r.doc_id: bytes(r.media) for r in media.to_media(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    for i, t in enumerate(texts):
        payload = webp.pad_payload((t or "").encode())
        sums = np.frombuffer(payload, np.uint8).reshape(-1, 3).sum(0, dtype=np.int64)
        assert out[i].feature == "|".join(map(str, [1, 192, len(payload) // 576, *sums]))
        assert (out[i].media_bytes, out[i].media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
        assert out[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
    assert out[3].media_sha256 == out[6].media_sha256 and out[4].media_bytes < 600


def test_media_of_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert media.to_media(empty).collect() == [] and media.from_media(media.to_media(empty)).collect() == []
    df = spark.createDataFrame([(1, "a", "m", 5), (1, "a", "m", 5), (2, None, "m", 5)], SCHEMA + ", media string, width int")
    rows = media.from_media(media.to_media(df)).collect()
    assert [r.width for r in rows] == [192] * 3 and bytes(rows[0].pixels) == bytes(rows[1].pixels)
    none = media.from_media(spark.createDataFrame([(1, None)], "doc_id bigint, media binary")).first()
    assert (none.width, none.rows, none.pixels) == (None, None, None)


def pictures():
    rng = np.random.default_rng(4)
    noise = rng.integers(0, 256, (40, 64, 1), dtype=np.uint8)
    smooth = np.cumsum(rng.integers(0, 3, (200, 64, 3), dtype=np.uint8), axis=0, dtype=np.uint8)
    few = rng.integers(0, 256, (5, 3), dtype=np.uint8)[rng.integers(0, 5, (30, 50))]
    cached = rng.integers(0, 256, (300, 3), dtype=np.uint8)[rng.integers(0, 300, (80, 60))]
    return {
        "grey": np.repeat(noise, 3, 2),
        "smooth": smooth,
        "few colours": few,
        "many repeats of colours": cached,
        "repeated rows": np.tile(rng.integers(0, 256, (1, 64, 3), dtype=np.uint8), (50, 1, 1)),
        "noise": rng.integers(0, 256, (20, 33, 3), dtype=np.uint8),
        "one pixel": np.zeros((1, 1, 3), np.uint8),
    }


@pytest.mark.parametrize("name", list(pictures()))
def test_encoder_uses_the_tools_and_comes_back(name, monkeypatch):
    image = pictures()[name]
    height, width = image.shape[:2]
    used, images = set(), []
    for tool in ("_undo_green", "_undo_predictor", "_undo_palette", "_distance"):
        whole = getattr(webp, tool)
        monkeypatch.setattr(webp, tool, lambda *a, f=whole, t=tool: used.add(t) or f(*a))
    read = webp._read_image
    monkeypatch.setattr(webp, "_read_image", lambda *a: images.append(1) or read(*a))
    webp._near_codes.cache_clear()
    data = webp.encode_pixels(image.tobytes(), width, height)
    used.clear()
    (back,) = webp.decode_files(data)
    assert (back[:, :, 1:] == image).all() and (back[:, :, 0] == 255).all() and images
    wanted = {"grey": "_undo_green", "smooth": "_undo_predictor", "few colours": "_undo_palette", "repeated rows": "_distance"}
    if name in wanted:
        assert wanted[name] in used, used
    if name != "noise" and image.size > 3:
        assert len(data) < 0.85 * image.size


def test_code_lengths_are_complete_and_bounded():
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for counts in ([1, 1], [5, 1, 1], fibonacci, list(range(1, 257)), [1] * 200 + [10**6]):
        for longest in (9, 15):
            lengths = webp.code_lengths(counts, longest)
            assert max(lengths) <= longest and sum(2.0**-n for n in lengths) == 1
            assert all(a >= b for (x, a), (y, b) in zip(sorted(zip(counts, lengths, strict=True)), sorted(zip(counts, lengths, strict=True))[1:], strict=False) if x < y)


@pytest.mark.parametrize("kind", ["words", "copies", "cache", "both", "long", "colours"])
def test_pixels_read_at_once_are_those_of_the_symbol_loop(kind, monkeypatch):
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, k).astype(np.uint8)) for k in rng.integers(2, 12, 400)]
    text = b" ".join(words[i] for i in rng.integers(0, 400, 60_000 if kind == "long" else 900))
    few = rng.integers(0, 256, (300, 3)).astype(np.uint8)
    raw = {"copies": text + text[:3000] * 3, "cache": few[rng.integers(0, 300, 4000)].tobytes(), "colours": rng.integers(0, 256, 9000).astype(np.uint8).tobytes()}.get(kind, text)
    if kind == "both":
        raw = few[rng.integers(0, 300, 4000)].tobytes() * 2
    payload = webp.pad_payload(raw)
    media_bytes = webp.encode_payload(payload)
    read, at_once = webp._read_pixels, []

    def counted(*a):
        at_once.append(read(*a))
        return at_once[-1]

    monkeypatch.setattr(webp, "_read_pixels", counted)
    fast = webp.decode_files(media_bytes)
    assert any(x is not None for x in at_once)
    monkeypatch.setattr(webp, "_LEAST_PIXELS", 1 << 60)
    slow = webp.decode_files(media_bytes)
    assert all((a == b).all() for a, b in zip(fast, slow, strict=True))
    assert b"".join(i[:, :, 1:].tobytes() for i in fast) == payload
    with pytest.raises(webp.WebPError):
        monkeypatch.setattr(webp, "_LEAST_PIXELS", 128)
        webp.decode_stream(media_bytes[20 : 20 + len(media_bytes) // 2])


def test_work_on_a_text_stays_small():
    """Calls and memory that storing and reading back a text takes, which is what its CPU time goes to."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, k).astype(np.uint8)) for k in rng.integers(2, 12, 400)]
    raw = b" ".join(words[i] for i in rng.integers(0, 400, 500))
    payload = webp.pad_payload(raw)
    media.digest(raw)  # fills the tables
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    before = sys.getprofile()
    sys.setprofile(count)
    try:
        media.digest(raw)
    finally:
        sys.setprofile(before)
    assert calls < 2200  # 3716 before
    tracemalloc.start()
    webp.encode_payload(payload)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(payload)  # 158 bytes a byte before


def test_many_numbers_are_written_like_single_ones():
    rng = np.random.default_rng(2)
    for top in (2, 14, 53, 65):
        for n in (0, 1, 2, 700):
            sizes = rng.integers(0, top, n)
            values = np.array([int.from_bytes(rng.bytes(8), "little") & (1 << k) - 1 for k in sizes.tolist()], np.uint64)
            at_once, single = webp.BitWriter(), webp.BitWriter()
            for w in (at_once, single):
                w.write(5, 3)
            at_once.extend(values, sizes)
            for value, size in zip(values.tolist(), sizes.tolist(), strict=True):
                single.write(value, size)
            for w in (at_once, single):
                w.write(1, 1)
            assert at_once.bytes() == single.bytes()


def test_lists_of_code_lengths_come_back():
    rng = np.random.default_rng(6)
    cases = [[int(n) for n in rng.zipf(1.3, size) % 5000 * (rng.random(size) < share)] for size in (256, 280, 536) for share in (0.02, 0.2, 0.9) for _ in range(10)]
    cases += [[1] * 256, [0] * 200 + [1] * 56, [1] * 3 + [0] * 250 + [1] * 3, [0, 0, 3, 0, 2], [0] * 270 + [4]]
    for counts in cases:
        used = [s for s, c in enumerate(counts) if c]
        if not used:
            continue
        code = webp._code(np.array(counts))
        w = webp.BitWriter()
        code.write(w)
        bits = webp.Bits(w.bytes())
        read, _ = webp._read_code(bits, len(counts), bits.window())
        assert bits.at == w.size and [s for s, _ in read.lengths] == used
        assert read.lengths == code.lengths
        for s, n in read.lengths if len(used) > 1 else ():
            assert code.sizes[s] == n and read.table[int(code.codes[s])] == read.array[int(code.codes[s])] == s << 4 | n


@pytest.mark.parametrize("cache_bits", [1, 2, 4])
@pytest.mark.parametrize("copies", [False, True])
def test_cached_and_copied_pixels_read_at_once(cache_bits, copies, monkeypatch):
    """Few slots, so that colours replace each other there between copies of cached pixels."""
    rng = np.random.default_rng(cache_bits)
    colours = rng.integers(0, 256, (7, 4), dtype=np.uint8)
    pixels = colours[rng.integers(0, 7, (40, 23))]
    pixels[20:30] = pixels[3:13]

    class Opaque(Writer):
        def code(self, alphabet):
            self.made = getattr(self, "made", 0) + 1
            if self.made != 4:
                return super().code(alphabet)
            for value, n in ((1, 1), (0, 1), (1, 1), (255, 8)):
                self.write(value, n)
            return {255: (0, 0)}

    pixels[:, :, 0] = 255
    w = Opaque()
    w.header(pixels)
    w.write(0, 1)
    w.image(pixels, True, cache_bits, copies)
    read, at_once = webp._read_pixels, []
    monkeypatch.setattr(webp, "_read_pixels", lambda *a: at_once.append(read(*a)) or at_once[-1])
    assert (webp.decode_stream(w.bytes()) == pixels).all()
    assert len(at_once) == 1 and at_once[0] is not None


def test_texts_stored_together_are_those_stored_alone():
    raws = [b"the cat sat %d " % i * (i % 7) for i in range(2 * media._AT_ONCE + 3)]
    assert media.digests(raws) == [media.digest(raw) for raw in raws]
    assert media.digests([]) == []
