import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenderloom.llm import blocks, bpe, media

from .fixtures import documents, no_documents, rows


def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def payload(text):
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % 192 or (0 if raw else 192))


def test_media_round_trip(spark):
    got = media.read(media.encode(documents(spark))).collect()
    want = Counter((i, hashlib.sha256(payload(t)).hexdigest(), zlib.crc32(payload(t)[-16:])) for i, t in rows())
    assert Counter((r.doc_id, r.sample_sha256, r.tail_crc32) for r in got) == want
    assert len({r.feature for r in got if r.doc_id in (1, 3)}) == 1
    assert media.read(media.encode(no_documents(spark))).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert media.read(nothing).first().feature is None


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_every_row_filter_is_undone(channels):
    r = np.random.default_rng(3)
    samples = r.integers(0, 256, (12, 8 * channels), dtype=np.uint8)
    assert (media.read_png(media.write_png(samples, channels))[0] == samples).all()
    kinds = np.array([0, 1, 2, 3, 4] * 2 + [4, 3], np.uint8)
    filtered = np.empty_like(samples)
    wide = samples.astype(int)
    for y, kind in enumerate(kinds):
        for x in range(samples.shape[1]):
            a = wide[y, x - channels] if x >= channels else 0
            b = wide[y - 1, x] if y else 0
            c = wide[y - 1, x - channels] if y and x >= channels else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            filtered[y, x] = (wide[y, x] - [0, a, b, (a + b) // 2, paeth][kind]) % 256
    assert (media.unfilter(kinds, filtered, channels) == samples).all()


def test_damaged_media_name_the_chunk():
    good = bytearray(media.write_png(np.zeros((2, 192), np.uint8)))
    good[45] ^= 1
    with pytest.raises(ValueError, match="IDAT"):
        media.read_png(bytes(good))


def test_bpe_equals_the_library(spark):
    t = tokenizer("byte_bpe_50k.json")
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Counter()
    for i, text in rows():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = bpe.digest(documents(spark), path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = bpe.decode(bpe.encode(documents(spark), path), path).select("doc_id", "decoded", "score").collect()
    assert Counter((r.doc_id, r.decoded) for r in back) == Counter((i, x or "") for i, x in rows())
    assert bpe.encode(no_documents(spark), path).count() == 0


def test_bpe_on_odd_texts(spark):
    t, store = tokenizer("byte_bpe_50k.json"), bpe.Forced(public_tokenizers.path("byte_bpe_50k.json"))
    r = np.random.default_rng(5)
    signs = list("ab Zz09.,'\n\t    　éß日😀-") + ["'s", "'ll", "<|endoftext|>", "qz", "jx"]
    texts = ["".join(r.choice(signs, r.integers(0, 60))) for _ in range(3000)]
    raw = [x.encode() for x in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    ids, first = store.encode(offsets, np.frombuffer(b"".join(raw), np.uint8))
    for k, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert ids[first[k] : first[k + 1]].tolist() == e.ids, texts[k]


def test_blocks_read_back(spark):
    path = blocks.write(documents(spark), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    t = tokenizer("word_bpe_49k.json")
    ordered = sorted(rows(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    want, start = [], 0
    for i, text in ordered:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = blocks.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    empty = blocks.write(no_documents(spark), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    assert blocks.read(spark, empty).count() == 0


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 3000])
def test_blocks_of_any_values(size):
    r = np.random.default_rng(size)
    ids = r.integers(0, 300, size).astype(np.uint32)
    ids[::37] = r.integers(0, 2**32, len(ids[::37]), dtype=np.uint64).astype(np.uint32)
    chunk = blocks.Chunk(blocks.pack_chunk([ids[: size // 3], ids[size // 3 :], ids[:0]]))
    assert (chunk.whole() == ids).all()
    assert (chunk.document(1) == ids[size // 3 :]).all() and len(chunk.document(2)) == 0
