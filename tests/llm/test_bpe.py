"""BPE against the tokenizers library, and exact round trips."""

import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from lexigauge.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
PARTS = ["a", "the", "ing", " ", "  ", "\n", "é", "ß", "日本", "'s", "'ll", "1", "23", "!!", " .", "<|endoftext|>",
         "\x1c", "\x85", "​", "😀", "\t", "aaa", "\xa0", "՘", "AB", "zz", "=-=-", " Hello", "tion", "\x00", " für", "ñ", "×", "ÿ", "ɏ", "ɐ", "²", "ª"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def samples():
    rnd = random.Random(7)
    yield from ["", " ", "\n\n", "<|endoftext|>", "a" * 30_000, " " * 9_000, "ab" * 9_000, "thethe" * 900, "!" * 999 + "?" * 999]
    for _ in range(1500):
        yield "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30)))


def test_encoder_equals_library(library):
    encoder = bpe.Encoder(bpe.Vocabulary(open(PATH).read()))
    decoder = bpe.Decoder(encoder.v)
    for text in samples():
        want = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == want, text[:80]
        assert decoder.decode(np.array(want, np.int32)) == library.decode(want, skip_special_tokens=False)


def test_decoder_of_broken_bytes(library):
    rnd = random.Random(3)
    decoder = bpe.Decoder(bpe.Vocabulary(open(PATH).read()))
    for _ in range(300):
        ids = [rnd.randrange(50257) for _ in range(rnd.randint(0, 8))]
        assert decoder.decode(np.array(ids, np.int32)) == library.decode(ids, skip_special_tokens=False)


def test_table(spark, library):
    rows = [(1, None, 5), (2, "", 6), (2, "", 6), (3, "Hello wörld  x", 7), (None, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").drop("ids")
    docs = docs.withColumn("n_tokens", docs.doc_id)
    out = bpe.decode(bpe.encode(docs, PATH), PATH).select("doc_id", "text", "ids", "decoded", *bpe.digests(docs, "ids"))
    got = out.collect()
    assert len(got) == 5
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == (r.text or "")
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0


def test_decoding_in_blocks_cuts_no_character(monkeypatch):
    import public_tokenizers

    source = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    vocabulary = bpe.Vocabulary(source)
    text = "Straße 日本語 🙂🙃 naïve " * 50
    ids = bpe.Encoder(vocabulary).encode(text)
    for size in (1, 2, 7, len(ids), 1 << 16):
        monkeypatch.setattr(bpe, "BLOCK", size)
        assert bpe.Decoder(vocabulary).decode(ids) == text
    assert bpe.Decoder(vocabulary).decode(ids[:0]) == ""
