import hashlib
import random

import pandas as pd
import public_tokenizers
import pytest
from feedloom.llm import bpe
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH) as f:
        return bpe.Vocabulary(f.read())


def encode(coder, text):
    out = []
    coder.encode(text, out.extend)
    return out


@pytest.mark.parametrize("window", [70, 65_536])
def test_mixed_texts(library, vocabulary, window):
    rng, coder = random.Random(1), bpe.Encoder(vocabulary, window)
    parts = [*" \t\n\r\x0b\x1c\x85\xa0aetinhéß'strevlmd0123²½，#*!", "<|endoftext|>", "<|endof", "'re", " the", "😀", "中文"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 200)))
        ids = encode(coder, text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        decoder = bpe.Decoder(vocabulary)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("unit", ["a", "0", "!", " ", "\n", "=-", "thtiontion", "é"])
def test_endless_words_are_streamed(library, vocabulary, unit):
    text = unit * (6000 // len(unit)) + "x"
    for window in (70, 500):
        coder = bpe.Encoder(vocabulary, window)
        assert encode(coder, text) == library.encode(text, add_special_tokens=False).ids


def test_random_long_words(library, vocabulary):
    rng = random.Random(2)
    for alphabet in ("etaoinshr", "ab", "0123456789"):
        text = "".join(rng.choice(alphabet) for _ in range(15_000))
        assert encode(bpe.Encoder(vocabulary, 300), text) == library.encode(text, add_special_tokens=False).ids


def test_lookahead_covers_every_change(vocabulary):
    """No later byte changes a token that ends a lookahead before the end."""
    rng = random.Random(3)
    for _ in range(60):
        whole = bytes(rng.choice(b"etaoinshrdlu") for _ in range(900))
        ends = {0}
        for t in vocabulary.merge(whole):
            ends.add(max(ends) + len(vocabulary.bytes_of[t]))
        cut = rng.randint(300, 899)
        at = 0
        for t in vocabulary.merge(whole[:cut]):
            at += len(vocabulary.bytes_of[t])
            assert at > cut - vocabulary.lookahead or at in ends


def test_cut_characters_and_bad_bytes(library, vocabulary):
    smile = vocabulary.merge("😀é".encode())
    decoder = bpe.Decoder(vocabulary)
    assert "".join(decoder.feed([i]) for i in smile) + decoder.finish() == "😀é"
    for ids in ([vocabulary.byte_id[0xF0]], [vocabulary.byte_id[0xE4], vocabulary.byte_id[0x41]], [vocabulary.byte_id[0x80]] * 3):
        decoder = bpe.Decoder(vocabulary)
        assert decoder.feed(ids) + decoder.finish() == library.decode(ids, skip_special_tokens=False)


def test_whole_table(spark, sf, library):
    from feedloom.llm.registry import load

    got = load()[0]["op4_bpe_streaming"](spark, sf).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")
    for doc, text in docs.text.items():
        ids = library.encode(text, add_special_tokens=False).ids
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        assert list(got.loc[doc]) == [len(ids), *sha]


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 5), (2, "", 6), (None, "a b", 7), (2, "", 8), (3, "word" * 50_000, 9)], "doc_id long, text string, n_tokens int"
    )
    rows = bpe.round_trip(docs, PATH).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_tokens) for r in rows[:4]] == [(1, 0), (2, 0), (None, 2), (2, 0)]
    assert rows[0].ids_sha256 == empty and rows[0].decoded_sha256 == empty
    assert rows[4].decoded_sha256 == hashlib.sha256(b"word" * 50_000).hexdigest()
    ids = docs.select("text", bpe.encode_column(spark, PATH, F.col("text")).alias("ids"))
    back = ids.select("text", bpe.decode_column(spark, PATH, F.col("ids")).alias("back")).collect()
    assert all((r.text or "") == r.back for r in back)
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
