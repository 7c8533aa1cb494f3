import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evidra.llm import simple8b, token_files, word_codec
from evidra.llm.shared import vocabulary

FILE = "word_bpe_49k.json"


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3) | st.integers(0, 50000), max_size=300), st.sampled_from([1, 7, 64, 1024]))
@settings(max_examples=150, deadline=None)
def test_simple8b_round_trip(values, block):
    values = np.array(values, np.uint64)
    data = simple8b.pack(values, block)
    assert np.array_equal(simple8b.unpack(data), values) and len(data) % 8 == 0
    blocks = len(simple8b.header(data)[1]) - 1
    for k in range(min(blocks, 3)):
        assert np.array_equal(simple8b.unpack(data, k, k + 1), values[k * block : (k + 1) * block])


def test_simple8b_is_dense():
    assert len(simple8b.pack(np.zeros(60000, int))) < 60000 / 60 * 8 * 1.1
    with pytest.raises(ValueError):
        simple8b.unpack(b"nothing")


def test_words_like_the_library():
    source = open(vocabulary(FILE)).read()
    own, library = word_codec.WordCodec(source), Tokenizer.from_str(source)
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "漢", "'s", "'", "'re", "'ll", "The", "\x00", "ING", "12", "²", "½", "\xa0", "\x85", "\x1c", "İ", "Σ", "!!", "É", "ß", "<|endoftext|>", "é", "ª", "\xad"]
    texts = ["".join(rng.choice(parts[: rng.choice([12, 16, len(parts)])]) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_files(spark):
    library = Tokenizer.from_str(open(vocabulary(FILE)).read())
    rng = random.Random(2)
    rows = [(i * 37 % 1009, " ".join(rng.choice(["the", "cat", "x1", "über", "漢"]) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(2000, None), (2001, ""), (5, "again"), (5, "again"), (3000, "long " * 30000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, start string").repartition(5)
    got = sorted(map(tuple, token_files.report(df, FILE).collect()))
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)


def test_files_of_odd_tables(spark):
    got = token_files.report(spark.createDataFrame([(None, "b"), (1, "a")], "doc_id long, text string"), FILE).collect()
    assert {(r["doc_id"], r["start"]) for r in got} == {(None, 0), (1, 2)}
    assert token_files.report(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0
