import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from evidra.llm import sentencepiece_codec as codec
from evidra.llm.bpe_rounds import MergeTable, merge_words
from evidra.llm.shared import vocabulary

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def both():
    return codec.Codec(codec.read_model(MODEL)), sentencepiece.SentencePieceProcessor(model_file=vocabulary(MODEL))


def texts(seed, n=3000):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "é", "漢", "😀", "▁", "aaa", "the", "\x00", "ing", " \t", "ſ", "=", "----", "​", "<s>", "</s>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(n)] + ["", " ", "a" * 3000, " " * 500, "ab" * 2000, "=" * 777, "the cat " * 3000]


def test_encode_like_the_library(both):
    own, library = both
    given = texts(1)
    assert [x.tolist() for x in own.encode(given, end=False)] == library.encode(given)


def test_decode_like_the_library(both):
    own, library = both
    given = texts(2)
    ids = own.encode(given)
    assert [x.decode() for x in own.decode_bytes(ids)] == library.decode([x.tolist() for x in ids])
    rng = random.Random(3)
    loose = [[rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.choice([29871, 2, 1, 0])]) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    assert [x.decode() for x in own.decode_bytes([np.array(r, int) for r in loose])] == library.decode(loose)
    with pytest.raises(ValueError):
        own.decode_bytes([np.array([32000])])


def test_rounds_follow_the_sequential_rule():
    """Ranks that fall as pieces grow: merging all occurrences at once would be wrong."""
    rng = random.Random(4)
    for _ in range(60):
        pairs = {}
        symbols = list(range(4))
        for made in range(4, 14):
            pairs[(rng.choice(symbols), rng.choice(symbols))] = (rng.randrange(8), made)
            symbols.append(made)
        table = MergeTable(*(np.array(x, np.int64) for x in zip(*((a, b, r, m) for (a, b), (r, m) in pairs.items()))))
        words = [[rng.randrange(4) for _ in range(rng.randint(1, 14))] for _ in range(40)]
        flat, counts = merge_words(np.array([s for w in words for s in w]), np.array([len(w) for w in words]), table)
        ends = np.cumsum(counts)
        for w, a, b in zip(words, ends - counts, ends):
            while True:
                found = min(((pairs[p][0], i) for i, p in enumerate(zip(w, w[1:])) if p in pairs), default=None)
                if found is None:
                    break
                i = found[1]
                w[i : i + 2] = [pairs[(w[i], w[i + 1])][1]]
            assert flat[a:b].tolist() == w


def test_columns(spark, both):
    own, library = both
    df = spark.createDataFrame([(1, "Hello  world", 5), (None, None, 6), (1, "Hello  world", 7)], "doc_id long, text string, ids int")
    encoded = codec.encode(df.drop("ids").withColumn("extra", df.doc_id), MODEL)
    rows = codec.decode(encoded, MODEL).collect()
    assert sorted((r["text"] or "", r["decoded"]) for r in rows) == [("", ""), ("Hello  world", "Hello  world"), ("Hello  world", "Hello  world")]
    assert {tuple(r["ids"]) for r in rows} == {(2,), tuple(library.encode("Hello  world") + [2])}
    assert codec.encode(df, MODEL).columns == ["doc_id", "text", "ids"]


def test_digests(spark, both):
    own, library = both
    rows = [(i, t) for i, t in enumerate(texts(5, 200))] + [(900, None), (901, "x " * 60000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in codec.digests(df, MODEL).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in rows:
        ids = library.encode(t or "") + [2]
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    assert codec.digests(spark.createDataFrame([], "doc_id long, text string, n_tokens string"), MODEL).count() == 0
