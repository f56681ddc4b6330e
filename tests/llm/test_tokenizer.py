import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from quern.llm.tokenizer import DEFAULT_VOCABULARY, Encoder, PairRanks, encode_corpus, merge_long, read_vocabulary

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary file")

#: The vocabulary's published splitting pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def other():
    with open(DEFAULT_VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    letters = list("ab é'\n\t \x1c\x85 　中文字٣²½🇪🇺́‍_.,sdl1 ") + ["'s", "'ll", "  ", "\r\n", "<|endoftext|>"]
    return ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)] + ["a" * 5000, "中" * 3000, "ab" * 4000, " " * 3000, "x", "", None]


def test_same_ids_as_another_encoder(other):
    given = texts()
    offsets, ids = Encoder(read_vocabulary(DEFAULT_VOCABULARY), remember=50).encode(given)
    for i, t in enumerate(given):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == other.encode_ordinary(t or ""), t[:50]


def test_long_and_batched_merges_agree(other):
    ranks = PairRanks(read_vocabulary(DEFAULT_VOCABULARY))
    rng = random.Random(6)
    for _ in range(200):
        word = "".join(rng.choices("etaoinéß中", k=rng.randint(1, 90)))
        assert merge_long(ranks.byte[list(word.encode())].tolist(), ranks) == other.encode_ordinary(word)


def test_round_trip_and_rows(spark, other):
    given = [(i, t) for i, t in enumerate(texts()[-200:])] + [(7, "again"), (7, "again")]
    df = spark.createDataFrame(given, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = encode_corpus(df).collect()
    assert len(got) == len(given)
    assert sorted((r["doc_id"], other.decode(r["ids"])) for r in got) == sorted((i, t or "") for i, t in given)
    assert encode_corpus(df.limit(0)).count() == 0


def test_vocabulary_size_is_checked(tmp_path):
    (tmp_path / "v").write_bytes(b"x" * 100)
    with pytest.raises(ValueError):
        read_vocabulary(str(tmp_path / "v"), 10)
