import base64
import os
import random

import pytest

from arbora.llm import tokenizer as K

pytestmark = pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no vocabulary files")
TEXTS = ["", None, " ", "\n\n\t x", "aaaaaaaaaaaaaaa" * 9, "Hello, world's end... 12345678", "Ünï¢ödé 🎉🎉 世代 ​�", "<|endoftext|>", "a" * 30_000, "word " * 20_000, "'s 't 're", "  double  spaces  "]


def reference():
    import tiktoken

    with open(K.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_public_library(spark):
    r = random.Random(3)
    texts = TEXTS + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(32, 127), r.randrange(0xA0, 0x2FF), 0x1F389])) for _ in range(r.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = reference()
    got = {x["doc_id"]: x["ids"] for x in K.encoded(df).select("doc_id", "ids").collect()}
    for i, t in enumerate(texts):
        assert got[i] == enc.encode_ordinary(t or ""), t
        assert enc.decode(got[i]) == (t or "")


def test_shapes(spark):
    schema = "text string, n int, flat string"
    assert K.encoded(spark.createDataFrame([], schema)).count() == 0
    out = K.encoded(spark.createDataFrame([("a b", 1, None), ("a b", 1, None)], schema))
    assert out.columns == ["text", "n", "flat", "ids"] and [len(r["ids"]) for r in out.collect()] == [2, 2]
    with pytest.raises(ValueError):
        K.encoded(out)
