import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import bpe

V = bpe.default_vocabulary()
T = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
T.no_truncation()
T.no_padding()

TEXTS = [
    "", " ", "Hello   World's\tbest 'll 123 ½²", "<|endoftext|>a<|startoftext|> b<|endof", "ÀÉ é ΣΑΣ İstanbul ß ﬁ",
    "日本語 テキスト 🎉🎉 x​\u0085y\u001cz", "a" * 3000, "!?!?..--***" * 50, "don't you'Re", "\0<|endoftext|> \0", None,
]


def expected(texts):
    enc = T.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [(e.ids, T.decode(e.ids, skip_special_tokens=False)) for e in enc]


def test_texts_equal_the_library():
    coder = bpe.Coder(V)
    got = [(np.frombuffer(i, "<u4").tolist(), d) for i, d in coder.coded(TEXTS)]
    for t, a, b in zip(TEXTS, got, expected(TEXTS), strict=True):
        assert a == b, repr(t)[:80]


def test_random_words_equal_exact_merging():
    rng = random.Random(5)
    tokens = [t for t in V.ids if t.isascii()]
    words = ["".join(rng.choice(tokens).replace("\n", "") for _ in range(rng.randint(1, 5))) + "\n" for _ in range(5000)]
    words = [w for w in words if len(w) > 1]
    assert V.encoded(words) == [V.merged(w) for w in words]


@pytest.mark.parametrize("n", [0, 3])
def test_frames(spark, n):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS[:n])], "doc_id long, text string, ids int")
    rows = {r["doc_id"]: r for r in bpe.digests(df, V).collect()}
    assert len(rows) == n
    for k, (ids, text) in enumerate(expected(TEXTS[:n])):
        assert rows[k]["n_tokens"] == len(ids)
        assert rows[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[k]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert [r["ids"] for r in bpe.encode(df, V).orderBy("doc_id").collect()] == [i for i, _ in expected(TEXTS[:n])]


def test_a_word_met_again_is_not_encoded_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "TOGETHER", 1)
    seen = []
    encoded = V.encoded
    monkeypatch.setattr(V, "encoded", lambda words: seen.extend(words) or encoded(words))
    texts = ["hello <|endoftext|>, hello! " + " ".join(f"w{chr(97 + k)}{chr(97 + j)}" for j in range(20)) for k in range(20)]
    texts += ["\0<|ENDOFTEXT|> 'S ''s it's\x1cx y z " + "ab" * 80 + "," + "c" * 70 + " ÀB,c9"] * 2
    coder = bpe.Coder(V)
    got = [(np.frombuffer(i, "<u4").tolist(), d) for i, d in coder.coded(texts)]
    assert got == expected(texts)
    assert seen.count("hello\n") == 1
