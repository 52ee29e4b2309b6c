"""BPE encoding and decoding against the tokenizers library and a plain merge loop."""
import hashlib
import random

import numpy as np
import pytest

from spreadlens.llm import bpe
from test_operators import DOCS, ROWS


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBPE(bpe.tokenizer_file())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.tokenizer_file())
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rng = random.Random(3)
    yield from ("a<|endoftext|> b <|endoftext|><|endoftext|>", " " * 5000 + "x", "\n" * 3000, "x" * 9000, "aaab" * 3000 + "!",
                "՘࢏ab \U000107bb1 \U0001ccf0", "it's we'LL 'S     x\u0085y᠎ z\x1c\x1d a", "日本語 한국어 mixed 123४५६ ½²", "\x00\x01 ﻿")
    pool = "ab \n\t'sre1é中.,  \U0001F600̀₏\U00010940"
    for _ in range(500):
        yield "".join(rng.choice([*pool, "<|endoftext|>"]) for _ in range(rng.randint(0, 40)))
    for _ in range(100):
        yield "".join(chr(rng.choice([rng.randint(1, 0x2fff), rng.randint(0x10000, 0x1ffff)])) for _ in range(60))


def test_ids_and_texts_equal_the_library(own, library):
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == ids, text[:80]
        assert own.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_decode_any_ids(own, library):
    rng = random.Random(5)
    for _ in range(500):
        ids = [rng.randint(0, 50_300) for _ in range(20)]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_merge_equals_plain_loop():
    """Any table of merges: a new pair may rank below the merge that made it."""
    rng = random.Random(7)
    for _ in range(400):
        ranks, merged = {}, []
        for _ in range(rng.randint(0, 30)):
            pair = rng.randint(0, 8) << 32 | rng.randint(0, 8)
            if pair not in ranks:
                ranks[pair] = len(merged)
                merged.append(rng.randint(0, 8))
        word = [rng.randint(0, 4) for _ in range(rng.randint(0, 40))]
        plain = list(word)
        while found := [(ranks[a << 32 | b], i) for i, (a, b) in enumerate(zip(plain, plain[1:])) if a << 32 | b in ranks]:
            r, i = min(found)
            plain[i:i + 2] = [merged[r]]
        assert bpe.merge(word, ranks, merged) == plain
        if word and ranks:
            row = np.array([word + [-1] * rng.randint(0, 3)])
            got = bpe.merge_all(row, np.array([len(word)]), bpe.Pairs(ranks, merged))
            assert got[got >= 0].tolist() == plain


def test_words_are_forgotten(own):
    own.kept = 3
    text = "several different words come here and come here again"
    assert own.decode(own.encode(text)) == text
    assert own.encode("here, again") and len(own.known) <= 3
    own.kept = bpe.KEPT


def test_texts_together_and_in_slices(own, library, monkeypatch):
    texts = [None, "", *odd_texts()]
    want = [library.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
    for together, size in ((1 << 20, 1 << 17), (30, 2)):
        monkeypatch.setattr(bpe, "TOGETHER", together)
        monkeypatch.setattr(bpe, "SLICE", size)
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)] == want
    assert not any(len(w) > 64 or own.later.search(w) for w in own.known)


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                          hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op13_bpe(spark, sf).collect()}
    assert got == want


def test_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    got = bpe.decode(bpe.encode(docs)).collect()
    assert len(got) == len(ROWS) and [c for c in bpe.encode(docs).columns] == [*docs.columns, "ids"]
    assert all(r.decoded == (r.text or "") for r in got)
    assert all(len(r.ids) == 0 for r in got if not r.text)
    assert bpe.decode(bpe.encode(docs.filter("false"))).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumnRenamed("lang", "ids"))
