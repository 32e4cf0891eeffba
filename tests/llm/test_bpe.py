import hashlib
import random

import public_tokenizers as P
import tiktoken
from ledgerlens.llm import bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def sha(x):
    return hashlib.sha256(x).hexdigest()


def expected(enc, text):
    ids = enc.encode_ordinary(text or "")
    return len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())


def test_matches_library_on_tables(spark, sf_dir):
    enc = library()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op1_bpe(spark, sf_dir).collect()}
    assert got == {r.doc_id: expected(enc, r.text) for r in docs}


def test_edges(spark):
    enc = library()
    texts = [None, "", " ", "\n\n  x", "a" * 3000, "ab" * 900 + "!" * 500, "naïve 😀 日本語 ſ́", "<|endoftext|>", "same", "same", "'s 'S don't", "\x00\x01 "]
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids string")
    rows = bpe.encode(df, PATH, P.PATTERN, with_ids=True).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {i: expected(enc, t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in rows} == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = bpe.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in rows] + [(99, None)], "doc_id long, ids array<int>"), PATH).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == {i: t or "" for i, t in enumerate(texts)} | {99: ""}


def test_empty_table_and_memo_turnover(spark, monkeypatch):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, PATH, P.PATTERN).count() == 0
    enc, codec = library(), bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    for block in (["alpha", " beta"], [" gamma", "alpha", " delta", "zzzqq"], ["alpha", " beta"], [" beta"]):
        memo = codec.learn(set(block))
        assert all(memo[w][0] == ",".join(map(str, enc.encode_ordinary(w))) for w in block)


def test_long_words_contract_in_the_same_order():
    enc, codec, rng = library(), bpe.Codec(bpe.read_ranks(PATH), P.PATTERN), random.Random(5)
    words = ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyzé", "aA") for n in (1, 7, 60, 900)]
    words += ["!" * 5001, "ab" * 2000, "a" * 20000, "".join(rng.choice("etaoinshrdlucmfw") for _ in range(20000))]
    for w in words:
        want = (",".join(map(str, enc.encode_ordinary(w))), len(enc.encode_ordinary(w)), w.encode())
        assert codec.solve([w], bpe.ENCODE_LONG) == [want]
        assert len(w) > 1000 or codec.solve([w]) == [want]
