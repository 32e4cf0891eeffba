import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from ledgerlens.llm import bpe, quality
from tests.llm import test_decontam, test_minhash, test_secrets


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """What each stage keeps, each written and read again."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns
        out[name] = {r.doc_id: r for r in docs.collect()}
    return out


def test_stages_against_brute_force(spark, sf_dir, kept):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {i: r for i, r in docs.items() if quality.chance(r.text, model) >= quality.ACCEPT}
    assert kept["quality"] == good and 0 < len(good) < len(docs)
    one = {i for i, _, c in test_minhash.brute([(i, r.text) for i, r in good.items()], 5, 80) if i == c}
    assert set(kept["near_duplicates"]) == one and len(one) < len(good)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {d for d, _ in test_decontam.brute([(i, good[i].text) for i in one], items)}
    assert set(kept["decontamination"]) == one - leaked and leaked
    for i, r in kept["secrets"].items():
        text, out, at = good[i].text, [], 0
        for a, _, b in test_secrets.brute(text):
            if a >= at:
                out += [text[at:a], "[secret]"]
            at = max(at, b)
        want = "".join(out) + text[at:]
        assert r.text == want and r.n_chars == len(want)


def test_last_stage_and_run(spark, sf_dir, kept):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(corpus_pipeline.VOCABULARY), special_tokens={})
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: enc.encode_ordinary(r.text) for i, r in kept["secrets"].items()}


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_on_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    good = docs.where("doc_id < 40")
    kept = {r.doc_id: r.text for r in corpus_pipeline.keep_good(spark, good, sf_dir).collect()}
    text = max((t for t in kept.values() if "=" not in t), key=len)
    secret = text + " token=abcdefghijkl0123456789"
    rows = [(900, text), (900, text), (901, text), (None, text), (None, text), (902, None), (902, None), (903, ""), (904, secret), (905, item), (None, item), (906, "other words " * 40), (906, "quite different " * 40)]
    odd = spark.createDataFrame([(i, t, None, "src", len(t or ""), 7, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, secret_spans int, component_id string").select(*docs.columns, "secret_spans", "component_id")
    plain = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    ordered = lambda rows: sorted(rows, key=str)
    good = corpus_pipeline.keep_good(spark, odd, sf_dir)
    assert good.columns == odd.columns and plain(good) == ordered([r for r in rows if quality.chance(r[1], quality.train(odd, spark.read.parquet(f"{sf_dir}/labels.parquet"))) >= quality.ACCEPT])
    one = corpus_pipeline.keep_one_of_each(spark, odd, sf_dir)
    gone = {901, 904} if test_minhash.brute([(900, text), (904, secret)], 5, 80)[1][2] == 900 else {901}
    assert one.columns == odd.columns and plain(one) == ordered([(900, text), *[r for r in rows[3:] if r[0] not in gone and r[0] != 902], (902, None)])
    clean = corpus_pipeline.drop_contaminated(spark, odd, sf_dir)
    assert clean.columns == odd.columns and plain(clean) == ordered([r for r in rows if r[0] != 905])
    covered = corpus_pipeline.redact_secrets(spark, odd, sf_dir)
    assert covered.columns == odd.columns and plain(covered) == ordered([(i, text + " [secret]" if t == secret else t) for i, t in rows])
    assert all(r.n_chars == len(r.text or "") for r in covered.collect())
    assert corpus_pipeline.tokenize(spark, odd, sf_dir).count() == len(rows)
