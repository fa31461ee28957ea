import random
import uuid

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from loanlens.llm import token_counts, tokenizing
from loanlens.session import ensure_checkpoint_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


def new_cache(spark):
    return f"{ensure_checkpoint_dir(spark)}/cache-{uuid.uuid4().hex}"


def odd_texts():
    rnd = random.Random(3)
    signs = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u200b\ufeffab1'sé\u0301<|>.!Σ\0"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    return [*texts, "a  b", "<|endoftext|> a<|endoftext|>b <|startoftext|>", "don't 'LL", "１２３ 123 4567", "x" * 500,
            " " * 70_000 + "x", "word" * 30_000, "\n \t" * 20_000, "😀" * 9000, ""]


@pytest.mark.parametrize("name,split", [
    ("byte_bpe_50k.json", tokenizing.leading_space_chunks), ("word_bpe_49k.json", tokenizing.spaced_chunks)])
def test_chunked_counts_equal_whole_texts(name, split):
    path, texts = public_tokenizers.path(name), odd_texts()
    whole = tokenizing.encode_ids(tokenizing.load(path), texts)
    assert list(tokenizing.ChunkIds(path).counts(texts, split)) == [len(x) for x in whole]


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, None])
def test_ids_equal_the_librarys(pattern):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = tokenizing.ByteBpe(path, pattern)
    assert (encoder.fast is not None) == (pattern is not None)
    whole = tokenizing.encode_ids(encoder.tokenizer, odd_texts())
    assert [list(x) for x in encoder.encode(odd_texts())] == whole
    documents = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    texts = [t or "" for t in documents]
    assert [list(x) for x in encoder.encode(texts)] == tokenizing.encode_ids(encoder.tokenizer, texts)


def test_vocabularies_that_merge_otherwise_are_left_to_the_library(tmp_path):
    """A token that its own merges cannot make, and ids in another order than merges."""
    signs = list(tokenizing.BYTE_SIGNS.values())
    cases = {
        "a token no word reaches": (["ab", "bc", "abc"], [("a", "b"), ("b", "c"), ("a", "bc")]),
        "ids out of order": (["bc", "ab"], [("a", "b"), ("b", "c")]),
        "fine": (["ab", "abc"], [("a", "b"), ("ab", "c")])}
    for name, (more, merges) in cases.items():
        vocab = {t: i for i, t in enumerate([*signs, *more])}
        own = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        path = str(tmp_path / f"{name}.json")
        own.save(path)
        encoder = tokenizing.ByteBpe(path, public_tokenizers.PATTERN)
        assert (encoder.fast is None) == (name != "fine")
        texts = ["abc", "xabcab bc", "cab abc"]
        assert [list(x) for x in encoder.encode(texts)] == tokenizing.encode_ids(own, texts)


def test_cache_starts_over_when_full(monkeypatch):
    monkeypatch.setattr(tokenizing, "CACHE_ENTRIES", 5)
    chunks = tokenizing.ChunkIds(PATH)
    for i in range(5):
        texts = [f"alpha{i} beta{i} gamma{i}", "alpha beta"]
        want = [len(x) for x in tokenizing.encode_ids(chunks.tokenizer, texts)]
        assert list(chunks.counts(texts, tokenizing.spaced_chunks)) == want


def test_counts_and_cache(spark):
    texts = [None, "", "Hello  World", " hello world\n", "Hello World", "<|endoftext|> x", "w " * 5000]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, digest string")
    cache, tok = new_cache(spark), Tokenizer.from_file(PATH)
    out = token_counts.count_tokens(docs, PATH, cache, drops_space=True)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 2048)
        assert got[i].digest == "k"
    # null and empty share a content, so do the spacings of "Hello World"; case is content
    assert spark.read.parquet(cache).count() == 5
    more = docs.union(spark.createDataFrame([(9, "brand new", "k")], docs.schema))
    token_counts.count_tokens(more, PATH, cache, drops_space=True).collect()
    assert spark.read.parquet(cache).count() == 6  # only the miss was encoded
    spark.sql(f"select 'd' digest, 'other tokenizer' tokenizer, 5L n_tokens").write.mode("append").parquet(cache)
    assert token_counts.count_tokens(more, PATH, cache, drops_space=True).where("n_tokens is null").isEmpty()


def test_stored_counts_are_used(spark):
    cache, version = new_cache(spark), token_counts.tokenizer_digest(PATH)
    docs = spark.createDataFrame([(1, "stored text")], "doc_id long, text string")
    (docs.selectExpr("sha2(text, 256) digest", f"'{version}' tokenizer", "77L n_tokens").write.parquet(cache))
    assert token_counts.count_tokens(docs, PATH, cache, drops_space=True).first().n_tokens == 77


def test_only_a_missing_cache_is_an_empty_one(spark):
    assert token_counts.read_cache(spark, new_cache(spark)).isEmpty()
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        token_counts.read_cache(spark, "nosuchstore://cache")


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_tokens string")
    out = token_counts.count_tokens(empty, PATH, new_cache(spark), drops_space=True)
    assert out.count() == 0 and dict(out.dtypes)["n_tokens"] == "bigint"
