from pyspark.sql import functions as F

from strandkeep.llm import token_counts as T


def reference(pieces):
    from tokenizers import Tokenizer, models

    vocab = [("<unk>", 0.0), *pieces.items(), *((f"<0x{k:02X}>", -1e9) for k in range(256))]
    return Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))


def test_counts_equal_the_library(spark, tiny):
    pieces = T.read_vocabulary(T.VOCABULARY)
    tokenizer = reference(pieces)
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for row in T.count_tokens(docs).select("text", "n_tokens").collect():
        assert row.n_tokens == len(tokenizer.encode(T.SPACE + row.text.replace(" ", T.SPACE)).ids)


def test_ties_and_unknown_characters():
    pieces = {"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁a": -2.0, "aa": -2.0, "▁aab": -5.0}
    counter, tokenizer = T.Counter(pieces), reference(pieces)
    for text in ("aab", "ab ab", "aaaa", "b a", "aé\U0001f600b", "  ab   b ", "éé", "zz a"):
        assert counter.count(text) == len(tokenizer.encode(T.SPACE + text.replace(" ", T.SPACE)).ids), text


def test_odd_rows(odd_docs, no_docs):
    got = {(r.doc_id, r.n_tokens) for r in T.count_tokens(odd_docs).collect()}
    assert (7, 0) in got and (8, 0) in got and len(T.count_tokens(odd_docs).collect()) == 12
    assert T.count_tokens(no_docs).count() == 0


def test_a_column_of_that_name_is_replaced(odd_docs, no_docs):
    clash = odd_docs.withColumn("n_tokens", F.lit("own"))
    want = {(r.doc_id, r.text): r.n_tokens for r in T.count_tokens(odd_docs).collect()}
    got = T.count_tokens(clash)
    assert got.schema["n_tokens"].dataType.simpleString() == "bigint" and {(r.doc_id, r.text): r.n_tokens for r in got.collect()} == want
    assert want[7, None] == want[8, ""] == 0 and T.count_tokens(no_docs).count() == 0
