import os

import pytest
import regex

from loomwright.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary")
ODD = ["", " ", "<|endoftext|> is text", "a" * 3000, "  \n\n x\t", "🙂👨‍👩‍👧 é́ 中文", "\x00\x01 ok", "it's I'LL don't", "x" * 7 + "​", "1234567 3.14 ٣"]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.VOCABULARY)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_same_ids_as_the_public_library(small):
    import pyarrow.parquet as pq

    texts = [x for x in pq.read_table(f"{small}/documents.parquet").column("text").to_pylist() if x] + ODD
    trie, encode = T.Trie(T.Vocabulary(T.VOCABULARY)), reference()
    assert trie.encode(texts, regex.compile(T.PATTERN)) == [encode(x) for x in texts]


def test_dropping_the_trie_changes_nothing():
    v, p = T.Vocabulary(T.VOCABULARY), regex.compile(T.PATTERN)
    few, many = T.Trie(v, max_nodes=5), T.Trie(v)
    assert [few.encode([x], p) for x in ODD] == [many.encode([x], p) for x in ODD]


def test_rows(spark):
    df = spark.createDataFrame([(1, None, [9]), (2, "", [9]), (3, "hello", None), (3, "hello", None)], "doc_id bigint, text string, ids array<int>")
    assert sorted((r["doc_id"], r["ids"]) for r in T.token_ids(df, "doc_id", "text").collect()) == [(1, []), (2, []), (3, reference()("hello")), (3, reference()("hello"))]
    assert T.token_ids(df.limit(0), "doc_id", "text").count() == 0
