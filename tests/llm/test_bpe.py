import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from sparquill.llm import bpe, catalog

PATH = public_tokenizers.path(catalog.VOCABULARY)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return bpe.Vocabulary.parse(f.read())


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_tokenizer_equals_library(vocabulary, library):
    own = bpe.Tokenizer(vocabulary, public_tokenizers.PATTERN)
    random_ = random.Random(1)
    alphabet = "ab é\n\t  \x1c\x1f\x85\xa0　'sl1234$#日本\U0001f600́\x00\x01  THEing"
    texts = ["".join(random_.choices(alphabet, k=random_.randint(0, 30))) for _ in range(3000)] + [None, "", "a" * 300, "<|endoftext|>"]
    import pyarrow as pa

    got = own.encode_all(pa.array(texts)).to_pylist()
    assert got == [library.encode_ordinary(t or "") for t in texts]


def test_appends_and_edits_are_exact(vocabulary):
    random_ = random.Random(2)
    for _ in range(60):
        data = bytes(random_.choices(b"thereion ae\xc3\xa9n", k=150))
        table = bpe.PrefixTable(vocabulary, data[:60])
        table.append(data[60:])
        assert table.ids() == vocabulary.merge(data)
        start, stop = sorted(random_.sample(range(150), 2))
        made = table.replace(start, stop, b"new")
        edited = data[:start] + b"new" + data[stop:]
        assert table.ids() == vocabulary.merge(edited) and table.last == bpe.PrefixTable(vocabulary, edited).last
        assert made <= len(edited) - start


def test_queries(spark, messy, nothing, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(messy.select("doc_id", "text"))
    digests = sorted(map(repr, bpe.token_digests(docs, PATH, public_tokenizers.PATTERN).collect()))
    from pyspark.sql import Row

    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append(repr(Row(doc_id=r["doc_id"], n_tokens=len(ids), ids_sha256=hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                             decoded_sha256=hashlib.sha256((r["text"] or "").encode()).hexdigest())))
    assert digests == sorted(want)
    encoded = bpe.encode_documents(messy, PATH, public_tokenizers.PATTERN)
    back = bpe.decode_documents(encoded, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(map(repr, back)) == sorted(repr(Row(doc_id=r["doc_id"], text=r["text"] or "")) for r in messy.collect())
    table = bpe.encode_table(messy, PATH, public_tokenizers.PATTERN, ("doc_id",)).collect()
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in table)
    assert bpe.token_digests(nothing, PATH, public_tokenizers.PATTERN).count() == 0


def test_a_task_leaves_no_answers_about_neighbours_behind():
    own = bpe.Tokenizer(bpe.Vocabulary({bytes([b]): b for b in range(256)} | {b"ab": 256}), bpe.CUT_PATTERN)
    assert own.encode("ab" * 50) == [256] * 50  # a long piece asks for pairs one by one
    own.forget()
    assert not own.vocabulary._fits and not own.vocabulary.pairs.used and not own._recent
