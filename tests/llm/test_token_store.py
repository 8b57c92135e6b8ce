from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lapidary.llm import token_store
from lapidary.llm.common import new_path
from cases import TEXTS, documents, empty


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_give_the_whole_texts_ids(tokenizer):
    rng, encoder = random.Random(2), token_store.Encoder()
    marks = [*"ab'sS Z9.,!\n\t\r\x0b\x0c\x1c\x85\xa0　 ​﻿\0", "é", "日", "🙂", "  ", "'ll", "<|endoftext|>", " \n"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    texts += [t for _, t in TEXTS] + ["a b\nc d", "a\n", "\na", " a", "a ", "a \nb", "a\n b", "a\n\nb"]
    for text, data in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(data, encoder.type).tolist() == ids_of(tokenizer, text), repr(text)


def test_round_trip(spark, tokenizer):
    rows = TEXTS + [(10_000 - i, f"document {i} " + "word " * (i % 50)) for i in range(3000)]
    path = new_path(spark, "tokens")
    docs = documents(spark, rows).repartition(5)
    token_store.write(docs, path)
    got = token_store.read_summary(spark, path).collect()
    ordered = sorted(got, key=lambda r: r.start)
    numbers = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert numbers == sorted(-1 if i is None else i for i, _ in rows)
    start = 0
    for r in ordered:
        assert r.start == start
        start += r.n_tokens
    wanted = sorted((str(i), len(ids_of(tokenizer, t)), zlib.crc32(np.array(ids_of(tokenizer, t), "<u4").tobytes())) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == wanted

    some = spark.createDataFrame([(6,), (7,), (7777,), (-5,)], "doc_id long")
    found = sorted((r.doc_id, r.ids) for r in token_store.read_documents(spark, path, some).collect())
    assert [i for i, _ in found] == [6, 7, 7, 7777]
    assert found[0][1] == ids_of(tokenizer, dict(rows)[6])
    blocks = spark.read.parquet(f"{path}/blocks").select("dictionary_hash", "shard", "block", "offsets", "doc_ids").collect()
    assert len({b.dictionary_hash for b in blocks}) == 1 and all(len(b.offsets) == len(b.doc_ids) + 1 for b in blocks)


def test_another_dictionary_is_refused(spark):
    paths = [new_path(spark, "tokens") for _ in range(2)]
    for n, path in enumerate(paths):
        token_store.write(documents(spark, [(i, f"text {n} {i} " * 30) for i in range(200)]), path)
    other = spark.read.parquet(f"{paths[1]}/dictionary").collect()
    spark.createDataFrame(other, "hash string, dictionary binary, id_type string").write.mode("overwrite").parquet(f"{paths[0]}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        token_store.read_summary(spark, paths[0]).collect()


def test_empty_table(spark):
    path = new_path(spark, "tokens")
    token_store.write(empty(spark), path)
    assert token_store.read_summary(spark, path).count() == 0


def test_added_tokens_in_a_text_have_the_librarys_ids(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng, mark = random.Random(8), "<|endoftext|>"
    marks = [mark, mark, "ab", "'s", " ", "  ", "\n", "\t", "é", ". "]
    texts = [mark, f"in{mark}side a word", f"a {mark} b", f"two  {mark}\n{mark}", "none <|end", mark * 2]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    path = new_path(spark, "tokens")
    token_store.write(documents(spark, list(enumerate(texts))), path)
    ids = spark.createDataFrame([(i,) for i in range(len(texts))], "doc_id long")
    got = {r.doc_id: r.ids for r in token_store.read_documents(spark, path, ids).collect()}
    assert 50256 in got[0]
    for i, text in enumerate(texts):
        assert got[i] == ids_of(library, text), repr(text)


def test_frequent_pieces_stay_known_and_words_have_the_librarys_ids(tokenizer):
    encoder, asked = token_store.Encoder(), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    encoder.tokenizer, encoder.remembered = Counted(), 200
    rng, marks = random.Random(4), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    letters = [chr(x) for x in range(0x41, 0x280) if chr(x).isalpha()]
    for n in range(100):
        words = ["".join(rng.choices(letters, k=rng.randrange(1, 8))) + "".join(rng.choices(marks, k=rng.randrange(4))) for _ in range(20)]
        texts = [" ".join(["a", "4x2", *words[:10], "4x2"]), "4x2 " + " ".join(words[10:])]
        for text, data in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(data, encoder.type).tolist() == ids_of(tokenizer, text), repr(text)
        assert len(encoder.known) <= encoder.remembered
    # Some 2,000 pieces went by; the one that came with all of them was encoded once.
    assert asked.count(" 4x2") == 1
