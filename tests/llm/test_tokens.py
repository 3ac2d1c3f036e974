"""Token counts, token files: against the library, from a warm cache, and back from disk."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stepwright.llm import token_counts, token_files
from stepwright.llm.tokens import Encoder, file_of
from tests.llm.odd import by_text, empty, rows_of

BYTES, LOWER = file_of("byte_bpe_50k.json"), file_of("word_bpe_49k.json")
ODD = ["", " ", "\n\n x", "it's  'S 'LL don't <|endoftext|> a<|startoftext|>b", "x́ é", "²³ ½",
       "İstanbul ŉ ſ K Å", "a\x1cb\x85c\xa0d", "日本語 текст", "  lead", "trail  ", "a\r\n\tb",
       "ab12cd 3.14", "“q” – …", "$$$ ## !!", "ÀÉ Ÿ ž Ž", "'s't'm'd x's y'LL"]


@pytest.mark.parametrize("path", [BYTES, LOWER])
def test_encoder_equals_the_library(path, small_rows):
    mine, library = Encoder(path), Tokenizer.from_file(path)
    assert mine.words is not None
    texts = [t for _, t in small_rows] + ODD
    for text, wanted in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert mine.ids(text).tolist() == wanted.ids
        assert mine.count(text) == len(wanted.ids)


LETTERS = st.text(st.sampled_from("aB zß'sStTmMdl\n\t 1é́.,<|>$ Ñ "), max_size=40)
ENCODERS = {p: (Encoder(p), Tokenizer.from_file(p)) for p in (BYTES, LOWER)}


@given(LETTERS)
@settings(max_examples=300, deadline=None)
def test_any_text_equals_the_library(text):
    for mine, library in ENCODERS.values():
        assert mine.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_counts_of_odd_rows(odd_docs, tmp_path):
    library = Tokenizer.from_file(BYTES)
    found = token_counts.count_tokens(odd_docs, BYTES, str(tmp_path / "cache"))
    wanted = [(i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in by_text()]
    assert rows_of(found, "doc_id", "n_bytes", "n_tokens") == sorted(
        wanted, key=lambda r: [(x is not None, x) for x in r])


def test_cache_is_used_and_holds_each_text_once(spark, odd_docs, tmp_path):
    path = str(tmp_path / "cache")
    first = rows_of(token_counts.count_tokens(odd_docs, BYTES, path), "doc_id", "n_tokens")
    table = spark.read.parquet(path)
    assert table.count() == table.select("content").distinct().count() == len({t for _, t in by_text()})
    assert rows_of(token_counts.count_tokens(odd_docs, BYTES, path), "doc_id", "n_tokens") == first
    assert spark.read.parquet(path).count() == table.count()
    # another tokenizer has counts of its own
    token_counts.count_tokens(odd_docs, LOWER, path).collect()
    assert spark.read.parquet(path).select("tokenizer").distinct().count() == 2
    # what is stored is what is returned
    from pyspark.sql import functions as F
    forged = str(tmp_path / "forged")
    spark.read.parquet(path).withColumn("n_tokens", F.lit(-7).cast("bigint")).write.parquet(forged)
    assert {r[1] for r in rows_of(token_counts.count_tokens(odd_docs, BYTES, forged), "doc_id", "n_tokens")} == {-7}


def test_counts_of_no_rows(spark, tmp_path):
    assert token_counts.count_tokens(empty(spark), BYTES, str(tmp_path / "cache")).count() == 0


def wanted_files(rows):
    library, start, out = Tokenizer.from_file(LOWER), 0, []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_hold_all_ids_in_order(spark, small, small_rows, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(small, path, LOWER, 2)
    assert rows_of(token_files.read_digests(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == \
        wanted_files(sorted(small_rows))
    # one document through dictionary and offset index
    digest, dictionary = token_files.read_dictionary(spark, path)
    assert dictionary
    block = spark.read.parquet(f"{path}/blocks").orderBy("part", "block").first()
    assert block.dictionary_sha256 == digest
    reader = token_files.Reader(dictionary, block.width, bytes(block.offsets), bytes(block.payload))
    text = dict(small_rows)[block.doc_ids[3]]
    assert reader.get(3).tolist() == [*Tokenizer.from_file(LOWER).encode(text, add_special_tokens=False).ids, 2]
    full = token_files.read_token_files(spark, path).where("doc_id = 5").first()
    assert len(full.ids) == full.n_tokens


def test_files_of_odd_rows(spark, odd_docs, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(odd_docs, path, LOWER, 2)
    found = token_files.read_digests(spark, path).orderBy("start").collect()
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == len(by_text())
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    assert sorted((r.n_tokens, r.ids_crc32) for r in found) == sorted((n, c) for _, _, n, c in wanted_files(by_text()))


def test_files_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(empty(spark), path, LOWER, 2)
    assert token_files.read_digests(spark, path).count() == 0


def test_another_dictionary_is_refused(spark, small, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(small, path, LOWER, 2)
    other = spark.createDataFrame([("0" * 64, bytearray(b"abc"))], "sha256 string, dictionary binary")
    other.write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError):
        token_files.read_dictionary(spark, path)




def test_a_warm_cache_encodes_and_moves_no_text(spark, odd_docs, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    first = rows_of(token_counts.count_tokens(odd_docs, BYTES, path), "doc_id", "n_tokens")

    def never(*_):
        raise AssertionError("nothing is missing")

    monkeypatch.setattr(token_counts, "encode_misses", never)
    again = token_counts.count_tokens(odd_docs, BYTES, path)
    assert rows_of(again, "doc_id", "n_tokens") == first
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan
    for line in plan.splitlines():  # the text is hashed in the scan and goes no further
        if "Exchange" in line or "Join" in line:
            assert "text#" not in line


def test_a_full_map_and_few_misses_change_nothing(spark, odd_docs, tmp_path, monkeypatch):
    wanted = rows_of(token_counts.count_tokens(odd_docs, BYTES, str(tmp_path / "one")), "doc_id", "n_tokens")
    monkeypatch.setattr(token_counts, "MAP_BITS", 6)  # lets nearly all through
    path = str(tmp_path / "two")
    token_counts.count_tokens(odd_docs.where("doc_id > 8"), BYTES, path).collect()
    found = token_counts.count_tokens(odd_docs.unionByName(odd_docs).repartition(5), BYTES, path)
    assert rows_of(found, "doc_id", "n_tokens") == sorted(
        wanted + wanted, key=lambda r: [(x is not None, x) for x in r])
    table = spark.read.parquet(path)
    assert table.count() == table.select("content").distinct().count()


def test_words_in_use_survive_a_full_memo(monkeypatch):
    monkeypatch.setattr("stepwright.llm.tokens.MEMO_WORDS", 100)
    for path, column in ((LOWER, "ids"), (BYTES, "count")):
        mine, library = Encoder(path), Tokenizer.from_file(path)
        text = "\n".join(f"The cat's x{i} 'll {i}, don't—stop\tthe" for i in range(2000))
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(mine.ids(text)) == ids and mine.count(text) == len(ids)
        memo, asked = mine.ids_of if column == "ids" else mine.counts_of, []
        found = type(memo).found
        monkeypatch.setattr(type(memo), "found", lambda self, word: (asked.append(word), found(self, word))[1])
        getattr(mine, column)("word " + text)
        assert sum(w.strip() == "the" for w in asked) <= 1 and sum(w.strip() == "cat's" for w in asked) <= 1
        monkeypatch.undo()
        monkeypatch.setattr("stepwright.llm.tokens.MEMO_WORDS", 100)
