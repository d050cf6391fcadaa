"""Token ids, token files and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.frames import docs_frame, odd_docs
from tidepanel.llm import packing, tokenfile
from tidepanel.llm.queries import tokenizer_path
from tidepanel.llm.tokens import ENCODED_BYTES, Encoder, encodable

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def expected(name, df):
    """Per row doc_id, ids with the end id."""
    t = library(name)
    return [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_encoder_equals_library(name):
    r = random.Random(3)
    parts = ["a", "é", "é", "Word", " ", "  ", "\n", " \n", "\xa0", "\x1c", "'s", "don't", "12", "½", ",", "!!", "<|endoftext|>", "日本", "_", "%%%", "|", "İ", "Ⅷ", "ſ", "µ", "ª"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(4000)]
    t, e = library(name), Encoder(tokenizer_path(name), entries=500)
    for at in range(0, len(texts), 200):
        for text, ids in zip(texts[at : at + 200], e.encode(texts[at : at + 200]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def check_packing(df, window):
    pieces = packing.pack(df, tokenizer_path(WORD), window, keep_ids=True).collect()
    want = sorted(expected(WORD, df), key=str)
    by_doc = {}
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(bytes(p.ids)) and len(p.ids) == 4 * p.length
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    rebuilt = []
    for (doc_id, n), parts in by_doc.items():
        parts.sort(key=lambda p: (p.start, bytes(p.ids)))
        copies = sum(p.start == 0 for p in parts)
        ids = [np.frombuffer(bytes(p.ids), "<u4").tolist() for p in parts[::copies]]
        whole = [x for part in ids for x in part]
        assert len(whole) == n and len(parts) % copies == 0
        rebuilt += [(doc_id, whole)] * copies
    assert sorted(rebuilt, key=str) == want
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        end = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
        assert end <= window
    return len(sequences), sum(p.length for p in pieces)


def test_long_texts_are_encoded_few_at_a_time():
    """The chunks of 256 long texts at once would take hundreds of megabytes."""
    texts = [f"w{k} " * 5_000 for k in range(300)] + [None, "", "x" * (2 * ENCODED_BYTES)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    cut = list(encodable(iter([batch]), 1))
    assert [t for b in cut for t in b.column(1).to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= ENCODED_BYTES for b in cut)


def test_rare_words_stay_known(monkeypatch):
    e = Encoder(tokenizer_path(WORD))
    letters = [chr(97 + k) for k in range(26)]
    words = ["".join(letters[k // 26**p % 26] for p in range(4)) for k in range(430_000)]
    texts = [" ".join(words[at : at + 1000]) for at in range(0, len(words), 1000)]
    first = [e.encode([t])[0] for t in texts][0]
    monkeypatch.setattr(e, "_model", None)  # nothing is encoded again
    assert e.encode(texts[:1]) == [first]


def test_packing_of_odd_documents(spark):
    check_packing(odd_docs(spark), 64)
    check_packing(odd_docs(spark), 4096)


def test_packing_leaves_little_room(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sequences, tokens = check_packing(docs, 4096)
    assert tokens > 0.97 * sequences * 4096


def test_packing_of_one_hot_length(spark):
    n, tokens = check_packing(docs_frame(spark, ["a b c"] * 300), 64)
    assert (n, tokens) == (19, 1200)


def test_plan_uses_every_piece_once():
    r = np.random.default_rng(5)
    histogram = np.bincount(r.integers(1, 129, 5000), minlength=129)
    used = np.zeros(129, int)
    for p in packing.plan(histogram, 128):
        assert sum(p.lengths) <= 128 and p.repeats > 0
        np.add.at(used, list(p.lengths), p.repeats)
    assert (used == histogram).all()


def test_solve_finds_the_nonnegative_minimum():
    columns = [(1, 3), (2, 2), (4,)]
    histogram = np.array([0, 5, 6, 5, 7])
    assert np.allclose(packing.solve(histogram, columns, 3000), [5, 3, 7], atol=1e-3)


def test_token_files_round_trip(spark):
    for df in (odd_docs(spark), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        manifest = tokenfile.write_token_files(df, tokenizer_path(BYTE), sequence=64).cache()
        got = sorted(tokenfile.read_token_files(manifest).collect(), key=lambda r: r.start)
        want = sorted(expected(BYTE, df), key=lambda x: (x[0] is not None, x[0] or 0))
        start = 0
        assert len(got) == len(want)
        for row, (doc_id, ids) in zip(got, want, strict=True):
            assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), crc(ids))
            start += len(ids)
        # random access: equal-length sequences, views into the file, masked at the end
        first = manifest.orderBy("start").first()
        file = tokenfile.TokenFile(first.path)
        ids, mask = file.sequence(0)
        assert len(ids) == 64 and not ids.flags.owndata and mask[: min(64, first.n_tokens)].all()
        bits = file.mask_bits(0)
        assert bits.dtype == np.uint8 and len(bits) == 8 and not bits.flags.owndata and not bits.flags.writeable
        assert np.shares_memory(bits, file.mask_bits(0)) and np.shares_memory(ids, file.sequence(0)[0])
        last, mask = file.sequence((first.n_tokens - 1) // 64)
        assert mask.sum() == (first.n_tokens - 1) % 64 + 1


def test_empty_tables(spark):
    none = docs_frame(spark, ["x"]).where("doc_id < 0")
    assert packing.pack(none, tokenizer_path(WORD)).count() == 0
    assert tokenfile.read_token_files(tokenfile.write_token_files(none, tokenizer_path(BYTE))).count() == 0
