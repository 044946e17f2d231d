import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabloom.llm import packing as P
from tests.llm.fixtures import awkward, awkward_rows, empty


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.default_tokenizer())


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def _check(pieces, documents, size):
    """Pieces tile the documents, sequences have no gap and no padding; returns ids per sequence."""
    held = defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == size or (at < size and at & (at - 1) == 0)
    # Rows of one id and token count may be several documents: their pieces fill whole copies.
    got = defaultdict(list)
    for r in pieces:
        got[r["doc_id"], r["doc_tokens"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    want = defaultdict(list)
    for doc_id, ids in documents:
        want[doc_id, len(ids)].append(ids)
    assert set(got) == set(want)
    for key, parts in got.items():
        seen = sorted((start + i, x) for start, ids in parts for i, x in enumerate(ids))
        assert seen == sorted((i, x) for ids in want[key] for i, x in enumerate(ids))
    return {k: sum(n for _, n in parts) for k, parts in held.items()}


def test_words_apart_encode_as_the_library_does(library):
    rnd = random.Random(1)
    pool = list("abcXYZ'éß \n\t  .,!?-_0123") + ["'s", "don't", "İ", "ΣΑΣ", "é", "́", "你好", "\U0001f600", "\x1c", " ", "ﬁ", "<|endoftext|>", "’"]
    words = P._words(P.default_tokenizer())
    for _ in range(2000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30)))
        assert np.frombuffer(words.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_latin_character_as_in_the_library(library):
    words = P._Words(library)
    rnd = random.Random(4)
    latin = [chr(c) for c in range(0x21, 0x2B0)]
    for c in latin:
        for text in (c, f"a{c}b", f"{c}{c}1", f"'{c}"):
            assert np.frombuffer(words.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    for _ in range(3000):
        text = "".join(rnd.choices(latin, k=rnd.randint(1, 8)))
        assert np.frombuffer(words.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("size, windows, merge", [(2048, 64, 64), (64, 2, 2), (16, 1, 3)])
def test_pieces_and_sequences(spark, library, size, windows, merge):
    rows = [(i, t) for i, t, *_ in awkward_rows()]
    rows += [(100 + i, "the quick brown fox " * random.Random(i).randint(0, 30)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    df = df.withColumn("start", F.lit("x")).withColumn("task", F.lit(1)).withColumn("a.b", F.lit(1))
    pieces = P.pack(df, size, windows, merge).collect()
    filled = _check(pieces, [(i, _ids(library, t)) for i, t in rows], size)
    assert sum(n < size for n in filled.values()) <= size.bit_length()


def test_few_documents_are_cut(spark):
    rows = [(i, "the " * random.Random(i).randint(1, 900)) for i in range(2000)]
    pieces = P.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert len(pieces) < 1.3 * len(rows)


def test_query_and_empty_table(spark, library):
    assert P.pack(empty(spark)).count() == 0
    got = P.op12_packing(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = {r["doc_id"]: _ids(library, r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    at = defaultdict(int)
    for r in sorted(got.collect(), key=lambda r: (r["doc_id"], r["start"])):
        ids = docs[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids)
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        at[r["doc_id"]] += r["length"]
    assert at == {i: len(ids) for i, ids in docs.items()}


def test_nulls_are_kept(spark):
    pieces = P.pack(awkward(spark)).collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] in (4, 5, 6)) == 3
    assert sum(r["start"] == 0 for r in pieces) == len(awkward_rows())
