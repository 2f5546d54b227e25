"""Token files and flat token streams against encoding each text by itself."""

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fieldmark.llm import token_scan, token_store
from fieldmark.llm.bpe import WordEncoder, vocabulary_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


AWKWARD = ["", None, "a b\x85c  d", "<|endoftext|> x<|endoftext|>", "́ é 가", "IT'S don't 12 345", "x" * 50_000, " \n", "ΑΣ Σ. ΣΑΣ", "a\x1cb\x1fc"]


def test_words_give_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(3)
    texts = AWKWARD + ["".join(rng.choice("ab éß'\n\t 　́!9<|>Σσ‍漢") for _ in range(200)) for _ in range(200)]
    ids, offs = WordEncoder().encode(pa.array(texts), 1)
    for k, t in enumerate(texts):
        assert ids[offs[k] : offs[k + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids + [1]


def expected(rows, tokenizer):
    out, start = [], 0
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_round_trip(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in token_store.round_trip(docs).collect())
    assert got == expected(rows, tokenizer)


def test_round_trip_of_awkward_rows(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(3, "again"), (None, "no id"), (4, "́ é 가")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, shard int, ids string")
    got = token_store.round_trip(docs).collect()
    assert len(got) == len(rows)
    lengths = sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens) for r in got)
    at = 0
    for _, start, n in lengths:
        assert start == at
        at += n
    assert token_store.round_trip(docs.limit(0)).count() == 0


def test_file_layout(spark, tmp_path):
    path = token_store.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), str(tmp_path / "t"))
    file = next((tmp_path / "t").glob("part-*.parquet"))
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    ids = next(c for name, c in columns.items() if name.startswith("ids"))
    assert ids.has_dictionary_page and columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    assert path and token_store.read_tokens(spark, path, ids=False).columns == ["doc_id", "start", "n_tokens"]


def test_counts_of_documents(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, "no id"), (5, "IT'S don't 12 345")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, file string")
    tokenizer.encode_special_tokens = True
    want = sorted(((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in rows), key=repr)
    tokenizer.encode_special_tokens = False
    assert sorted((tuple(r) for r in token_scan.count_documents(docs).collect()), key=repr) == want
    assert token_scan.count_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("step", [1, 3, 7, 1000])
def test_blocks_are_stitched(spark, step):
    rng = random.Random(step)
    rows, want = [], []
    for file in range(4):
        lengths = [rng.choice([0, 0, 1, 5, 30]) for _ in range(40)]
        stream = [x for n in lengths for x in [7] * n + [9]] + [7] * (file * 2)
        want += [(file, i, n, True) for i, n in enumerate(lengths)] + [(file, 40, file * 2, False)] * (file > 0)
        data = np.array(stream, "<u2")
        rows += [(file, k, bytearray(data[at : at + step].tobytes())) for k, at in enumerate(range(0, len(data), step))]
    rows.append((9, 0, bytearray()))
    rng.shuffle(rows)
    blocks = spark.createDataFrame(rows, "file long, block long, content binary")
    assert sorted(tuple(r) for r in token_scan.count_tokens(blocks, separator=9).collect()) == sorted(want)


def test_plain_binary_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([5, 5, 9, 9, 5, 9], "<u2").tobytes())
    blocks = token_scan.binary_blocks(spark, str(tmp_path), block_tokens=2)
    got = sorted(tuple(r)[1:] for r in token_scan.count_tokens(blocks, separator=9).collect())
    assert got == [(0, 2, True), (1, 0, True), (2, 1, True)]


def test_flat_file_over_two_gigabytes(spark, tmp_path):
    from fieldmark.llm import token_scan

    n = (1 << 30) + 5000
    with open(tmp_path / "long one.bin", "wb") as f:  # sparse
        f.truncate(2 * n)
        for at in (10, 1 << 30):
            f.seek(2 * at)
            f.write((token_scan.END_OF_TEXT).to_bytes(2, "little"))
    got = token_scan.count_tokens(token_scan.binary_blocks(spark, str(tmp_path), block_tokens=1 << 22)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.n_tokens, r.ended) for r in got] == [(0, 10, True), (1, (1 << 30) - 11, True), (2, 4999, False)]


def test_frequent_words_are_encoded_once_and_marks_cost_no_text(tokenizer):
    words = WordEncoder(remembered=40)
    seen, texts = [], [f"Often often, OFTEN%%% naïve... {' '.join('abcdefghij'[k] + c for c in 'klmnopqrstuvwxyz')}" for k in range(10)]

    class Model:
        def tokenize(self, text):
            seen.append(text)
            return tokenizer.model.tokenize(text)

    words.model, words._others = Model(), lambda rest: [pytest.fail(f"{w} was encoded as a text") for w in rest]
    for t in texts:
        ids, _ = words.encode(pa.array([t]), 1)
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [1]
    assert seen.count("often") == seen.count("%%%") == 1 and len(words.known) + len(words.earlier) < 80
