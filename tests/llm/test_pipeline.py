"""The pipeline's stages against brute-force versions on the smallest tables."""

import struct
import zlib
from collections import Counter

import pyarrow as pa

import corpus_pipeline
from fieldmark.llm.bpe import vocabulary_path
from fieldmark.llm.common import settings
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_odd_sketch import brute as near

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, [tuple(r) for r in docs.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "tokens"]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if number < 4:
            assert docs.columns == columns
            got = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        if name == "language_id":
            want = {d for d, t in rows if any(c.isalpha() for c in t or "")}
        elif name == "near_dedup":
            want = {d for d, _, _, kept in near(rows, 5, 80) if kept}
        elif name == "decontaminate":
            want = {d for d, _ in rows} - {d for d, _ in leaks(rows, items)}
        elif name == "mix":
            before, taken = dict(rows), Counter()
            for d, t in got:
                taken[d] += len(t.split())
                assert not Counter(t.split()) - Counter(before[d].split())
            assert all(n <= 2 * len(before[d].split()) for d, n in taken.items())
            total = sum(len(t.split()) for _, t in rows)
            assert abs(sum(taken.values()) - 1.5 * total) < 0.03 * total
            rows = got
            continue
        else:
            found = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in docs.collect())
            want = Counter()
            for d, t in rows:
                ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
                want[d, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
            assert found == want
            continue
        assert len(got) == len(want) and {d for d, _ in got} == want
        rows = got


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


def test_what_a_stage_returns_is_evaluated_in_small_batches(spark):
    docs = spark.range(0, 1500, 1, 1).selectExpr("id as doc_id", "repeat('some words ', 2000) as text", "'en' as lang", "'s' as source", "22000L as n_chars")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    with settings(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(64 << 20), spark__sql__parquet__columnarReaderBatchSize="4096"):
        _, stage = corpus_pipeline.STAGES[0]
        found = stage(spark, docs, SF).mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]
        assert found < 12 << 20 and int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512
