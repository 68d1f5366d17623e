"""The pipeline against a brute-force version, stage by stage on what each was
given, and the entry points."""

import zlib

import numpy as np
import pytest
from llm.helpers import classes, contamination, prose, quality_base

import corpus_pipeline
from corvid.llm.common import shared_path
from corvid.llm.mixing import mix_sources
from corvid.llm.query_token_files import tokenizer_path


def lines(seed, n):
    w = prose(seed, n).split()
    return "\n".join(" ".join(w[i:i + 10]).capitalize() + "." for i in range(0, n, 10))


@pytest.fixture(scope="module")
def sf_dir(spark):
    items = [(i, prose(9000 + i, 40)) for i in range(3)]
    docs = [(i, lines(i, 100 + i % 50), f"s{i % 4}") for i in range(120)]
    docs += [(200 + i, lines(i, 100 + i % 50).replace("a", "a", 1) + (" one more word" if i % 2 else ""), "s1") for i in range(20)]  # near copies
    docs += [(300 + i, lines(500 + i, 60) + "\n" + items[i % 3][1] + ".", "s2") for i in range(9)]  # contaminated
    docs += [(400 + i, " ".join(x + "###" for x in prose(i, 90).split()), "s3") for i in range(9)]  # junk
    docs += [(500, None, None), (501, "", "s0"), (502, "short text", None)]
    path = shared_path(spark, "pipeline-input")
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_match_brute_force(spark, sf_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, given = docs.columns, docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = shared_path(spark, "stage")
        before = docs
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns, name
        ids = sorted(r["doc_id"] for r in rows)
        if k == 0:
            base = {r["doc_id"]: quality_base(r["text"]) for r in given}
            want = [i for i, b in base.items() if b[0] >= 50 and 100 * b[4] <= 50 * b[0] and b[2] <= 0.1 * b[0]]
            assert ids == sorted(want)
        elif k == 1:
            found = classes([(r["doc_id"], r["text"]) for r in given])
            assert ids == sorted(i for i, (_, c) in found.items() if c == i)
        elif k == 2:
            hit = {r["doc_id"]: contamination(r["text"], items) for r in given}
            assert ids == sorted(i for i, (n, h, _) in hit.items() if not (h and 20 * h >= n))
            assert ids and len(ids) < len(given)
        elif k == 3:
            copies = {r["doc_id"]: r["mix_copies"] for r in mix_sources(before).collect()}
            assert ids == sorted(i for i, c in copies.items() for _ in range(c))
        else:
            from tokenizers import Tokenizer
            library, at, want = Tokenizer.from_file(tokenizer_path()), 0, []
            for r in sorted(given, key=lambda r: (r["doc_id"], r["text"])):
                data = np.asarray(library.encode(r["text"], add_special_tokens=False).ids + [1], "<u4").tobytes()
                want.append((r["doc_id"], at, len(data) // 4, zlib.crc32(data)))
                at += len(data) // 4
            assert sorted(map(tuple, rows)) == sorted(want)
        given = rows


def test_run_is_the_stages_in_turn(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 50
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "decontamination", "mixing", "token output"]


def test_an_empty_table_goes_through(spark, sf_dir):
    path = shared_path(spark, "pipeline-empty")
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []


def test_queries_are_registered():
    from corvid.llm.queries import QUERIES
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10
