"""The pipeline on planted cases: what must go, what must stay, and what the last stage packs."""

import random

import corpus_pipeline
from wardcast.llm import packing, queries


def prose(seed, n=60):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 7))) for _ in range(n)]


def test_planted_cases(spark, tmp_path):
    words, passage = prose(1), prose(2, 30)
    clean = " ".join(words) + "."
    private = " ".join(prose(3))
    docs = [
        (1, clean),
        (2, clean),  # a copy
        (3, " ".join([*words[:30], "other", *words[31:]]) + "."),  # a near copy
        (4, " ".join(prose(4) + passage + prose(5)) + "."),  # a passage of the benchmark
        (5, f"{private} a.b@example.com."),
        (6, "too short."),
        (7, None),
        (8, " ".join(prose(6)) + ".\nHome | News | Sport | More"),
    ]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(passage))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [(1, clean), (5, f"{private} [EMAIL]."), (8, " ".join(prose(6)) + ".")]
    wanted = packing.pieces(spark.createDataFrame(left, "doc_id bigint, text string"), queries.vocabulary("word_bpe_49k.json"))
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(tuple(r) for r in wanted.select(*columns).collect())
    end = 0
    assert len({r["sequence_id"] for r in got}) == 1
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == end
        end += r["length"]
