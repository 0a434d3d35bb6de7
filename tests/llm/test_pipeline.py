"""The pipeline against its stages' definitions in plain Python, and each stage by itself."""

import importlib
import struct
import zlib

import public_tokenizers
from conftest import FOLDER

import corpus_pipeline
from vacantia.llm import leaks, mixing, quality, token_files


def test_stages(spark):
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs, kept = source, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, FOLDER), "stage")
        assert out.columns == source.columns, name
        before, after = ([r["doc_id"] for r in t.collect()] for t in (docs, out))
        assert set(after) <= set(before), name
        kept.append((set(before), after))
        docs = out
    rows = {r["doc_id"]: r for r in source.collect()}

    measured = {r["doc_id"]: r["q_base_failed"] for r in quality.assess(source).collect()}
    assert not {i for i in kept[0][1] if measured[i]}
    hosts = {r["source"] for r in quality.rejected_hosts(quality.measures(source)).withColumnRenamed("host", "source").collect()}
    assert set(kept[0][1]) == {i for i, bad in measured.items() if not bad and rows[i]["source"] not in hosts}

    brute = importlib.import_module("test_similar").brute
    groups = {}
    for key, _, component in brute([(i, rows[i]["text"]) for i in sorted(kept[1][0])]):
        groups.setdefault(component, []).append(key)
    assert sorted(kept[1][1]) == sorted(min(g) for g in groups.values())

    items = [leaks.normal(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaking = {i for i in kept[2][0] if any(x and x in leaks.normal(rows[i]["text"]) for x in items)}
    assert not leaking & set(kept[2][1]) and set(kept[2][1]) == kept[2][0] - leaking

    found = {r["key"]: r["copies"] for r in mixing.sample(docs_before_mix(spark, kept[3][0])).collect()}
    counted = {i: kept[3][1].count(i) for i in kept[3][0]}
    assert counted == found

    encoder = token_files.Encoder(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    result = corpus_pipeline.run(spark, FOLDER)
    start, want = 0, []
    for i in sorted(kept[3][1]):
        ids = [*encoder.whole([rows[i]["text"]])[0], token_files.END]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in result.collect()) == want


def docs_before_mix(spark, keys):
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return source.filter(source["doc_id"].isin(sorted(keys)))
