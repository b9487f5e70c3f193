"""The pipeline's stages, each against what it should do to its input."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from meterlake.llm.bpe import ranks
from meterlake.llm.secrets import BASE_RULES

from .conftest import BASE, DATA, ROWS, SCHEMA, plain
from .test_neardup import brute
from .test_text_scans import brute_tokens, spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_the_sample(spark, sample):
    docs = sample
    done = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(DATA)).cache()
        done[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == COLUMNS
    before = {r["doc_id"]: r for r in sample.collect()}
    language = {r["doc_id"] for r in done["language"]}
    assert all(any(c.isalpha() for c in before[d]["text"]) for d in language)
    clean = [d for d, r in before.items() if r["lang"] is not None and len(r["text"].split()) > 20]
    assert len(language & set(clean)) >= 0.98 * len(clean)
    rows = [(r["doc_id"], r["text"]) for r in done["language"]]
    assert {r["doc_id"] for r in done["near_duplicate"]} == {d for d, _, c, _ in brute(rows) if d == c}
    assert {r["doc_id"] for r in done["secrets"]} == {r["doc_id"] for r in done["near_duplicate"]}
    for r in done["secrets"]:
        assert r["n_chars"] == len(r["text"]) and not spans(r["text"], BASE_RULES)
    held = {(r["doc_id"], r["text"]) for r in done["secrets"]}
    times = {}
    for r in done["mixture"]:
        assert (r["doc_id"], r["text"]) in held
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3
    got = [(r["doc_id"], r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest()) for r in done["tokens"]]
    assert sorted(got) == sorted(t[:3] for t in brute_tokens([(r["doc_id"], r["text"]) for r in done["mixture"]]))


def test_stages_on_edges(spark, edge, none, clashing):
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
        assert plain(stage(spark, edge, "")) == plain(stage(spark, clashing, "")), name
    kept = [(r["doc_id"], r["text"]) for r in pipeline.near_duplicate(spark, edge, "").collect()]
    ids = [d for d, _ in kept]
    assert ids.count(2) == 0 and ids.count(1) == 1 and {4, 5, 6, 9, None} <= set(ids)
    assert len(kept) == len(set(kept)) and len(kept) < len(ROWS)


def test_one_of_each_group(spark):
    """Repeated rows, one id with near-equal texts, null ids: a group leaves one row; rows without words all stay."""
    rows = [(1, BASE), (1, BASE), (1, BASE + " too"), (None, BASE), (None, "another text of six words here"), (None, "another text of six words here"), (3, ""), (3, ""), (4, None), (4, None)]
    df = spark.createDataFrame([(d, t, f"l{i}", None, i) for i, (d, t) in enumerate(rows)], SCHEMA)
    got = [tuple(r)[:3] for r in pipeline.near_duplicate(spark, df, "").collect()]
    assert len([r for r in got if r[1]]) == 2 and len([r for r in got if not r[1]]) == 4
    assert [r for r in got if r[0] == 1][0][1] in (BASE, BASE + " too") and sum(r[0] == 1 for r in got) == 1
    assert (None, "another text of six words here", "l4") in got


def test_run(spark):
    got = pipeline.run(spark, str(DATA))
    assert got.columns == ["doc_id", "lang", "source", "shard", "place", "n_tokens", "ids"] and got.count() > 50
    top = max(ranks(__import__("public_tokenizers").path("byte_bpe_50k.tiktoken")).values())
    assert all(np.frombuffer(r["ids"], "<u4").max(initial=0) <= top and re.fullmatch(r"\w+", r["lang"]) for r in got.collect())


def test_tokens_keep_the_training_order(spark, sample, tmp_path):
    mixed = pipeline.mixture(spark, sample, "")
    path = str(tmp_path / "mixed")
    mixed.repartitionByRange(7, "n_chars").sortWithinPartitions(F.desc("n_chars"), "doc_id").write.parquet(path)
    files = sorted((tmp_path / "mixed").glob("part-*.parquet"))
    want = [(r["doc_id"], r["n_chars"]) for f in files for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    got = pipeline.tokens(spark, spark.read.parquet(path), "").orderBy("shard", "place").collect()
    assert len(files) > 3 and [r["doc_id"] for r in got] == [d for d, _ in want]
    assert len({(r["shard"], r["place"]) for r in got}) == len(got)
