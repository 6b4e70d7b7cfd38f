"""The pipeline's stages against plain versions of their decisions."""

import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from quiltframe.llm import tokens
from quiltframe.llm.queries import vocabulary

from .conftest import collected
from .test_exact import plain_mix
from .test_near import plain_groups
from .test_text_models import plain_scores

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    out, docs = [], spark.read.parquet(f"{DIR}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        to = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, DIR).write.parquet(to)
        made = spark.read.parquet(to)
        out.append((name, docs, made))
        docs = made
    return out


def test_order_and_columns(steps):
    assert [n for n, *_ in steps] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    for _, before, after in steps[:-1]:
        assert after.dtypes == before.dtypes


def test_quality_stage(spark, steps):
    _, before, after = steps[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect() if r.quality is not None}
    score = plain_scores(dict(collected(before)), labels)
    got = {r.doc_id for r in after.collect()}
    assert all((s >= 0.7) == (i in got) for i, s in score.items() if abs(s - 0.7) > 1e-3)
    assert 0 < after.count() < before.count()


def test_exact_stage(steps):
    _, before, after = steps[1]
    least = {}
    for i, t in sorted(collected(before)):
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    assert {i for i, _ in collected(after)} == set(least.values())


def test_near_stage(steps):
    _, before, after = steps[2]
    groups = plain_groups(collected(before), 5)
    assert {i for i, _ in collected(after)} == {i for i, (_, root) in groups.items() if i == root}


def test_mixing_stage(steps):
    _, before, after = steps[3]
    times = Counter(i for i, _ in collected(after))
    taken, size = plain_mix(before)
    want = {i: (2 * taken[i, t] + n) // (2 * n) for (i, t), n in size.items() if n}
    assert times == Counter({i: k for i, k in want.items() if k})


def test_packing_stage(steps):
    _, before, after = steps[4]
    lib = tokens.library(vocabulary())
    total = sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in collected(before))
    rows = after.collect()
    assert sum(r.length for r in rows) == total
    held = Counter()
    for r in rows:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048 and total / (2048 * len(held)) > 0.95


def test_run(spark):
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, DIR).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
