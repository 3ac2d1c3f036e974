"""The pipeline: every stage against a brute-force version on its own input, and odd rows through all of it."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from stepwright.llm import decontamination as dec
from stepwright.llm import mixing, toxicity
from stepwright.llm.common import remainder
from tests.conftest import SMALL
from tests.llm.odd import by_text, odd
from tests.llm.test_tokens import wanted_files

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage over the small table."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SMALL).write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == list(stages)
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == COLUMNS


def test_toxic_documents_go(spark, stages):
    docs, kept = stages["toxicity"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    matcher = toxicity.learn(docs, labels.where(remainder(F.col("doc_id"), 5) != 0)).matcher()
    wanted = [r.doc_id for r in docs.collect() if matcher.score(matcher.density(toxicity.fold(r.text or ""))[0]) < 0.5]
    assert ids(kept) == sorted(wanted)
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(toxic & set(wanted)) <= 0.2 * len(toxic) and len(clean & set(wanted)) >= 0.97 * len(clean)


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_one_of_each_group_stays(stages):
    docs, kept = stages["near_dedup"]
    sets = {r.doc_id: shingles(r.text or "") for r in docs.collect()}
    kept = set(ids(kept))

    def similar(a, b):
        union = len(sets[a] | sets[b])
        return len(sets[a] & sets[b]) / union if union else 1.0

    order = sorted(sets)
    pairs = {(a, b): similar(a, b) for i, a in enumerate(order) for b in order[i + 1:] if sets[a] & sets[b]}
    near = [p for p, s in pairs.items() if s >= 0.8]
    assert sum(a in kept and b in kept for a, b in near) <= 0.03 * len(near)
    least = min(order)
    for d in set(order) - kept:  # what went is close to another document, which has a smaller id or a way to one
        assert any(s >= 0.75 for p, s in pairs.items() if d in p) or not sets[d]
    assert least in kept and len(kept) < len(order)


def test_contaminated_documents_go(spark, stages):
    docs, kept = stages["decontamination"]
    runs = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        words = dec.words_of(r.text)
        runs |= {tuple(words[k:k + 13]) for k in range(len(words) - 12)}
    wanted = []
    for r in docs.collect():
        words, hit = dec.words_of(r.text or ""), set()
        for k in range(len(words) - 12):
            if tuple(words[k:k + 13]) in runs:
                hit.update(range(k, k + 13))
        if not hit or 20 * len(hit) < len(words):
            wanted.append(r.doc_id)
    assert ids(kept) == sorted(wanted) and len(wanted) < docs.count()


def test_mixing_repeats_by_rate(spark, stages):
    docs, mixed = stages["mixing"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rates = mixing.mix(docs, labels, pipeline.domain(), pipeline.TARGETS).collect()
    total = sum(r.n_tokens for r in rates)
    for i, target in enumerate(pipeline.TARGETS.values()):
        assert abs(sum(r.rate * r.n_tokens * r.p[i] for r in rates) / total - target) < 1e-3
    found = Counter(ids(mixed))
    assert all(abs(found[r.doc_id] - r.rate) < 1 for r in rates)
    assert set(found) <= set(ids(docs))


def test_files_hold_the_mix(stages):
    docs, written = stages["token_files"]
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    found = written.orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted(i for i, _ in rows)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == sorted(
        (i, n, c) for i, _, n, c in wanted_files(rows))


def test_odd_rows_pass_every_stage(spark, tmp_path):
    docs = odd(spark)
    columns = docs.columns
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k == 1:
            kept = [r.doc_id for r in docs.collect()]
            # one of the texts without words, which has no id; one of three equal texts; one of two near copies
            assert sorted(x for x in kept if x is not None) == [-3, 1, 7, 7, 8, 9, 10, 12] and kept.count(None) == 2
    assert len(by_text()) == 16


def test_no_rows_pass_every_stage(spark, tmp_path):
    docs = odd(spark, [])
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() == 0


def test_run_writes_and_returns_the_last_stage(spark, stages):
    found = pipeline.run(spark, SMALL)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, stages["token_files"][1].collect()))


@pytest.mark.parametrize("own", [None, "5m"])
def test_python_gets_texts_in_small_batches(spark, monkeypatch, own):
    """16 MB of texts in one partition, and fewer rows than Spark's batch; a session's own setting stays."""
    if own:
        spark.conf.set(pipeline.BATCHES, own)
    else:
        spark.conf.unset(pipeline.BATCHES)
    docs = spark.range(0, 1_600, 1, 1).selectExpr("id AS doc_id", "concat(repeat('word ', 2000), id) AS text")
    found = []

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"])

    def measured(texts, **_):
        found.append(texts.select("text").mapInArrow(sizes, "size bigint").agg(F.max("size"), F.count("size")).first())
        key = pipeline.sections.text_key(F.col("doc_id"), F.col("text"))
        return texts.select(key.alias("key"), key.alias("keeper"))

    monkeypatch.setattr(pipeline.sections, "groups", measured)
    try:
        assert dict(pipeline.STAGES)["near_dedup"](spark, docs, SMALL).count() == 1_600
    finally:
        spark.conf.unset(pipeline.BATCHES)
    (most, n), = found
    if own:
        assert 4 << 20 < most < 6 << 20
    else:
        assert most < 1.1 * pipeline.BATCH_BYTES and n >= 7
