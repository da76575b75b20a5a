import gc

import numpy as np
import pyarrow as pa

import __spark_entry__
import corpus_pipeline
from loomgrid.llm import packing, simhash, toxicity
from tests.llm.test_dedup import jaccard

DIR = "/root/testdata/sf0.001"


def brute_near_dedup(rows):
    """The ids that stay: of all pairs that link by their bits, the least of each component; no pair far from 0.8 is judged wrongly."""
    rule = simhash.RULE_JACCARD
    fps = np.array([simhash.wide_fingerprint(t, rule.shingle, rule.proof) for _, t in rows])
    root = list(range(len(rows)))
    for a in range(len(rows)):
        apart = np.bitwise_count(fps[a + 1 :] ^ fps[a])
        linked = (apart[:, : rule.words].sum(1) <= rule.most) & (apart.sum(1) <= rule.proof_most)
        for b in np.flatnonzero(linked) + a + 1:
            assert jaccard(rows[a][1] or "", rows[b][1] or "") > 0.7
            x, y = root[a], root[int(b)]
            root = [min(x, y) if r in (x, y) else r for r in root]
    return {rows[k][0] for k in set(root)}


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    (_, toxic), (_, exact), (_, near), (_, mix), (_, pack) = corpus_pipeline.STAGES
    scored = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, labels).collect()}
    kept = toxic(spark, docs, DIR)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, p in scored.items() if not p}
    best = {}
    for r in kept.collect():
        best[r.text or ""] = max(r.doc_id, best.get(r.text or "", -1))
    once = exact(spark, kept, DIR)
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == sorted(best.values())
    rows = sorted((r.doc_id, r.text) for r in once.collect())
    few = near(spark, once, DIR)
    assert few.columns == docs.columns
    left = {r.doc_id for r in few.collect()}
    assert left == brute_near_dedup(rows) and not {1, 177} <= left  # these two have a Jaccard similarity of 0.83
    again = mix(spark, few, DIR)
    assert again.columns == docs.columns and {r.doc_id for r in again.collect()} <= {r.doc_id for r in few.collect()}
    pieces = pack(spark, again, DIR)
    assert pieces.count() >= again.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_registered(spark):
    names = list(__spark_entry__.queries())
    assert [n for n in names if n == "pipeline" or n.startswith("op")][0] == "op1_mix_sources" and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))


def test_workers_keep_tables_of_one_operator(spark):
    """What packing leaves in a worker isn't there while near_dedup runs and after it."""

    def lookups(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "Lookup" for x in gc.get_objects())])], ["n"])

    def held():
        return sum(r.n for r in spark.range(0, 16, 1, 16).mapInArrow(lookups, "n bigint").collect())

    docs = spark.read.parquet(f"{DIR}/documents.parquet").repartition(8)
    packing.pack_documents(docs).count()
    assert held() > 0
    simhash.near_dedup(docs.localCheckpoint()).count()
    assert held() == 0


def test_batches_of_long_texts_are_bounded(spark):
    """Long texts reach a worker a few MB at a time."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    docs = spark.range(0, 600, 1, 1).selectExpr("id as doc_id", "repeat(concat(id, ' '), 10000) as text")
    assert simhash.near_dedup(docs.limit(10)).count() == 10
    assert max(r.n for r in docs.select("text").mapInArrow(sizes, "n bigint").collect()) < 8 << 20
