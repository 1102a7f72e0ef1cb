"""The classifier on held-out labels, and the pipeline stage by stage."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import quality

from .plain import corpus, frame, jaccard_components, without_lines

DATA = "/root/testdata/sf0.1"


def made(n: int, seed: int = 1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        w = r.choices(vocabulary, k=r.randint(20, 120))
        low, toxic = r.random() < 0.1, r.random() < 0.1
        if low:
            w = [x for x in w[:5] for _ in range(15)]
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["villain", "rotten", "beastly"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(not low), int(toxic)))
    return rows, labels


def test_classifier(spark):
    rows, labels = made(1500)
    known = spark.createDataFrame(labels[:1000], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(frame(spark, rows), known).collect()}
    assert len(got) == len(rows)
    wrong = [i for i, q, t in labels[1000:] if got[i].keep != bool(q and not t)]
    assert len(wrong) <= 5
    # priors: the host's posterior shrinks to the whole, the path's to the host's
    overall = sum(r.evidence for r in got.values()) / len(got)
    assert all(0 < r.prior < 1 and abs(r.prior - overall) < 0.1 for r in got.values())
    for r in got.values():
        z = math.log(r.evidence / (1 - r.evidence)) + math.log(r.prior / (1 - r.prior)) - math.log(overall / (1 - overall))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-6


def test_posterior_is_that_of_plain_python(spark):
    """Priors by plain sums over the evidence: moments for the strengths, each document's own evidence left out; null ids and large ids stay."""
    rows, labels = made(400, seed=4)
    big = (1 << 53) + 1
    rows = [(big + 2 * i, t) for i, t in rows] + [(None, rows[0][1]), (None, None)]
    known = spark.createDataFrame([(big + 2 * i, q, t) for i, q, t in labels], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, rows, 2).withColumn("source", F.when(F.col("doc_id") % 40 == 1, F.concat(F.lit("rare"), F.col("doc_id") % 7)).otherwise(F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("source"))))
    docs = docs.withColumn("lang", F.when(F.col("n_chars") % 5 == 0, "xx").otherwise(F.col("lang")))
    got = quality.classify(docs, known).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in rows), key=str)
    clip = lambda x: min(max(x, 1e-9), 1 - 1e-9)
    overall = sum(r.evidence for r in got) / len(got)
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in got:
        hosts[r.host].append(r.evidence)
        paths[r.host, r.path].append(r.evidence)

    def strength(sites, center):
        p = overall * (1 - overall)
        between = (sum(len(v) * (sum(v) / len(v) - center(s)) ** 2 for s, v in sites.items()) - p * len(sites)) / sum(map(len, sites.values()))
        return min(max(p / between - 1, 1.0), 1e6) if between > 0 else 1e6

    k = strength(hosts, lambda s: overall)
    m = strength(paths, lambda s: (sum(hosts[s[0]]) + k * overall) / (len(hosts[s[0]]) + k))
    for r in got:
        h, q = hosts[r.host], paths[r.host, r.path]
        of_host = (sum(h) - r.evidence + k * overall) / (len(h) - 1 + k)
        prior = (sum(q) - r.evidence + m * of_host) / (len(q) - 1 + m)
        assert abs(r.prior - prior) < 1e-9
        odds = [math.log(clip(x) / (1 - clip(x))) for x in (r.evidence, prior, overall)]
        assert abs(r.score - 1 / (1 + math.exp(-(odds[0] + odds[1] - odds[2])))) < 1e-6
        assert r.keep == (r.score < 0.5)


def test_site_posterior_moves_uncertain_documents(spark):
    """A host of unwanted documents has a higher prior than one of clean ones."""
    rows, labels = made(900)
    bad = {i for i, q, t in labels if not q or t}
    docs = frame(spark, rows).withColumn("source", F.when(F.col("doc_id").isin(*bad), "bad").otherwise("good"))
    got = quality.classify(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    prior = {r.host: r.p for r in got.groupBy("host").agg(F.avg("prior").alias("p")).collect()}
    assert prior["bad"] > 0.5 > prior["good"]


def test_classifier_edges(spark):
    rows, labels = made(60)
    rows += [(1000, None), (1001, ""), (None, "x y"), (5, rows[5][1])]
    odd = spark.createDataFrame([*labels, (None, 1, 1), (7, None, 0), (8, 1, None)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, rows)
    assert quality.classify(docs, odd).count() == len(rows)
    assert quality.classify(docs, odd.limit(0)).where("keep").count() == len(rows)
    assert quality.classify(docs.limit(0), odd).count() == 0


def test_classifier_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    known = labels.where("doc_id % 3 <> 0")
    got = quality.classify(docs, known).join(labels.where("doc_id % 3 = 0"), "doc_id")
    r = got.agg(*(F.sum(F.when(F.expr(c), 1).otherwise(0)) for c in ("quality = 0", "quality = 0 and not keep", "quality = 1 and toxic = 0", "quality = 1 and toxic = 0 and not keep"))).first()
    assert r[1] >= 0.9 * r[0]
    assert r[3] <= 0.01 * r[2]


def test_only_near_copies_leave_the_fit():
    """A frequent bigram doesn't make unrelated documents copies; changed words do not make a copy its own text."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(400)]
    texts = [" ".join([*(word() for _ in range(60)), "of", "the", *(word() for _ in range(60))]) for _ in range(400)]
    near = []
    for k in (0, 1, 4, 8):
        near.append(base.copy())
        for at in r.sample(range(400), k):
            near[-1][at] = word()
    rows = [*texts, *(" ".join(n) for n in near), "one", "one"]
    hashes, counts = quality.word_hashes(rows, quality._FOLD)
    minima = [quality.minima(w) for w in np.split(hashes, np.cumsum(counts)[:-1])]
    same = np.zeros((len(rows), 2), np.int64)
    assert quality._own_texts(minima, same).tolist() == [True] * 401 + [False] * 3 + [True] * 2
    same[402, 1] = 1  # a copy with another label stays
    assert np.flatnonzero(~quality._own_texts(minima, same)).tolist() == [401, 403]


@pytest.mark.parametrize("part", range(3))
def test_toxic_recall_on_held_out_documents(spark, part):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    known = labels.where(f"doc_id % 3 <> {part}").select(F.col("doc_id").alias("doc"), (F.col("quality") == 0).cast("int").alias("low"), F.col("toxic").cast("int").alias("toxic"))
    model = quality.fitted(docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("t")), known)
    toxic = [r.text for r in docs.join(labels.where(f"doc_id % 3 = {part} and toxic = 1"), "doc_id").collect()]
    assert (model.logits(toxic)[:, 1] > 0).mean() >= 0.8


@pytest.fixture
def folder(spark, tmp_path):
    rows = corpus(seed=5, n=40)
    clean, labels = made(200)
    rows += [(i + 1000, t) for i, t in clean]
    frame(spark, rows).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i + 1000, q, t) for i, q, t in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    """Each stage's decisions take effect on all that its predecessor kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "suffix_dedup", "packing"]
    (_, f7), (_, f8), (_, f1), (_, f6), (_, f3) = corpus_pipeline.STAGES
    kept = f7(spark, docs, folder)
    rejected = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("not keep").collect()}
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert set(rows) == {r.doc_id for r in docs.collect()} - rejected
    lined = f8(spark, docs, folder)
    assert lined.columns == list(corpus_pipeline.COLUMNS)
    own = {r.doc_id: r.text for r in docs.collect()}
    want = {i: t for i, (t, _, _) in without_lines(own.items(), 3).items()}
    assert {r.doc_id: r.text for r in lined.collect()} == want
    joined = f1(spark, docs, folder)
    assert joined.columns == list(corpus_pipeline.COLUMNS)
    assert {r.doc_id for r in joined.collect()} == {i for i, (_, c) in jaccard_components(list(own.items()), 5, 8, 10).items() if c == i}
    cleaned = {r.doc_id: r.text for r in f6(spark, docs, folder).collect()}
    assert set(cleaned) == set(own)
    seen = defaultdict(int)
    for t in cleaned.values():
        seen[t] += bool(t and len(t) >= 300)
    assert max(seen.values()) == 1


def test_rows_of_one_id(spark, folder):
    """Repeated and null ids: each row stays or goes by itself, through all stages; an empty table passes."""
    clean = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").where("doc_id >= 1000").orderBy("doc_id").collect()]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    bad = [clean[i - 1000] for i, r in labels.items() if r.toxic == 1][:1]
    good = [clean[i - 1000] for i, r in labels.items() if r.toxic == 0 and r.quality == 1][:3]
    rows = [(7, bad[0]), (7, good[0]), (None, bad[0] + " x"), (None, good[1]), (None, good[1]), (8, good[2]), (9, None)]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id >= 1000").unionByName(frame(spark, rows).select(*corpus_pipeline.COLUMNS))
    (_, f7), (_, f8), (_, f1), (_, f6), (_, f3) = corpus_pipeline.STAGES
    pick = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.where("doc_id is null or doc_id < 1000").collect())
    kept = f7(spark, docs, folder)
    assert pick(kept) == sorted([(7, good[0]), (0, good[1]), (0, good[1]), (8, good[2]), (9, "")])
    only = frame(spark, [(7, good[0]), (7, good[1]), (7, good[1]), (None, good[1]), (None, good[2]), (9, None), (9, None)]).select(*corpus_pipeline.COLUMNS)
    assert pick(f1(spark, only, folder)) == sorted([(7, good[0]), (7, good[1]), (0, good[2]), (9, ""), (9, "")])
    assert f8(spark, only, folder).count() == f6(spark, only, folder).count() == 7
    packed = f3(spark, only, folder)
    assert packed.where("doc_id = 7").count() >= 3
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0
