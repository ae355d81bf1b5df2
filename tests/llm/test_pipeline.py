"""The pipeline against the operators' own definitions, stage by stage, on a small corpus with planted cases."""

import random

import corpus_pipeline
import pyarrow as pa
from tessera.llm import packing, queries, toxicity

from . import test_decontaminate, test_line_dedup, test_minhash_dedup
from .common import words

SF = "/root/testdata/sf0.001"


def planted(spark):
    """Documents of the test data, and near copies, copies and benchmark passages."""
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = random.Random(1)
    clean = [words(rng, 150, 5000) for _ in range(4)]
    near = clean[0].split()
    near[7] = "other"
    extra = [*clean, " ".join(near), clean[1], clean[2] + " " + " ".join(items[0][1].split()[:15]), None, ""]
    docs += [{"doc_id": 10_000 + i, "text": t, "lang": "en", "source": "s", "n_chars": len(t or "")} for i, t in enumerate(extra)]
    return docs, items


def test_stages(spark, tmp_path):
    docs, items = planted(spark)
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    now = spark.createDataFrame([tuple(d[f.name] for f in schema) for d in docs], schema)
    rows = [tuple(d[f.name] for f in schema) for d in docs]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        now = spark.read.parquet(path)
        got = sorted(map(tuple, now.collect()), key=str)
        if name == "toxicity":
            learn = toxicity.training_rows()
            model = toxicity.fit(toxicity.labelled_sample(spark.createDataFrame(rows, schema).where(learn), queries.table(spark, SF, "labels").where(learn)))
            score, _ = toxicity.score_batch(model, pa.array([r[1] for r in rows], pa.string()))
            rows = [r for r, s in zip(rows, score, strict=True) if s < 0.5]
        elif name == "line_dedup":
            left = test_line_dedup.brute([(r[0], r[1]) for r in rows])
            some = lambda t: any(x.strip(test_line_dedup.SPACE) for x in (t or "").split("\n"))
            rows = [(r[0], left[r[0]], r[2], r[3], len(left[r[0]]) if r[1] is not None else None) for r in rows if left[r[0]] == r[1] or some(left[r[0]])]
        elif name == "near_dedup":
            kept = {i for i, _, _, k in test_minhash_dedup.brute([(r[0], r[1]) for r in rows], 5) if k}
            rows = [r for r in rows if r[0] in kept]
        elif name == "decontamination":
            clean = {b[0] for b in test_decontaminate.brute([(r[0], r[1]) for r in rows], items, 10) if not b[-1]}
            rows = [r for r in rows if r[0] in clean]
        if name != "packing":
            assert now.columns == schema.names and got == sorted(rows, key=str)
            seen[name] = {r[0] for r in rows}
        else:
            lengths = {r[0]: len(packing.encode(queries.tokenizer(), r[1], 0)) for r in rows}
            total = dict.fromkeys(lengths, 0)
            for p in now.collect():
                total[p.doc_id] += p.length
            assert total == lengths
    assert {10_000, 10_001, 10_002, 10_003} <= seen["line_dedup"] and 10_005 not in seen["line_dedup"]
    assert 10_004 not in seen["near_dedup"] and 10_006 not in seen["decontamination"] and 10_000 in seen["decontamination"]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
