import hashlib
import random

import corpus_pipeline

from weftcast.llm import quality

from .conftest import ODD
from .test_bpe import reference
from .test_dedup import brute_groups
from .test_models import corpus
from .test_ngram_join import brute


def test_stages_against_brute_force(spark, docs, tmp_path):
    rows, labels = corpus(9, 250)
    rnd = random.Random(1)
    item = "Questions about the moons of Saturn were answered by the third pupil before lunch was over"
    rows += [(300 + k, t) for k, (_, t) in enumerate(rows[:10])] + [(320 + k, t.upper()) for k, (_, t) in enumerate(rows[10:14])]
    rows += [(330 + k, t + " plus") for k, (_, t) in enumerate(rows[20:40])]
    rows += [(400 + k, f"{t} {item.lower()} and so on") for k, (_, t) in enumerate(rows[40:45])]
    rows += [(None if i is None else i + 500, t) for i, t in ODD]
    rnd.shuffle(rows)
    table = docs(rows)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    assert len(corpus_pipeline.STAGES) == 5
    now, kept = table, list(rows)
    scores = {}
    for r in quality.quality_scores(table.where("doc_id is not null").dropDuplicates(["doc_id"]), spark.read.parquet(str(tmp_path / "labels.parquet"))).collect():
        scores[r["doc_id"]] = r["score"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == table.columns
        path = str(tmp_path / f"out-{k}")
        out.write.parquet(path)
        now = spark.read.parquet(path)
        if k == 0:
            got = {r["doc_id"] for r in now.collect()}
            assert {i for i, _ in kept if i in scores and scores[i] >= 0.7 and i < 500} == {i for i in got if i is not None and i < 500}
            kept = [(r["doc_id"], r["text"]) for r in now.collect()]
        elif k == 1:
            keep = {(g[0], g[4]) for g in brute_groups(kept, max) if g[3]}
            kept = [(i, t) for i, t in kept if (i, hashlib.sha256((t or "").encode().lower()).hexdigest()) in keep]
        elif k == 2:
            owners = {c for _, c, _ in brute(kept, 5, 0.8)}
            kept = [(i, t) for i, t in kept if i in owners]
        elif k == 3:
            kept = [(i, t) for i, t in kept if not (t and item.lower() in t.lower())]
        if k < 4:
            assert sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=str) == sorted(kept, key=str)
    known = reference()
    assert sorted(((r["doc_id"], r["ids"]) for r in now.collect()), key=str) == sorted(((i, known.encode_ordinary(t or "")) for i, t in kept), key=str)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept)
