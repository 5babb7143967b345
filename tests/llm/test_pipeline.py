"""The corpus pipeline, stage by stage on planted rows, and the registered queries."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

import __spark_entry__ as E
import corpus_pipeline as C
from metroscope.llm import runtime


def test_every_operator_and_the_pipeline_are_registered():
    names = E.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and "op1_exact_dedup" in E.oracle_sql() and [n for n, _ in C.STAGES] == [
        "quality", "exact_dedup", "near_dedup", "decontaminate", "pack"]


def test_stages_decide_on_planted_rows(spark):
    base = spark.read.parquet(f"{H.SMALL}/documents.parquet")
    item = spark.read.parquet(f"{H.SMALL}/benchmark.parquet").orderBy("item_id").first().text
    donor = " ".join(next(r.text for r in base.orderBy("doc_id").collect() if 300 < len(r.text.split()) < 900 and "|" not in r.text
                          and "#" not in r.text and "!" not in r.text).split())
    words = donor.split()
    near = " ".join(words[:150] + ["changed"] + words[151:])
    planted = [(10_001, donor.upper()), (10_002, donor), (10_003, near), (10_004, " ".join(words[:60]) + " " + item + " " + " ".join(reversed(words)))]
    docs = base.unionByName(spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, t in planted], base.schema))
    seen = {}
    for name, stage in C.STAGES:
        before = docs.count()
        docs = runtime.stored(stage(spark, docs, H.SMALL), f"t-{name}")
        if name != "pack":
            assert docs.columns == base.columns and docs.count() <= before
        seen[name] = {r.doc_id: (r.text if name != "pack" else None) for r in docs.collect()}
    assert {10_002, 10_003, 10_004} <= set(seen["quality"])
    assert 10_001 not in seen["exact_dedup"] and 10_002 in seen["exact_dedup"]
    assert len({10_002, 10_003} & set(seen["near_dedup"])) <= 1 and 10_004 in seen["near_dedup"]
    kept = seen["decontaminate"][10_004]
    (_, _, hit, _), = H.contamination([(1, kept)], [(0, item)])
    assert hit == 0 and kept.startswith(words[0]) and len(kept.split()) < len(seen["near_dedup"][10_004].split())
    assert set(seen["pack"]) == set(seen["decontaminate"])


def test_an_empty_table_gives_an_empty_result(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{H.SMALL}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
