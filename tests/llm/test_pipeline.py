import hashlib

import corpus_pipeline
import pandas as pd
import public_tokenizers
from feedloom.llm import lines, mixing, quality_rules, simhash
from feedloom.llm.registry import load
from feedloom.plans.staging import stage
from pyspark.sql import functions as F
from test_simhash import brute_classes, brute_print
from tokenizers import Tokenizer


def test_stages_against_their_meaning(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, work in corpus_pipeline.STAGES:
        frames.append(stage(work(spark, frames[-1], sf), f"test-{name}"))
    assert all(f.columns == columns for f in frames[:-1])
    raw, good, shorter, apart, mixed = (f.toPandas() for f in frames[:-1])
    coded = frames[-1].toPandas()
    verdict = quality_rules.quality_rules(docs).toPandas()
    assert set(good.doc_id) == set(verdict[verdict.kept].doc_id) and len(good) < len(raw)
    assert set(shorter.doc_id) == set(good.doc_id) and shorter.n_chars.sum() < good.n_chars.sum()
    assert (shorter.n_chars == shorter.text.str.len()).all()
    assert not lines.repeated_lines(frames[2], blocks=True).count() and not lines.repeated_lines(frames[2]).count()
    classes = brute_classes(sorted((d, brute_print(t)) for d, t in zip(shorter.doc_id, shorter.text, strict=True)))
    assert sorted(apart.doc_id) == sorted(set(classes.values()))
    plan = mixing.fair_queue(frames[3]).toPandas()
    assert mixed.doc_id.value_counts().to_dict() == {d: c for d, c in zip(plan.doc_id, plan.copies, strict=True) if c}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(zip(mixed.doc_id, mixed.text, strict=True))
    assert sorted(coded.doc_id) == sorted(mixed.doc_id)
    for r in coded.itertuples():
        assert list(r.token_ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 2), (2, "", "en", "s", 0, 3), (None, "a b " * 40, "en", "s", 160, 4)],
        "doc_id long, text string, lang string, source string, n_chars long, hash int",
    )
    for name, table in (("odd", docs), ("empty", docs.filter(F.lit(False)))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() >= 0


def test_registered():
    queries, oracles = load()
    assert queries["pipeline"] is corpus_pipeline.run
    assert {k.split("_")[0] for k in queries} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
    assert set(oracles) <= set(queries) and "pipeline" not in oracles
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "encoding"]
    assert simhash.MAX_BITS == 4
