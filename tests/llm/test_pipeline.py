"""Stages of the pipeline decide on rows: ids that are missing or repeat cost no document."""

import corpus_pipeline
import numpy as np
import pytest

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]


def text(seed, n=60):
    return " ".join(WORDS[i] for i in np.random.default_rng(seed).integers(0, len(WORDS), n))


COPY, LEAK = text(1), text(2, 40)
CLEAN = [(None, text(3)), (None, text(4)), (7, text(5)), (7, text(6)), (7, text(7)), (8, text(8))]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def kept(df):
    assert tuple(df.columns) == corpus_pipeline.COLUMNS
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    ("stage", "more", "stay"),
    [
        ("language_id", [(None, "123 456"), (7, "12 34")], []),
        ("near_dedup", [(9, COPY), (None, COPY), (10, COPY), (9, COPY)], [(9, COPY)]),
        ("decontaminated", [(None, "so " + LEAK), (7, LEAK + " on")], []),
        ("mixed", [(7, text(5))], [(7, text(5))]),
    ],
)
def test_stage_decides_on_rows(spark, sf_dir, stage, more, stay):
    got = dict(corpus_pipeline.STAGES)[stage](spark, table(spark, CLEAN + more), sf_dir)
    assert kept(got) == sorted(CLEAN + stay, key=repr)


def test_stage_with_whole_ids(spark, sf_dir):
    rows = [(i, text(20 + i)) for i in range(5)]
    assert kept(corpus_pipeline.decontaminated(spark, table(spark, [*rows, (5, LEAK)]), sf_dir)) == rows
