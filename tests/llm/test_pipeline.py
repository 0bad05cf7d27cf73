"""The pipeline stage by stage, each on its own input, against brute force."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from test_operators import EDGES, SF, base_pii, brute_components, brute_hits, digest, library, word_sets  # noqa: E402, F401

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from folioroute.llm import language  # noqa: E402


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], SF).write.parquet(f"{folder}/{name}")
        frames.append(spark.read.parquet(f"{folder}/{name}"))
    return frames


def pairs(frame):
    return sorted((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())


def test_columns_stay(outputs):
    assert all(f.columns == outputs[0].columns for f in outputs[:-1])


def test_language_stage(outputs):
    kept = {r.doc_id for r in outputs[1].collect()}
    guessed = language.identify(outputs[0], language.fit(outputs[0])).collect()
    assert kept == {r.doc_id for r in guessed if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    assert len(kept) > 0.98 * outputs[0].count()


def test_duplicate_stage(outputs):
    before = pairs(outputs[1])
    components = brute_components(word_sets(before))
    assert pairs(outputs[2]) == [(i, t) for i, t in before if components[i] == i]


def test_contamination_stage(spark, outputs):
    before = pairs(outputs[2])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r[0] for r in brute_hits(before, items) if r[5]}
    assert dirty and pairs(outputs[3]) == [(i, t) for i, t in before if i not in dirty]


def test_masking_stage(outputs):
    before, after = dict(pairs(outputs[3])), dict(pairs(outputs[4]))
    assert before.keys() == after.keys()
    for doc_id, text in before.items():
        if base_pii(text):
            assert after[doc_id] != text
        assert not [s for s in base_pii(after[doc_id])]
    assert outputs[4].where("n_chars <> length(text)").count() == 0


def test_encoding_stage(outputs, library):  # noqa: F811
    texts = dict(pairs(outputs[4]))
    for r in outputs[5].collect():
        assert r.ids == library.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == digest(texts[r.doc_id]) and r.n_tokens == len(r.ids) == len(r.starts)


def test_run_equals_stages(spark, outputs):
    got = sorted((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r.doc_id, r.decoded_sha256) for r in outputs[5].collect())


def test_stages_on_edges(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), "extra") for i, t in EDGES]
    rows += [(None, "no id here at all", "en", "s", 17, None), (None, None, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string"
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            made = stage(spark, frame, SF)
            assert made.count() <= frame.count()
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8, 9, 10]


def test_duplicates_by_id_and_text(spark):
    """Texts that share an id are told apart; only rows equal in both are one."""
    body = [f"w{i}" for i in range(60)]
    copies = [" ".join([*body[:-1], f"e{i}"]) for i in range(3)]
    kept = [(-7, copies[0]), (2, "a text of its own"), (3, "one text of three"), (3, "another text of three"), (4, ""), (4, " "), (4, None), (5, "the same text twice")]
    kept += [(None, copies[0]), (None, copies[0])]
    rows = [*kept, (1, copies[1]), (2, copies[2]), (5, "the same text twice")]
    docs = spark.createDataFrame([(*r, f"s{n}") for n, r in enumerate(rows)], "doc_id bigint, text string, row string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(kept, key=str)
    assert [r.row for r in got if r.doc_id == 5] == ["s12"]


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
