"""The pipeline's stages one by one against what they must keep, and its run."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import public_tokenizers
import pytest
from odd_texts import ODD_TEXTS

import __spark_entry__ as entry
from sievework.llm import byte_bpe, decontaminate, quality, queries, secret_scan, simhash
from sievework.session import materialize

SF = "/root/testdata/sf0.01"
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage on the small tables."""
    found, docs = [], queries.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        done = materialize(stage(spark, docs, SF), f"test-{name}")
        found.append((docs, done))
        docs = done
    return found


def ids(table):
    return sorted(r.doc_id for r in table.select("doc_id").collect())


def test_stages_keep_the_columns_of_documents(spark, stages):
    names = queries.table(spark, SF, "documents").columns
    assert all(sorted(done.columns) == sorted(names) for _, done in stages[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "decontamination", "secrets", "encoding"]


def test_quality_stage_keeps_accepted_documents(spark, stages):
    docs, done = stages[0]
    scores = quality.score(docs, queries.table(spark, SF, "labels")).where("predicted = 1")
    assert ids(done) == ids(scores)


def test_simhash_stage_keeps_the_least_of_each_group(stages):
    docs, done = stages[1]
    found = simhash.near_duplicates(docs)
    assert ids(done) == sorted({r.component_id for r in found.collect()})


def test_decontamination_stage_drops_what_is_found_and_no_more(spark, stages):
    docs, done = stages[2]
    held = {r.doc_id for r in decontaminate.leaks(docs, queries.table(spark, SF, "benchmark")).collect()}
    assert held and ids(done) == [i for i in ids(docs) if i not in held]


def test_secret_stage_changes_only_secrets(stages):
    docs, done = stages[3]
    after = {r.doc_id: r for r in done.collect()}
    changed = 0
    for r in docs.collect():
        want = secret_scan.redact(r.text)
        changed += want != r.text
        assert after[r.doc_id].text == want and after[r.doc_id].n_chars == len(want)
    assert changed and len(after) == docs.count()


def test_encoding_stage_gives_the_texts_back(stages):
    docs, done = stages[4]
    coder = byte_bpe.ByteBPE(queries.BYTE_RANKS, public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in done.collect():
        assert bytes(r.ids) == coder.encode(texts.pop(r.doc_id)) and coder.decode(bytes(r.ids)) == bytes(r.decoded)
    assert not texts


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    done = corpus_pipeline.run(spark, SF)
    pack = lambda table: sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in table.collect())
    assert pack(done) == pack(stages[-1][1])


def test_odd_rows_pass_every_stage(spark, odd_docs, no_docs):
    for table, n in ((odd_docs, len(ODD_TEXTS)), (no_docs, 0)):
        for name, stage in corpus_pipeline.STAGES:
            done = stage(spark, table, SF)
            assert done.count() <= n
            if name in ("secrets", "encoding"):
                assert done.count() == n
            if name != "encoding":
                assert sorted(done.columns) == sorted(table.columns)
    kept = [r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, odd_docs, SF).collect()]
    # 1, 2 and 3 have no words, -9 and 4 (twice) are equal, the others stand alone.
    assert sorted(str(i) for i in kept) == sorted(["-9", "1", "5", "6", "7", "8", "None"])


def test_rows_without_or_with_equal_ids_are_documents_of_their_own(spark):
    item = queries.table(spark, SF, "benchmark").where("length(text) > 100").first().text
    plain = [" ".join(f"{w}{k}" for k in range(60)) for w in ("red", "green", "blue", "grey", "pink")]
    rows = [(None, plain[0]), (None, plain[1]), (None, plain[1]), (7, plain[2]), (7, plain[3]), (3, plain[4]), (None, plain[4]), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = materialize(corpus_pipeline.keep_one_of_each(spark, docs, SF), "test-own")
    got = lambda table: sorted((str(r.doc_id), r.text) for r in table.collect())
    own = [("None", plain[0]), ("None", plain[1]), ("7", plain[2]), ("7", plain[3]), ("3", plain[4])]
    assert got(kept) == sorted([*own, ("None", item)])
    assert got(corpus_pipeline.drop_leaks(spark, kept, SF)) == sorted(own)


def test_every_query_is_registered():
    names = set(entry.queries())
    assert {*queries.QUERIES, "pipeline"} <= names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(entry.oracle_sql()) <= names


def test_the_rest_works_without_this_package(tmp_path):
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "import importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, *a):\n"
        "        if name.startswith(('corpus_pipeline', 'sievework.llm')): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and len(e.queries()) > 100 and e.oracle_sql()\n"
    ) % str(ROOT)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120)
