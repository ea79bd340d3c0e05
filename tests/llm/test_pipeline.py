"""The corpus pipeline stage by stage, and the registered queries."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from wayframe.llm.queries import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parents[2]
ITEM = "seven quiet benchmark questions about rivers mountains and lakes that nobody should ever train upon again"


def test_pipeline_against_brute_force(spark, tmp_path):
    texts = [f"the house and the garden of number {k} with {k * 7} windows and {k * 3} doors near street {k * 11}" for k in range(40)]
    base = " ".join(f"word{k}" for k in range(90)).split()
    texts += [" ".join(base), " ".join(base[:40] + ["changed"] + base[41:]), " ".join(base[:45]), " ".join(base) + " tail"]
    texts += [texts[3], texts[3], None, "12345", "some text first and then " + ITEM + " and the end", ITEM]
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    keep = [k for k, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    keep = [k for k in keep if k == max(j for j in keep if texts[j] == texts[k])]
    five = lambda t: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    root = {k: k for k in keep}
    for _ in keep:
        for a in keep:
            for b in keep:
                x, y = five(texts[a]), five(texts[b])
                if len(x & y) >= 0.8 * len(x | y):
                    root[b] = min(root[a], root[b])
    keep = [k for k in keep if root[k] == k and ITEM not in texts[k]]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == keep


def test_stages_keep_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        empty = stage(spark, docs.limit(0), data)
        assert empty.count() == 0, name


CLASHING = ["tiling", "language", "__len", "__head", "__sha", "__keep", "__copied", "__gone", "fp", "key", "item", "k1", "a.b"]


def test_stages_with_clashing_names_and_long_texts(spark, data):
    long = "the house and the garden of the old man near the river " * 8_000
    rows = [(1, long, "en"), (2, long + "end", "en"), (3, long, "en"), (4, "a short text of its own that is about something else entirely", "en"), (4, None, None), (None, "", None)]
    docs = spark.createDataFrame([(*r, *[str(k)] * len(CLASHING)) for k, r in enumerate(rows)], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    want = {"language": [1, 2, 3, 4], "exact_dedup": [2, 3, 4, 4], "near_dedup": [None, 1, 4, 4], "decontamination": [None, 1, 2, 3, 4, 4]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        assert sorted((r.doc_id for r in out.collect()), key=lambda i: (i is not None, i)) == want[name], name
    assert corpus_pipeline.packed(spark, docs, data).select("doc_id").distinct().count() == 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    got = df.toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
        want = con.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        text = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).where(f.notna(), None).map(lambda v: float(v) if isinstance(v, int) and not isinstance(v, bool) else v).values.tolist()))
        assert text(got) == text(want)


def test_everything_else_works_without_this_subpackage(tmp_path):
    for part in ("wayframe", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / part), str(tmp_path / part)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "wayframe/llm")], check=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(k.startswith('op1_') for k in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
