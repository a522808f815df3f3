import __spark_entry__
import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("input", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, stage(spark, out[-1][1], SF)))
    return out


def test_stages(stages):
    columns = stages[0][1].columns
    counts = []
    for name, df in stages[:-1]:
        assert df.columns == columns, name
        counts.append(df.count())
    assert counts[0] >= counts[1] > counts[2] >= counts[3] == counts[4] > 0  # nine toxic documents are too few to learn from
    packed = stages[-1][1]
    assert packed.select("doc_id").distinct().count() == counts[4]
    assert stages[4][1].where("text RLIKE 'AKIA[A-Z0-9]{12}'").count() == 0


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    assert set(__spark_entry__.oracle_sql()) <= names
