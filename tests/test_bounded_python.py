"""Python functions over texts: small batches, few rows as Python values, one worker for a step."""

import pyarrow as pa
import pytest

from corploom import Corpus, Document, queries, read
from corploom.functions import batches, hashing
from corploom.sources.stream import PassReport

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def wide(spark):
    before = spark.conf.get(BYTES)
    spark.conf.set(BYTES, "256m")
    yield spark
    spark.conf.set(BYTES, before)


def evaluations(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_keys_of_a_filter_are_computed_once(wide):
    assert evaluations(queries.short_text_near_key(wide, "/root/testdata/sf0.001")) == 1
    assert wide.conf.get(BYTES) == f"{batches.BATCH_BYTES}b"


def test_a_split_by_function_is_one_evaluation(wide):
    docs = [Document(f"t{k}", "s", k, "de" if k % 2 else None) for k in range(700)]
    side = Corpus(read(docs, name="d")).split(validation=0.5, seed=2, by=lambda d: None if d.position == 5 else f"{d.lang}{d.position % 9}")[1]
    assert evaluations(side._frame(PassReport())[1]) == 1
    assert wide.conf.get(BYTES) == f"{batches.BATCH_BYTES}b"
    key = lambda d: "" if d.position == 5 else f"{d.lang}{d.position % 9}"
    assert [d.position for d in side] == [d.position for d in docs if hashing.unit(f"split:2:{key(d)}") < 0.5]


def test_few_rows_are_values_at_a_time():
    columns = pa.array([*range(1000), None]), pa.array([str(k) for k in range(1001)])
    assert batches.mapped(lambda a, b: f"{a}{b}", pa.string(), *columns).to_pylist() == [*(f"{k}{k}" for k in range(1000)), "None1000"]
    assert batches.mapped(str, pa.string(), pa.array([], pa.int64())).to_pylist() == []
