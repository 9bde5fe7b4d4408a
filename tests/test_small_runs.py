"""Python steps over long texts work in small runs, so that a worker's memory does not follow its input."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stacksift.operators import analyze, sections
from stacksift.plans import catalog

SF = "/root/testdata/sf0.001"


class Caught:
    """Stands for a DataFrame of pages and keeps what would run on its Arrow batches."""

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


@pytest.mark.parametrize(("chars", "most"), [(10, 256), (100_000, 5)])
def test_pages_are_worked_on_in_runs(spark, chars, most):
    seen = []

    def rows(page_id, html):
        seen.append(page_id)
        yield page_id, len(html)

    batch = pa.RecordBatch.from_pydict({"page_id": list(range(1000)), "html": ["x" * chars] * 1000})
    done = 0
    for out in sections.per_page(Caught(), "page_id long, n int", rows).run(iter([batch])):
        done += out.num_rows
        assert out.num_rows <= most and len(seen) == done  # no page is read before the ones before it are given away
    assert seen == list(range(1000))


def test_analyser_gives_results_in_runs(spark, monkeypatch):
    df = spark.createDataFrame([("a", "text")], "id string, content string")
    caught, calls = [], []

    def catch(self, run, schema):
        caught.append(run)
        return spark.createDataFrame([], schema)

    monkeypatch.setattr(type(df), "mapInPandas", catch, raising=True)
    analyze.analyze(df, lambda row: calls.append(row["id"]) or {"n": len(row["content"])}, T.StructType([T.StructField("n", T.LongType())]), datetime(2024, 1, 1))
    whole, done = pd.DataFrame({"id": [str(i) for i in range(1000)], "content": ["x" * i for i in range(1000)]}), []
    for out in caught[0](iter([whole])):
        done += [x["n"] for x in out["light_analysis"]]
        assert len(out) <= analyze.RUN and len(calls) == len(done)
    assert done == list(range(1000))


@pytest.mark.parametrize("name", ["tx01_trending_rows", "tx02_listing_records", "tx03_detail_fields", "tx04_section_rows", "tx05_front_matter", "tx03_fields_of_made_pages", "tx04_sections_of_made_pages", "tx05_front_of_made_pages", "ag10_outline_stats", "udf01_analyze"])
def test_queries_set_small_batches(spark, name):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    assert isinstance(catalog.queries()[name](spark, SF), DataFrame) and int(spark.conf.get(key)) <= 512


def test_detail_texts_are_cleaned_once(spark):
    plan = catalog.queries()["tx03_detail_fields"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
