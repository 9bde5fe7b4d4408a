"""UDF-01: a caller's analyser over the work queue."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacksift.operators.batches import give_back

#: Rows that are turned into dicts, and results into Arrow, at a time: a row may hold a long text.
RUN = 64


def analyze(df: DataFrame, fn: Callable[[dict], dict], schema: T.StructType, now: datetime, concurrency: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """df with light_analysis (of schema), analyzed_at, analysis_status and analysis_error.

    fn gets a row as a dict and returns the analysis as a dict; what it raises makes the row failed, with
    the error's text, and never fails the job. concurrency bounds how many calls run at once. Only df's
    columns and the results pass through Python; keep them few. keep: the columns of df that come back (default: all);
    what only fn needs, as a long text, then goes one way.
    """
    kept = df.drop("light_analysis", "analyzed_at", "analysis_status", "analysis_error")
    dealt = kept.repartition(concurrency) if concurrency else kept
    back = [f for f in kept.schema.fields if keep is None or f.name in keep]
    names = [f.name for f in back]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), RUN):
                b, done = whole.iloc[at : at + RUN], []
                for row in b.to_dict("records"):
                    try:
                        found = fn(row)
                        done.append(({f.name: found.get(f.name) for f in schema.fields}, "success", None))
                    except Exception as error:  # one bad row must not fail the job
                        done.append((None, "failed", f"{type(error).__name__}: {error}"))
                yield b[names].assign(light_analysis=[d[0] for d in done], analysis_status=[d[1] for d in done], analysis_error=[d[2] for d in done])
        give_back()

    out = T.StructType([*back, T.StructField("light_analysis", schema), T.StructField("analysis_status", T.StringType()), T.StructField("analysis_error", T.StringType())])
    return dealt.mapInPandas(run, out).withColumn("analyzed_at", F.when(F.col("analysis_status") == "success", F.lit(now)))
