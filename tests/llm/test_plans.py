"""The operators that are to be native run no Python on executors."""

import re

from quarry.llm import queries
from quarry.llm.mixing import mix

SF = "/root/testdata/sf0.001"


def test_native_operators(spark):
    plans = [queries.QUERIES[n](spark, SF) for n in ("op1_mixing", "op8_url_filters")] + [mix(spark.read.parquet(f"{SF}/documents.parquet"))]
    for df in plans:
        assert not re.search("Python|Pandas|Arrow|ExistingRDD", df._jdf.queryExecution().executedPlan().toString())


def test_html_is_not_read(spark):
    assert "html" not in queries.QUERIES["op8_url_filters"](spark, SF)._jdf.queryExecution().executedPlan().toString()
