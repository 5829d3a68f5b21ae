"""The operators that are to run without Python do, and no plan has a cross join."""

import re

import pytest

from lodestone.llm import html, licenses, mixing, packing, pii, quality, simhash, urls
from lodestone.llm.exact_dedup import exact_dedup, exact_groups


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("make", [mixing.mixed, mixing.mix, exact_groups, exact_dedup, licenses.scan])
def test_native(docs, make):
    assert not re.search("Python|Pandas|Arrow|ExistingRDD.*python", plan(make(docs)))


@pytest.mark.parametrize("make", [mixing.mixed, exact_groups, licenses.scan, quality.quality_rules, simhash.near_groups, packing.packed, pii.digests])
def test_no_cross_joins(docs, make):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(make(docs)))


def test_no_cross_joins_on_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "<div>x</div>"), (2, "http://a.example/2", "<article>y</article>")], "page_id long, url string, html string")
    for make in (html.extracted, urls.judged):
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(make(pages)))
