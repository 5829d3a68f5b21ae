"""Fields and paths of reports, in every form."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import records

REPORTS = [
    ("**Domain**: web\n**Type**: bug\n**Requirements**: do\nit **X** y", ("web", "do\nit", "bug")),
    ("nothing", ("github", "nothing", "unknown")),
    ("**Type**:feature", ("github", "**Type**:feature", "feature")),
    ("**Requirements**:   all of it \n", ("github", "all of it", "unknown")),
    ("**Requirements**: **Domain**:\n\tdb rest", ("db", "**Requirements**: **Domain**:\n\tdb rest", "unknown")),
]
PATHS = [
    ("see /a/b.ts and /c/d.md /a/b.ts", ["/a/b.ts", "/c/d.md"], None),
    ("at /r/docs/specs/x/y.md. then", ["/r/docs/specs/x/y.md"], "/r/docs/specs/x/y.md"),
    ("(x/r/docs/specs/a.md),/r/docs/specs/b.md!", ["/r/docs/specs/a.md),/r/docs/specs/b.md"], "/r/docs/specs/a.md),/r/docs/specs/b.md"),
    ("/docs/specs/a.md /r/docs/specs/.md", ["/docs/specs/a.md", "/r/docs/specs/.md"], None),
    ("a.ts / /.ts /x.tsx /y.json /z.yaml /.yaml", ["/x.ts", "/y.js", "/z.yaml"], None),
    ("", [], None),
]


def test_fields(spark):
    rows = spark.createDataFrame([(t,) for t, _ in REPORTS], "t string").select(records.parse_analysis(F.col("t")).alias("a")).collect()
    assert [tuple(r.a[c] for c in ("domain", "requirements", "issue_type")) for r in rows] == [want for _, want in REPORTS]


@pytest.mark.parametrize(("text", "files", "spec"), PATHS)
def test_paths(spark, text, files, spec):
    row = spark.createDataFrame([(text,)], "t string").select(records.file_paths(F.col("t")).alias("f"), records.spec_path(F.col("t")).alias("s")).first()
    assert (row.f, row.s) == (files, spec)
