"""Property tests: yearly files in random column layouts; number parsing of dirty text."""

from __future__ import annotations

import os
import re
import tempfile

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cropstats.functions.clean import strip_and_cast
from cropstats.sources.files import read_yearly_files

WANTED = {"country": "string", "iso": "string", "score": "double"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.permutations(["country", "iso", "score", "rank", "note"]),
                          st.lists(st.tuples(st.sampled_from(["DE", "FR", "AF", "NA"]),
                                             st.integers(0, 100)),
                                   min_size=1, max_size=4)),
                min_size=1, max_size=4))
def test_property_yearly_files_bind_by_name(spark, files):
    root = tempfile.mkdtemp(prefix="yearly-")
    expected = []
    for i, (order, rows) in enumerate(files):
        year = 1995 + i
        lines = [",".join(order)]
        for iso, score10 in rows:
            cell = {"country": f"C-{iso}", "iso": iso, "score": f"{score10 / 10}",
                    "rank": "1", "note": "x"}
            lines.append(",".join(cell[c] for c in order))
            expected.append((f"C-{iso}", iso, score10 / 10, year))
        with open(os.path.join(root, f"CPI-{year}.csv"), "w") as f:
            f.write("\n".join(lines) + "\n")
    df = read_yearly_files(spark, root, WANTED, r"CPI-(\d{4})\.csv")
    got = sorted((r.country, r.iso, r.score, r.Year) for r in df.collect())
    assert got == sorted(expected)


def _reference_parse(text, pattern):
    if text is None:
        return None
    s = re.sub(pattern, "", text)
    try:
        v = float(s)
    except ValueError:
        return None
    if v != v or v in (float("inf"), float("-inf")) or abs(v) >= 2 ** 31:
        return None
    return int(v)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(
    st.none(),
    st.integers(-10**6, 10**6).map(lambda n: f"{n:,}"),
    st.integers(0, 999).map(lambda n: f"< {n:,}"),
    st.integers(0, 999).map(lambda n: f"'{n:03d}"),
    st.sampled_from(["-", "", "n/a", "12.0", " 7 "])), min_size=1, max_size=20))
def test_property_strip_and_cast_matches_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r.v for r in df.select(strip_and_cast("s", "[<, ']", "int").alias("v")).collect()]
    assert got == [_reference_parse(t, r"[<, ']") for t in texts]
