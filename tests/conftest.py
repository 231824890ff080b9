import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from folioscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 8, shuffle_partitions=4, memory="6g")


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"


def page(spark, *lines, page_id="p001"):
    """Lines given as (id, box, include, [(part_id, text, confirmed, skipped)])."""
    rows = []
    for pos, (line_id, box, include, parts) in enumerate(lines):
        rows.append((page_id, f"{page_id}.jpg", line_id, pos, *box, include, [(p + ("", False, False)[len(p) - 1 :]) for p in parts]))
    schema = (
        "page_id string, filename string, line_id string, line_pos int, x0 int, y0 int, x1 int, y1 int, include boolean, "
        "parts array<struct<part_id:string,text:string,confirmed:boolean,skipped:boolean>>"
    )
    return spark.createDataFrame(rows, schema)


def rows(df, *order):
    return sorted(map(tuple, df.select(*order).collect()), key=lambda r: tuple((v is not None, v) for v in r))
