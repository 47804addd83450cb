"""Every SQL twin runs; those of the newer operators give what Spark gives."""

from collections import Counter

import duckdb
import pytest

from spanframe.plans import catalog
from spanframe.plans.views import TABLES
from spanframe.sources import dumps

COMPARED = (
    "a6_wide_addresses", "a7_wide_addresses", "d19_bbox_to_bytes", "d19_mask_to_bytes", "d21_header_scan", "e14_valid_runs", "e1_masked_histogram",
    "e1_masked_probabilities", "e3_masked_rows", "e4_masked_bigrams", "f12_select_guarded", "g4_match_detections", "g5_merge_boxes",
)


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_all_twins_run(con):
    for name, sql in catalog.oracle_sql().items():
        try:
            con.execute(sql).fetchall()
        except Exception as e:
            raise AssertionError(name) from e


@pytest.mark.parametrize("name", COMPARED)
def test_twin(spark, sf, con, name):
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = catalog.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(cur.fetchall())


def test_addresses_of_any_width(spark):
    text = "\n".join(["FFFFF80000001000 55 8B EC", "FFFFF80000001003 ?? AA", "123456789012345678 90", "00FFFFF80000001005 01", "FFFFF80000000FFF 02", "; none"])
    df = spark.createDataFrame([("s", text)], "sample_id string, text string")
    lines = dumps.parse_hex_dumps(df, "text")
    assert [(r.line_no, int(r.addr), r.offset) for r in lines.orderBy("line_no").collect()] == [(k, 0xFFFFF80000001000 + d, d) for k, d in ((0, 0), (1, 3), (3, 5))]
    assert {(r.line_no, r.reason) for r in dumps.refused_lines(df, "text").collect()} == {(2, "address_too_long"), (4, "below_base")}
    valid, facts, bad = dumps.assemble_dump(lines)
    row = dumps.masked_content(valid, facts).first()
    assert bytes(row.content) == b"\x55\x8b\xec\x00\xaa\x01" and [tuple(r) for r in row.runs] == [(0, 3), (4, 6)] and bad.count() == 0


def test_dump_lines_are_put_together_like_their_bytes(spark):
    """Overlaps, rewrites, unknown and malformed tokens; a sample may have no valid byte or no token at all."""
    rows = [("a", "1000 55 8B ?? zz AAA 0c\n; none\n1004 01 02\n1001 ??\n1010 ff"), ("b", "20 ?? ?? q"), ("c", "30 xyz 1"), ("d", "A0 11\nA0 22\n9F 33"), ("e", "none"), ("f", None)]
    lines = dumps.parse_hex_dumps(spark.createDataFrame(rows, "sample_id string, text string"), "text")
    valid, facts, _ = dumps.assemble_dump(lines)
    shape = lambda df: {r.sample_id: (bytes(r.content), [tuple(x) for x in r.runs]) for r in df.collect()}
    got = shape(dumps.dump_content(lines))
    assert got == shape(dumps.masked_content(valid, facts)) and set(got) == {"a", "b", "d"}
    assert got["a"][1] == [(0, 1), (4, 6), (16, 17)] and got["b"] == (b"\0\0", [])


def test_controls_are_placed_once(spark, sf):
    """Counts, merged lengths and overlaps read the placed windows; none of them places anew."""
    plan = catalog.queries()["d25_controls_disjoint"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
