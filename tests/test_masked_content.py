"""Dumps and masked samples: bounded batches."""

import numpy as np
import pyarrow as pa

from spanframe.functions import kernels
from spanframe.sources import dumps

RUNS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def test_a_histogram_hands_its_rows_over_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(kernels, "FLUSH_ROWS", 500, raising=False)
    contents = [bytes(range(200)) for _ in range(40)]
    for extra in ([], [pa.array([[{"lo": 0, "hi": 200}]] * 40, RUNS)]):
        batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(contents), *extra], names=["s", "c", "r"][: 2 + len(extra)])
        got = list(kernels.histogram_batches(64)([batch]))
        assert sum(b.num_rows for b in got) == 8000 and max(b.num_rows for b in got) <= 700


def test_masked_counts_equal_brute_force():
    rng = np.random.default_rng(3)
    contents = [rng.integers(0, 5, n).astype(np.uint8).tobytes() for n in (0, 1, 63, 64, 65, 300)] * 30
    runs = [None if i % 7 == 0 else [{"lo": int(a), "hi": int(a + b)} for a, b in zip(rng.integers(0, 320, 4), rng.integers(0, 40, 4))] for i in range(len(contents))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(contents))), pa.array(contents), pa.array(runs, RUNS)], names=["s", "c", "r"])
    want = {}
    for s, (c, rs) in enumerate(zip(contents, runs)):
        for r in rs or []:
            for p in range(r["lo"], min(r["hi"], len(c))):
                want[(s, p // 64, c[p])] = want.get((s, p // 64, c[p]), 0) + 1
    got = {tuple(r.values())[:3]: r["cnt"] for b in kernels.histogram_batches(64)([batch.slice(0, 100), batch.slice(100)]) for r in b.to_pylist()}
    assert got == want
    empty = {r["sample_id"] for b in kernels.histogram_batches(None, True)([batch]) for r in b.to_pylist() if r["code"] == -1 and r["cnt"] == 0}
    assert empty == set(range(len(contents))) - {s for s, _, _ in want}


def test_address_lines_with_any_blanks(spark):
    text = "1000\t55 8B \r\n 1008 01\n1010  ?? zz\t\x0b\r\n1020\nxyz 01\n1030 AA\u0085\n103G 01\n1040 \u0085 BB"
    df = spark.createDataFrame([("s", text)], "sample_id string, text string")
    got = [(r.line_no, int(r.addr), r.payload, r.n_tokens) for r in dumps.parse_hex_dumps(df, "text").orderBy("line_no").collect()]
    assert got == [(0, 0x1000, "55 8B", 2), (2, 0x1010, "?? zz", 2), (5, 0x1030, "AA\u0085", 1)]
