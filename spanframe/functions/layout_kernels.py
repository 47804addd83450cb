"""Arrow kernels that resolve positions against the layout on their own row.

A batch is worked off by region number: all positions meet the first region of their row,
then the second, and so on. Memory follows the positions, not their product with the regions.
Joins, grouping and every later step stay with Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = ("ok", "headers", "overlapping", "truncated", "padding", "certificate", "overlay", "unmapped", "virtual_only")
OK, HEADERS, OVERLAPPING, TRUNCATED, PADDING, CERTIFICATE, OVERLAY, UNMAPPED, VIRTUAL_ONLY = range(len(STATUSES))
#: Columns that a kernel reads, in this order.
LAYOUT = ("file_size", "header_len", "overlay_offset", "cert_lo", "cert_hi", "regions")
FIELDS = ("raw_lo", "raw_size", "rva", "vsize", "mapped")


def _numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of a column, zero for null, and which of them are there."""
    values = values.cast(pa.int64())
    return values.fill_null(0).to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False)


def _lists(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All members of a list column side by side, and the length of each list."""
    return values.flatten(), values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _listed(sizes: np.ndarray, members: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), members)


def _maybe(values: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=~there)


class _Layouts:
    """The layouts of one batch as arrays; ``name`` and ``has_name`` are a value and its presence."""

    def __init__(self, *columns: pa.Array):
        for name, column in zip(LAYOUT[:-1], columns):
            value, there = _numbers(column)
            setattr(self, name, value)
            setattr(self, f"has_{name}", there)
        flat, self.n = _lists(columns[-1])
        self.first = np.cumsum(self.n) - self.n
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        there = {}
        parts = dict(zip([f.name for f in flat.type], flat.flatten()))
        for name in FIELDS:
            value, there[name] = _numbers(parts[name])
            setattr(self, name, value)
        self.has_rva = there["rva"]
        self.placed = there["rva"] & there["raw_lo"] & there["mapped"]
        self.in_offset = (self.raw_size > 0) & (self.raw_lo > 0)
        self.in_rva = (self.vsize > 0) & self.has_rva

    def differs(self) -> np.ndarray:
        """Which rows have another layout than the row before them."""
        new = np.ones(len(self.n), bool)
        new[1:] = self.n[1:] != self.n[:-1]
        for name in LAYOUT[:-1]:
            value, there = getattr(self, name), getattr(self, f"has_{name}")
            new[1:] |= (value[1:] != value[:-1]) | (there[1:] != there[:-1])
        at = np.flatnonzero(~new[self.row])
        before = at - self.n[self.row[at]]
        for value in (*(getattr(self, name) for name in FIELDS), self.has_rva, self.placed):
            new[self.row[at[value[at] != value[before]]]] = True
        return new

    def met(self, row: np.ndarray, use: np.ndarray):
        """(positions, their k-th region) for each k; ``use`` tells which positions take part."""
        at = np.flatnonzero(use & (self.n[row] > 0))
        k = 0
        while at.size:
            yield at, self.first[row[at]] + k
            k += 1
            at = at[self.n[row[at]] > k]

    def owners(self, row, pos, there, lo, size, usable) -> tuple[np.ndarray, np.ndarray]:
        """How many regions hold each position, and the first of them."""
        n, own = np.zeros(len(pos), np.int64), np.full(len(pos), -1)
        for at, r in self.met(row, there):
            p = pos[at]
            hit = usable[r] & (p >= lo[r]) & (p - lo[r] < size[r])
            at, r = at[hit], r[hit]
            own[at] = np.where(own[at] < 0, r, own[at])
            n[at] += 1
        return n, own


def _from_offset(lay: _Layouts, row, pos, there):
    """Candidate status and value of a source offset, before the reverse check."""
    n, own = lay.owners(row, pos, there, lay.raw_lo, lay.raw_size, lay.in_offset)
    known = there & lay.has_header_len[row]
    header = known & (pos < lay.header_len[row])
    cert = there & (lay.has_cert_lo & lay.has_cert_hi)[row] & (pos >= lay.cert_lo[row]) & (pos < lay.cert_hi[row])
    past = there & lay.has_file_size[row] & (pos >= lay.file_size[row])
    tail = there & lay.has_overlay_offset[row] & (pos >= lay.overlay_offset[row])
    status = np.where(tail, np.where(past, UNMAPPED, OVERLAY), PADDING)
    status[cert] = np.where(past[cert], TRUNCATED, CERTIFICATE)
    at = np.flatnonzero(n > 0)
    r = own[at]
    into = pos[at] - lay.raw_lo[r]
    status[at] = np.where(past[at], TRUNCATED, np.where(into < lay.mapped[r], OK, PADDING))
    status[header] = np.where(past[header], TRUNCATED, HEADERS)
    status[known & (n + header + cert > 1)] = OVERLAPPING
    value, has = pos.copy(), status == HEADERS
    value[at] = np.where(status[at] == OK, lay.rva[r] + into, pos[at])
    has[at] |= (status[at] == OK) & lay.has_rva[r]
    return status, value, has


def _from_rva(lay: _Layouts, row, pos, there):
    """Candidate status and value of a target address, before the reverse check."""
    n, own = lay.owners(row, pos, there, lay.rva, lay.vsize, lay.in_rva)
    known = there & lay.has_header_len[row]
    header = known & (pos < lay.header_len[row])
    status = np.full(len(pos), UNMAPPED)
    status[header] = np.where((lay.has_file_size[row] & (pos >= lay.file_size[row]))[header], TRUNCATED, HEADERS)
    at = np.flatnonzero(n > 0)
    r = own[at]
    into = pos[at] - lay.rva[r]
    back = lay.raw_lo[r] + into
    past = lay.has_file_size[row[at]] & (back >= lay.file_size[row[at]])
    status[at] = np.where(into >= lay.mapped[r], VIRTUAL_ONLY, np.where(past, TRUNCATED, OK))
    status[known & (n + header > 1)] = OVERLAPPING
    value, has = pos.copy(), status == HEADERS
    value[at] = np.where(status[at] == OK, back, pos[at])
    has[at] |= status[at] == OK
    return status, value, has


def _resolve(lay: _Layouts, row, pos, there, direction: str):
    """(status, value, has value); an answer holds only if the way back returns the same point."""
    go, back = (_from_offset, _from_rva) if direction == "offset" else (_from_rva, _from_offset)
    status, value, has = go(lay, row, pos, there)
    at = np.flatnonzero(has)
    again, point, found = back(lay, row[at], value[at], np.ones(len(at), bool))
    agrees = np.zeros(len(pos), bool)
    agrees[at] = found & (again <= HEADERS) & (point == pos[at])
    status[(status <= HEADERS) & ~agrees] = OVERLAPPING
    return status, value, agrees


def _sorted_unique(row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.append(True, (row[1:] != row[:-1]) | (values[1:] != values[:-1]))[: len(row)]
    return row[new], values[new]


def _cut_points(lay: _Layouts, use: np.ndarray, direction: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) where the layout of the rows in ``use`` changes, by row and position.

    The boundaries of one space, and those of the other space pulled back into it.
    """
    rows = np.flatnonzero(use)

    def bounds(names, lo, size, usable):
        parts = [(rows, np.zeros(len(rows), np.int64))]
        for name in names:
            there = use & getattr(lay, f"has_{name}")
            parts.append((np.flatnonzero(there), getattr(lay, name)[there]))
        usable = usable & use[lay.row]
        parts += [(lay.row[usable], (lo + more)[usable]) for more in (0, lay.mapped, size)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    off = bounds(LAYOUT[:-1], lay.raw_lo, lay.raw_size, lay.in_offset)
    rva = bounds(LAYOUT[:2], lay.rva, lay.vsize, lay.in_rva)
    own, (row, b), to, back = (off, rva, lay.rva, lay.raw_lo) if direction == "offset" else (rva, off, lay.raw_lo, lay.rva)
    head = lay.has_header_len[row] & (b >= 0) & (b <= lay.header_len[row])
    parts = [own, (row[head], b[head])]
    for at, r in lay.met(row, np.ones(len(row), bool)):
        hit = lay.placed[r] & (b[at] >= to[r]) & (b[at] - to[r] <= lay.mapped[r])
        at, r = at[hit], r[hit]
        parts.append((row[at], back[r] + b[at] - to[r]))
    return _sorted_unique(*(np.concatenate(x) for x in zip(*parts)))


def _cut(lay: _Layouts, lo, hi, direction: str):
    """(row, start, end, pieces per row) of intervals cut where the layout of their row changes.

    Rows of one sample mostly follow one another after a join; equal neighbours share their cut points.
    """
    new = lay.differs()
    owner, at = _cut_points(lay, new, direction)
    sizes = np.bincount(owner, minlength=len(lo))
    source = np.maximum.accumulate(np.where(new, np.arange(len(lo)), 0))
    n = sizes[source]
    row = np.repeat(np.arange(len(lo)), n)
    c = at[np.repeat((np.cumsum(sizes) - sizes)[source] - (np.cumsum(n) - n), n) + np.arange(len(row))]
    inside = (c > lo[row]) & (c < hi[row])
    sizes = 1 + np.bincount(row[inside], minlength=len(lo))
    ends = np.cumsum(sizes)
    is_first = np.zeros(int(sizes.sum()), bool)
    is_first[ends - sizes] = True
    start = np.empty(len(is_first), np.int64)
    start[is_first], start[~is_first] = lo, c[inside]
    end = np.append(start[1:], 0)[: len(start)]
    end[ends - 1] = hi
    return np.repeat(np.arange(len(lo)), sizes), start, end, sizes


def _sampled(lay: _Layouts, row, lo, hi) -> tuple[np.ndarray, np.ndarray]:
    """Points and errors per row: start, middle and end of each segment must return."""
    mid, last = lo + (hi - lo) // 2, hi - 1
    two, three = mid != lo, (last != lo) & (last != mid)
    pos, at = np.concatenate([lo, mid[two], last[three]]), np.concatenate([row, row[two], row[three]])
    status, value, has = _resolve(lay, at, pos, np.ones(len(pos), bool), "offset")
    again, point, found = _resolve(lay, at, value, has, "rva")
    good = has & found & (point == pos)
    return np.bincount(at, minlength=len(lay.n)), np.bincount(at[~good], minlength=len(lay.n))


def _status(codes: np.ndarray) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(codes, pa.int8()), pa.array(STATUSES)).dictionary_decode()


def points(direction: str, pos: Column) -> Column:
    """Struct (status, value) of the position on each row."""

    def run(pos, *layout):
        p, there = _numbers(pos)
        status, value, has = _resolve(_Layouts(*layout), np.arange(len(p)), p, there, direction)
        return pa.StructArray.from_arrays([_status(status), _maybe(value, has)], names=["status", "value"])

    return F.arrow_udf(run, "status string, value bigint")(pos.cast("bigint"), *LAYOUT)


def pieces(direction: str) -> Column:
    """Array of (src_lo, src_hi, status, value): the interval [lo, hi) of each row, cut where its layout changes."""

    def run(lo, hi, *layout):
        lay = _Layouts(*layout)
        row, start, end, sizes = _cut(lay, _numbers(lo)[0], _numbers(hi)[0], direction)
        status, value, has = _resolve(lay, row, start, np.ones(len(row), bool), direction)
        members = pa.StructArray.from_arrays([pa.array(start), pa.array(end), _status(status), _maybe(value, has)], names=["src_lo", "src_hi", "status", "value"])
        return _listed(sizes, members)

    return F.arrow_udf(run, "array<struct<src_lo bigint, src_hi bigint, status string, value bigint>>")(F.col("lo").cast("bigint"), F.col("hi").cast("bigint"), *LAYOUT)


def round_trips() -> Column:
    """Struct (points, errors) of the mapped segment [src_lo, src_hi) on each row."""

    def run(lo, hi, *layout):
        lay = _Layouts(*layout)
        n, errors = _sampled(lay, np.arange(len(lay.n)), _numbers(lo)[0], _numbers(hi)[0])
        return pa.StructArray.from_arrays([pa.array(n), pa.array(errors)], names=["points", "errors"])

    return F.arrow_udf(run, "points bigint, errors bigint")(F.col("src_lo").cast("bigint"), F.col("src_hi").cast("bigint"), *LAYOUT)


def coverage() -> Column:
    """Struct (total_bytes, ok_bytes, points, errors) of the source interval [lo, hi) on each row."""

    def run(lo, hi, *layout):
        lay = _Layouts(*layout)
        row, start, end, sizes = _cut(lay, _numbers(lo)[0], _numbers(hi)[0], "offset")
        status, _, _ = _resolve(lay, row, start, np.ones(len(row), bool), "offset")
        ok = status <= HEADERS
        n, errors = _sampled(lay, row[ok], start[ok], end[ok])
        first = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(x, first) for x in (end - start, np.where(ok, end - start, 0))] if len(first) else [n, n]
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (*sums, n, errors)], names=["total_bytes", "ok_bytes", "points", "errors"])

    return F.arrow_udf(run, "total_bytes bigint, ok_bytes bigint, points bigint, errors bigint")(F.col("lo").cast("bigint"), F.col("hi").cast("bigint"), *LAYOUT)
