"""Small Arrow kernels for scans that read content.

Each kernel handles one batch of rows inside a Spark task; partitioning,
shuffles and every later step stay with Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def codes_of(text: str | bytes) -> np.ndarray:
    """Symbols of one sample: code points of a string, values of a byte string."""
    if isinstance(text, str):
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.frombuffer(text, dtype=np.uint8)


def tile_counts(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(tiles x alphabet) counts plus the alphabet, over the real symbols only."""
    alphabet, dense = np.unique(codes, return_inverse=True)
    n_tiles = max(1, -(-codes.size // size))
    if codes.size == 0:
        return np.zeros((1, 0), dtype=np.int64), alphabet
    key = (np.arange(codes.size, dtype=np.int64) // size) * alphabet.size + dense
    return np.bincount(key, minlength=n_tiles * alphabet.size).reshape(n_tiles, alphabet.size), alphabet


def entropy_rows(counts: np.ndarray) -> np.ndarray:
    """Shannon entropy in bits per row of counts; an empty row scores 0."""
    c = counts.astype(np.float64)
    n = c.sum(axis=1)
    weighted = np.where(c > 0, c * np.log2(np.where(c > 0, c, 1.0)), 0.0).sum(axis=1)
    safe = np.where(n > 0, n, 1.0)
    return np.where(n > 0, np.log2(safe) - weighted / safe, 0.0)


def tile_entropy_batches(size: int):
    """(sample_id, content) -> (sample_id, tile, n_units, entropy)."""

    def run(batches):
        for batch in batches:
            ids, tiles, sizes, values = [], [], [], []
            for sid, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = codes_of(content or "")
                counts, _ = tile_counts(codes, size)
                ent = entropy_rows(counts)
                ids.append(np.full(ent.size, sid, dtype=np.int64))
                tiles.append(np.arange(ent.size, dtype=np.int64))
                sizes.append(counts.sum(axis=1).astype(np.int64))
                values.append(ent)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (ids, tiles, sizes, values)],
                    names=["sample_id", "tile", "n_units", "entropy"],
                )

    return run


def known_symbols(content, runs) -> tuple[np.ndarray, np.ndarray | None]:
    """Symbols of one sample and their positions; with ``runs`` (all lo, all hi) only those inside a run.

    Positions are None for a sample without a mask: its symbols stand side by side.
    """
    codes = codes_of(content or b"")
    if runs is None:
        return codes, None
    lo = np.maximum(runs[0], 0)
    n = np.maximum(np.minimum(runs[1], codes.size) - lo, 0)
    at = np.arange(int(n.sum()), dtype=np.int64) + np.repeat(lo - (np.cumsum(n) - n), n)
    return codes[at], at


def fill_batches(batches):
    """(sample_id, size, offs, bytes, runs) -> (sample_id, content, runs); unknown bytes are zero."""
    for batch in batches:
        out = []
        for size, offs, values in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            data = np.zeros(size, np.uint8)
            data[offs or []] = values or []
            out.append(data.tobytes())
        runs = [r or [] for r in batch.column(4).to_pylist()]
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(runs, kind)], names=["sample_id", "content", "runs"])


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_DIGIT = np.full(256, 255, np.uint8)
for _chars, _first in ((b"0123456789", 0), (b"ABCDEF", 10), (b"abcdef", 10)):
    _DIGIT[np.frombuffer(_chars, np.uint8)] = np.arange(_first, _first + len(_chars))
_DIGIT[ord("?")] = 128


def dump_tokens(offsets: np.ndarray, payloads: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the tokens of some lines, in order; -1 stands for ``??``, other shapes are left out."""
    text = np.frombuffer("\n".join(payloads).encode("utf-8", "surrogatepass"), np.uint8)
    gap = np.concatenate(([True], _SPACE[text], [True]))
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    line = np.searchsorted(np.flatnonzero(text == 10), starts)
    first = np.searchsorted(line, np.arange(len(payloads)))
    at = offsets[line] + np.arange(line.size) - first[line]
    pair = ends - starts == 2
    high, low = _DIGIT[text[starts[pair]]].astype(np.int64), _DIGIT[text[starts[pair] + 1]].astype(np.int64)
    value = np.where((high < 16) & (low < 16), 16 * high + low, np.where((high == 128) & (low == 128), -1, -2))
    return at[pair][value > -2], value[value > -2]


#: Samples unpacked at a time; rows, and bytes of content, after which a kernel hands its batch over.
UNPACK, FLUSH_ROWS, FLUSH_BYTES = 64, 1 << 18, 1 << 22


def _contents(ids: pa.Array, at: list[int], contents: list[bytes], edges: list[np.ndarray]) -> pa.RecordBatch:
    """Rows ``at`` with their contents and valid runs, given as edges lo, hi, lo, hi."""
    flat = np.concatenate(edges).astype(np.int64)
    ends = np.cumsum([0, *(e.size // 2 for e in edges)]).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(flat[::2]), pa.array(flat[1::2])], names=["lo", "hi"])
    lists = pa.ListArray.from_arrays(pa.array(ends), runs)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(contents, pa.binary()), lists], names=["sample_id", "content", "runs"])


def dump_batches(batches, step: int = 4096):
    """(sample_id, offsets, payloads) -> (sample_id, content, runs); a later line wins. Tokens are read ``step`` lines at a time."""
    for batch in batches:
        rows, contents, edges, held = [], [], [], 0
        for i in range(batch.num_rows):
            offsets, payloads = batch.column(1)[i].values.to_numpy(), batch.column(2)[i].values
            value, size = np.zeros(int(offsets.max(initial=0)) + 64, np.int16), 0
            for lo in range(0, len(payloads), step):
                at, v = dump_tokens(offsets[lo : lo + step], payloads.slice(lo, step).to_pylist())
                if at.size:
                    size = max(size, int(at.max()) + 1)
                    if size > value.size:
                        value = np.concatenate((value, np.zeros(size, np.int16)))
                    value[at] = np.where(v < 0, 0, v + 1)
            if not size:
                continue
            value = value[:size]
            rows.append(i)
            edges.append(np.flatnonzero(np.diff(np.concatenate(([False], value > 0, [False])))))
            contents.append(np.maximum(value - 1, 0).astype(np.uint8).tobytes())
            held += size
            if len(rows) == UNPACK or held > FLUSH_BYTES:
                yield _contents(batch.column(0), rows, contents, edges)
                rows, contents, edges, held = [], [], [], 0
        if rows:
            yield _contents(batch.column(0), rows, contents, edges)


def _runs(lists: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(all lo, all hi) of each list; a null list has no run."""
    lo, hi = (lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
    ends, known = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
    return [(lo[a:b], hi[a:b]) if k else (lo[:0], hi[:0]) for a, b, k in zip(ends[:-1], ends[1:], known)]


def _samples(batch):
    """(sample_id, content, runs) of each row; runs are None where the batch has no mask."""
    for at in range(0, batch.num_rows, UNPACK):
        part = batch.slice(at, UNPACK)
        runs = _runs(part.column(2)) if part.num_columns > 2 else [None] * part.num_rows
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), runs)


def _known_counts(codes: np.ndarray, at: np.ndarray, size: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tile, code, count) of symbols at these positions, by tile and code."""
    base = 256 if codes.dtype == np.uint8 else 0x110000
    key = (at // size if size else np.zeros_like(at)) * base + codes
    if key.size and key.max() < 1 << 22:
        counts = np.bincount(key)
        key = np.flatnonzero(counts)
        cnt = counts[key]
    else:
        key, cnt = np.unique(key, return_counts=True)
    return key // base, key % base, cnt


def histogram_batches(size: int | None, keep_empty: bool = False):
    """(sample_id, content[, runs]) -> (sample_id, tile, code, cnt), already summed per tile.

    With ``keep_empty`` a sample without (known) symbols has one row of code -1 and count 0.
    """

    def run(batches):
        for batch in batches:
            out, held = [[], [], [], []], 0
            for sid, content, runs in _samples(batch):
                codes, at = known_symbols(content, runs)
                if keep_empty and not codes.size:
                    t, a, cnt = np.zeros(1, np.int64), np.full(1, -1), np.zeros(1, np.int64)
                elif at is None:
                    counts, alphabet = tile_counts(codes, size or max(1, codes.size))
                    t, a = np.nonzero(counts)
                    cnt = counts[t, a]
                    a = alphabet[a]
                else:
                    t, a, cnt = _known_counts(codes, at, size)
                out[0].append(np.full(t.size, sid, dtype=np.int64))
                out[1].append(t.astype(np.int64))
                out[2].append(a.astype(np.int64))
                out[3].append(cnt.astype(np.int64))
                held += t.size
                if held > FLUSH_ROWS:
                    yield _rows(out, ["sample_id", "tile", "code", "cnt"])
                    out, held = [[], [], [], []], 0
            if out[0]:
                yield _rows(out, ["sample_id", "tile", "code", "cnt"])

    return run


def _rows(out: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)


def share_vector_batches(buckets: int, rows: int = 512):
    """(sample_id, bytes, carried...) -> (sample_id, shares, carried...), ``rows`` vectors a batch.

    The dense vector of a sample: shares of its bytes, then of its hashed pairs; without bytes the
    byte part is uniform. What is carried passes through.
    """

    def vector(content) -> np.ndarray:
        data, _ = known_symbols(content, None)
        data = data.astype(np.int64)
        out = np.zeros(256 + buckets)
        out[:256] = np.bincount(data, minlength=256) / data.size if data.size else 1.0 / 256
        if data.size > 1:
            out[256:] = np.bincount(((data[:-1] << 8) | data[1:]) % buckets, minlength=buckets) / (data.size - 1)
        return out

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                shares = np.concatenate([vector(c) for c in part.column(1).to_pylist()])
                ends = np.arange(part.num_rows + 1, dtype=np.int32) * (256 + buckets)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(shares))
                names = part.schema.names
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *part.columns[2:]], names=[names[0], "shares", *names[2:]])

    return run


def bigram_batches(buckets: int, block: int | None = None):
    """(sample_id, bytes[, runs]) -> sparse counts (sample_id, block, kind, bucket, cnt).

    ``kind`` 0 is the byte histogram, 1 the hashed pair histogram, 2 marks a sample without
    bytes by one row. With ``block`` each block's own bytes and inner pairs are counted
    separately. Known bytes count as neighbours across what is unknown between them.
    """

    def run(batches):
        for batch in batches:
            out, held = [[], [], [], [], []], 0
            for sid, content, runs in _samples(batch):
                if held > FLUSH_ROWS:
                    yield _rows(out, ["sample_id", "block", "kind", "bucket", "cnt"])
                    out, held = [[], [], [], [], []], 0
                data, _ = known_symbols(content, runs)
                data = data.astype(np.int64)
                step = block or max(1, data.size)
                for b in range(max(1, -(-data.size // step))):
                    part = data[b * step : (b + 1) * step]
                    uni = np.bincount(part, minlength=256)
                    pairs = np.bincount(((part[:-1] << 8) | part[1:]) % buckets, minlength=buckets) if part.size > 1 else np.zeros(0, dtype=np.int64)
                    for kind, counts in ((0, uni), (1, pairs), (2, np.array([int(data.size == 0)]))):
                        nz = np.nonzero(counts)[0]
                        out[0].append(np.full(nz.size, sid, dtype=np.int64))
                        out[1].append(np.full(nz.size, b, dtype=np.int64))
                        out[2].append(np.full(nz.size, kind, dtype=np.int32))
                        out[3].append(nz.astype(np.int64))
                        out[4].append(counts[nz].astype(np.int64))
                        held += nz.size
            if out[0]:
                yield _rows(out, ["sample_id", "block", "kind", "bucket", "cnt"])

    return run


def regex_span_batches(rules: dict[str, str]):
    """(sample_id, text) -> (sample_id, rule, lo, hi) for every non-empty match."""

    def run(batches):
        import re

        compiled = [(name, re.compile(pattern)) for name, pattern in rules.items()]
        for batch in batches:
            out = [[], [], [], []]
            for sid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for name, rx in compiled:
                    for m in rx.finditer(text or ""):
                        if m.end() > m.start():
                            out[0].append(sid)
                            out[1].append(name)
                            out[2].append(m.start())
                            out[3].append(m.end())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())],
                names=["sample_id", "rule", "lo", "hi"],
            )

    return run


def inflate_batches(chunk: int):
    """(sample_id, bytes) -> (sample_id, chunk, content, exclusion_reason); zlib in memory only.

    Content leaves in pieces of at most ``chunk`` bytes, so its size is not bounded by a
    column value; a stream that breaks off gives one row with the reason and no piece.
    """

    def pieces(raw):
        import zlib

        engine, out, rest = zlib.decompressobj(), [], raw or b""
        try:
            while True:
                part = engine.decompress(rest, chunk)
                if part:
                    out.append(part)
                if engine.eof:
                    return out or [b""], None
                rest = engine.unconsumed_tail
                if not part and not rest:
                    return [None], "decompress_error:truncated"
        except zlib.error as exc:
            return [None], f"decompress_error:{type(exc).__name__}"

    def run(batches):
        for batch in batches:
            for sid, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, reason = pieces(raw.as_py())
                for k, part in enumerate(found):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([sid], pa.string()), pa.array([k], pa.int32()), pa.array([part], pa.binary()), pa.array([reason], pa.string())],
                        names=["sample_id", "chunk", "content", "exclusion_reason"],
                    )

    return run
