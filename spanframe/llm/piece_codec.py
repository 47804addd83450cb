"""SentencePiece encoding and decoding through a distinct-chunk table.

Pieces of the model never cross a white-space mark from a word into the next, so a text
is the join of its marked words (a run of marks and what follows up to the next mark)
and a marked word has the same ids wherever it stands.

1. Documents are taken in blocks of about 24 million characters where they are read. Each
   block sends its distinct marked words to the buckets of the chunk table; a word has
   one bucket in the whole corpus. Words travel packed, one row per block and bucket.
2. A bucket segments each distinct word once and answers every block with its ids. What
   it holds is its share of the distinct words.
3. The block's documents, as positions into its word list, meet the answers and ids are
   joined back by position, then decoded.

Blocks are named by the hash of their texts and built twice, once for each side, so the
input must be a plan that gives the same rows again: a table or a checkpoint. A block
that does not meet all its words raises an error, so nothing is lost in silence. A word
that is in every block costs one entry per block; no text is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.common import partitions
from spanframe.llm.registry import query, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
BLOCK_CHARS = 24_000_000
_MARKED = re.compile(" ( *[^ ]*)")
_PROBE = "Ab  c\t\né ﬁ 　xİé 9½\x00 z "
_OPEN: dict[str, "Codec"] = {}


class Codec:
    """A model whose pieces keep to marked words; anything else is refused."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model cross white-space marks")
        if self.sp.normalize(_PROBE) != MARK + _PROBE.replace(" ", MARK):
            raise ValueError("this model rewrites texts before it segments them")
        self.lone = [self.sp.piece_to_id(MARK)]

    def words(self, text: str) -> list[str]:
        """Marked words without their first mark; further marks are spaces."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        return _MARKED.findall(" " + text) if "  " in text or text[0] == " " else text.split(" ")

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; the empty word is a mark that stands alone."""
        return [ids if w else self.lone for w, ids in zip(words, self.sp.encode(words, num_threads=1))] if words else []


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def open_codec(path: str | None) -> Codec:
    path = path or model_path()
    if path not in _OPEN:
        _OPEN[path] = Codec(path)
    return _OPEN[path]


class _Codes(dict):
    def __missing__(self, word):
        self[word] = code = len(self)
        return code


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Unsigned 32-bit arrays by byte planes, compressed."""
    planes = b"".join(len(a).to_bytes(4, "little") + np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=5).compress(planes)


def _open(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        planes = np.frombuffer(raw, np.uint8, 4 * n, at + 4).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view("<u4").reshape(-1))
        at += 4 + 4 * n
    return out


def _blocks(batches, codec: Codec, limit: int):
    """(key, ids, word codes per document, words by code) of runs of documents."""
    for b in batches:
        texts, first, chars = [], 0, 0
        for row in range(b.num_rows + 1):
            if row == b.num_rows or chars >= limit:
                if texts:
                    codes, name = _Codes(), xxhash.xxh64()
                    coded = []
                    for t in texts:
                        name.update(t.encode())
                        name.update(b"\xff")
                        coded.append(np.fromiter(map(codes.__getitem__, codec.words(t)), np.uint32))
                    yield np.uint64(name.intdigest()).astype(np.int64).item(), b.column(0).slice(first, row - first), coded, list(codes)
                texts, first, chars = [], row, 0
            if row < b.num_rows:
                texts.append(b.column(1)[row].as_py() or "")
                chars += len(texts[-1])


def _dealt(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the words by (bucket, word), and their buckets in that order."""
    bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    order = order[np.argsort(bucket[order], kind="stable")]
    return order, bucket[order]


def encode_blocks(docs: DataFrame, id_col: str, text_col: str, model: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks that met their words: (block, part, payload, ids, sizes), in order within a partition."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    buckets = partitions(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))

    def ask(batches):
        codec = open_codec(model)
        for key, _, _, words in _blocks(batches, codec, block_chars):
            order, bucket = _dealt(words, buckets)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(order) else []
            out = ([], [])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                raw = [words[i].encode() for i in order[lo:hi]]
                sizes = _squeeze(np.array([len(w) for w in raw]))
                out[0].append(int(bucket[lo]))
                out[1].append(len(sizes).to_bytes(4, "little") + sizes + zstandard.compress(b"".join(raw), 3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), pa.array([key] * len(out[0]), pa.int64()), pa.array(out[1], pa.binary())], names=["bucket", "block", "payload"])

    def answer(batches):
        codec, now, table_ = open_codec(model), None, {}
        for b in batches:
            block, part, payload = [], [], []
            for bucket, key, data in zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "payload"))):
                if bucket != now:
                    now, table_ = bucket, {}
                n = int.from_bytes(data[:4], "little")
                ends = np.cumsum(_open(data[4 : 4 + n])[0]).tolist()
                raw = zstandard.decompress(data[4 + n :])
                words = [raw[a:z].decode() for a, z in zip([0, *ends], ends)]
                new = [w for w in words if w not in table_]
                table_.update(zip(new, (np.array(x, "<u4") for x in codec.segment(new))))
                ids = [table_[w] for w in words]
                block.append(key)
                part.append(bucket)
                payload.append(_squeeze(np.array([len(x) for x in ids]), np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(payload, pa.binary())], names=["block", "part", "payload"])

    def code(batches):
        codec = open_codec(model)
        for key, ids, coded, words in _blocks(batches, codec, block_chars):
            order, _ = _dealt(words, buckets)
            flat, n = np.concatenate(coded).astype(np.int64), len(coded)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            # small numbers for frequent words; words of one count stay in the order of the list
            ranked = np.lexsort((place, -np.bincount(flat, minlength=len(words))))
            rank = np.empty(len(order), np.int64)
            rank[ranked] = np.arange(len(order))
            listed = np.diff(place[ranked], prepend=0).astype(np.int32).view(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([len(words)], pa.int32()), pa.array([_squeeze(rank[flat], listed)], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids),
                 pa.array([[len(c) for c in coded]], pa.list_(pa.int32()))], names=["block", "n_words", "payload", "ids", "sizes"])

    asked = rows.mapInArrow(ask, "bucket int, block bigint, payload binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    answers = asked.mapInArrow(answer, "block bigint, part int, payload binary")
    coded = rows.mapInArrow(code, f"block bigint, n_words int, payload binary, ids array<{kind}>, sizes array<int>")
    both = answers.select("block", "part", F.lit(None).cast("int").alias("n_words"), "payload", F.lit(None).cast(f"array<{kind}>").alias("ids"), F.lit(None).cast("array<int>").alias("sizes")).unionByName(
        coded.select("block", F.lit(2**31 - 1).alias("part"), "n_words", "payload", "ids", "sizes"))
    return both.repartition("block").sortWithinPartitions("block", "part")


def encoded(batches, emit):
    """Walks ordered block rows; ``emit(ids column, [token ids of each document])`` makes a batch."""
    now, parts, met = None, {}, None
    for b in batches:
        ids_column = b.column("ids")
        for row, (block, part, n_words, data, sizes) in enumerate(zip(*(b.column(c).to_pylist() for c in ("block", "part", "n_words", "payload", "sizes")))):
            if block != now:
                now, parts, met = block, {}, None
            if n_words is None:
                parts[part] = data  # a block that occurs twice gets the same answer twice
                continue
            if met is None:
                opened = [_open(parts[k]) for k in sorted(parts)]
                lengths = np.concatenate([x[0] for x in opened]).astype(np.int64) if opened else np.zeros(0, np.int64)
                flat = np.concatenate([x[1] for x in opened]) if opened else np.zeros(0, np.uint32)
                met = lengths, np.cumsum(lengths) - lengths, flat
            lengths, starts, flat = met
            if len(lengths) != n_words:
                raise RuntimeError("a block did not meet all its words: the input gave other rows when read again")
            ranks, listed = _open(data)
            codes = np.cumsum(listed.view(np.int32), dtype=np.int64)[ranks]
            ends = np.cumsum(sizes) if sizes else []
            docs = []
            for n, end in zip(sizes, ends):
                own = codes[end - n : end]
                size = lengths[own]
                docs.append(flat[np.repeat(starts[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())])
            yield emit(ids_column[row].values, docs)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row; a null or empty text has no ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        return encoded(batches, lambda ids, found: pa.RecordBatch.from_arrays(
            [ids, pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))], names=["id", "ids"]))

    return encode_blocks(docs, id_col, text_col, model).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def codec_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.

    A null or empty text has no tokens and decodes to the empty text. Ids may be null or
    repeat; every row gets its own result. An empty table gives no rows; other columns
    are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        sp = open_codec(model).sp
        names = [str(i) for i in range(sp.get_piece_size())]

        def emit(ids, found):
            n, told, decoded = [], [], []
            for x in found:
                tokens = x.tolist()
                n.append(len(tokens))
                told.append(hashlib.sha256(",".join([names[i] for i in tokens]).encode()).hexdigest())
                decoded.append(hashlib.sha256(sp.decode(tokens).encode()).hexdigest() if tokens else hashlib.sha256().hexdigest())
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return encoded(batches, emit)

    out = encode_blocks(docs, id_col, text_col, model).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return codec_digests(table(spark, sf, "documents"))
