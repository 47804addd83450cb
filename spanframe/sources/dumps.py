"""Address-prefixed hex dumps, segment listings and binary samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.functions import kernels
from spanframe.operators.intervals import normalize


LINE = r"^([0-9A-Fa-f]+)\s+(.*\S)\s*$"  # an address of any width, then byte tokens
LISTED = r"^([^:\s]+):([0-9A-Fa-f]{6,16})\b"  # a segment name and an address of 6 to 16 digits


#: Addresses are unsigned 64-bit numbers: at most 16 digits after leading zeros.
ADDRESS = "decimal(20,0)"


def _address(digits: Column) -> Column:
    """The number that hex digits spell, null above 64 bits. Halves are converted apart, as long values overflow."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    padded = F.lpad(short, 16, "0")
    half = lambda at: F.conv(F.substring(padded, at, 8), 16, 10).cast(ADDRESS)
    return F.when(F.length(short) <= 16, (half(1) * F.lit(1 << 32).cast("decimal(10,0)") + half(9)).cast(ADDRESS))


def _address_lines(df: DataFrame, text: str) -> DataFrame:
    """Every line that starts with an address: its number, that of the sample's first line, and their distance."""
    # one pass of the pattern per line: no line holds a line feed, so one parts address and payload of a match
    parted = F.transform(F.split(text, "\r?\n"), lambda x: F.regexp_replace(x, F.lit(LINE), F.lit("$1\n$2")))
    lines = df.select("sample_id", F.posexplode(parted).alias("line_no", "_l")).filter(F.instr("_l", "\n") > 0)
    hit = lines.select(
        "sample_id", "line_no", F.substring_index("_l", "\n", 1).alias("_a"), F.substring_index("_l", "\n", -1).alias("payload")
    ).withColumn("addr", _address(F.col("_a")))
    base = F.first("addr", ignorenulls=True).over(Window.partitionBy("sample_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return hit.withColumn("base", base).withColumn("offset", F.expr("try_cast(addr - base as bigint)"))  # lines of one text row


def parse_hex_dumps(df: DataFrame, text: str) -> DataFrame:
    """One row per address line: line_no, addr, base, offset, payload, n_tokens.

    Addresses are decimal(20,0), so any 64-bit one fits; ``offset`` is the distance from the
    first. Other lines are dropped; ``refused_lines`` lists the address lines that are. df:
    sample_id and the dump text. ``refused_dumps`` names the samples that have no such line.
    """
    out = _address_lines(df, text).filter("offset >= 0")
    return out.select("sample_id", "line_no", "addr", "base", "offset", "payload", F.size(F.split("payload", r"\s+")).alias("n_tokens"))


def refused_lines(df: DataFrame, text: str) -> DataFrame:
    """(sample_id, line_no, address, reason) of address lines that hold no place: over 64 bits, below
    the first address, or further from it than a signed 64-bit distance."""
    reason = F.when(F.col("addr").isNull(), "address_too_long").when(F.col("addr") < F.col("base"), "below_base").when(F.col("offset").isNull(), "too_far")
    return _address_lines(df, text).select("sample_id", "line_no", F.col("_a").alias("address"), reason.alias("reason")).filter("reason is not null")


def refused_dumps(df: DataFrame, text: str) -> DataFrame:
    """(sample_id, reason) of dumps that hold nothing to read: empty, binary, or without an address line."""
    body = F.coalesce(F.col(text), F.lit(""))
    reason = (
        F.when(F.trim(body) == "", "empty").when(F.instr(body, "\u0000") > 0, "binary")
        .when(~F.exists(F.split(body, "\r?\n"), lambda x: x.rlike(LINE)), "no_address_line")
    )
    return df.select("sample_id", reason.alias("reason")).filter("reason is not null")


def read_hex_dumps(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1).alias("sample_id"), "value")
    return parse_hex_dumps(docs, "value")


def assemble_dump(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid bytes, per-sample facts, malformed tokens); a later line wins, ``??`` and gaps are not bytes."""
    tok = lines.select("sample_id", "line_no", "offset", F.posexplode(F.split("payload", r"\s+")).alias("i", "t"))
    tok = tok.withColumn("off", F.col("offset") + F.col("i"))
    shaped = F.col("t").rlike("^([0-9A-Fa-f]{2}|[?]{2})$")
    bad = tok.filter(~shaped).select("sample_id", "line_no", "i", F.col("t").alias("token"))
    cell = tok.filter(shaped).groupBy("sample_id", "off").agg(F.max_by("t", "line_no").alias("t"))
    valid = cell.filter("t <> '??'").select("sample_id", "off", F.conv("t", 16, 10).cast("int").alias("byte"))
    facts = cell.groupBy("sample_id").agg((F.max("off") + 1).alias("size"), F.count(F.when(F.col("t") != "??", F.lit(1))).alias("n_valid"))
    return valid, facts.withColumn("valid_fraction", F.col("n_valid") / F.col("size")), bad


def valid_runs(valid: DataFrame) -> DataFrame:
    """(sample_id, lo, hi): runs of neighbouring valid bytes, of a sample of any size."""
    return normalize(valid.select("sample_id", F.col("off").alias("lo"), (F.col("off") + 1).alias("hi")), ["sample_id"])


def masked_content(valid: DataFrame, facts: DataFrame) -> DataFrame:
    """(sample_id, content, runs): the bytes of each dump, zero where unknown, and its valid runs.

    A sample's content is one row value, like everywhere in the library. ``facts`` keeps
    the samples without a valid byte; they have no run.
    """
    runs = valid_runs(valid).groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    cells = valid.groupBy("sample_id").agg(F.collect_list("off").alias("offs"), F.collect_list("byte").alias("bytes"))
    rows = facts.select("sample_id", "size").join(cells, "sample_id", "left").join(runs, "sample_id", "left")
    return rows.select("sample_id", "size", "offs", "bytes", "runs").mapInArrow(
        kernels.fill_batches, f"sample_id {dict(valid.dtypes)['sample_id']}, content binary, runs array<struct<lo:bigint,hi:bigint>>")


def dump_content(lines: DataFrame) -> DataFrame:
    """(sample_id, content, runs) of parsed lines: ``masked_content`` of what ``assemble_dump`` makes of them.

    Lines, not bytes, are shuffled and collected: a sample's lines are put together by the
    task that writes its content. A sample without a well-formed token gives no row.
    """
    own = lines.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "offset", "payload"))).alias("l"))
    kind = dict(lines.dtypes)["sample_id"]
    return own.select("sample_id", F.col("l.offset").alias("offsets"), F.col("l.payload").alias("payloads")).mapInArrow(
        kernels.dump_batches, f"sample_id {kind}, content binary, runs array<struct<lo:bigint,hi:bigint>>")


def parse_segment_listing(df: DataFrame, text: str) -> DataFrame:
    """Lowest and highest address, decimal(20,0), per segment name of ``name:ADDR`` lines."""
    lines = df.select("sample_id", F.explode(F.split(text, "\r?\n")).alias("_l"))
    hit = lines.select("sample_id", F.regexp_extract("_l", LISTED, 1).alias("name"), F.regexp_extract("_l", LISTED, 2).alias("_a")).filter("_a <> ''")
    addr = _address(F.col("_a"))
    return hit.groupBy("sample_id", "name").agg(F.min(addr).alias("lo"), F.max(addr).alias("hi"))


def read_segment_listing(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1).alias("sample_id"), "value")
    return parse_segment_listing(docs, "value")


def inflate_samples(ids: DataFrame, blobs: DataFrame, chunk: int = 1 << 26) -> DataFrame:
    """sample_id, chunk, content, exclusion_reason for every wanted id; inflated in memory only.

    Content comes in pieces of ``chunk`` bytes, in order, of any total size. The wanted names,
    a narrow table, meet the compressed blobs in a semi join ahead of inflating, so the plan
    can send the names to the scan; missing ids come from names alone.
    """
    wanted = ids.select("sample_id").distinct()
    have = blobs.select("sample_id", "content").join(wanted, "sample_id", "left_semi")
    out = have.mapInArrow(kernels.inflate_batches(chunk), "sample_id string, chunk int, content binary, exclusion_reason string")
    gone = wanted.join(blobs.select("sample_id").distinct(), "sample_id", "left_anti")
    missing = gone.select("sample_id", F.lit(0).alias("chunk"), F.lit(None).cast("binary").alias("content"), F.concat(F.lit("missing:"), "sample_id").alias("exclusion_reason"))
    return out.unionByName(missing)


def inflated_lengths(pieces: DataFrame) -> DataFrame:
    """sample_id, length, exclusion_reason, one row per sample."""
    return pieces.groupBy("sample_id").agg(F.sum(F.length("content")).cast("bigint").alias("length"), F.max("exclusion_reason").alias("exclusion_reason"))


def read_binary_samples(spark: SparkSession, path: str, ids: DataFrame, suffix: str = ".zlib") -> DataFrame:
    """Compressed files of a folder, named by sample id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    name = F.regexp_extract("path", r"([^/]+)" + suffix.replace(".", r"\.") + "$", 1)
    return inflate_samples(ids, files.select(name.alias("sample_id"), "content"))
