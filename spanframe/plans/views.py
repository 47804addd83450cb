"""Base tables and derived views; one SQL text per view serves both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanframe.session import read_tasks

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_iv": (
        ("events",),
        """select user_id as key, case when event_type in ('click','view','signup') then 'A' else 'B' end as set_id,
        lo, lo + 1 + 600 * (event_id % 7) as hi
        from (select *, cast((extract(day from ts) - 1) * 86400 + extract(hour from ts) * 3600
          + extract(minute from ts) * 60 + floor(extract(second from ts)) as bigint) as lo from {events}) e""",
    ),
    "v_tile": (
        ("documents",),
        """select doc_id as sample_id, cast(length(text) as bigint) as n_units,
        cast(greatest(1, ceil(length(text) / cast(64 as double))) as bigint) as n_tiles,
        case when length(text) > 4096 then 'long' else 'short' end as stratum from {documents}""",
    ),
    "v_line": (
        ("lineitem",),
        """select l_orderkey as sample_id, cast(row_number() over (partition by l_orderkey
        order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as bigint) as idx,
        cast(l_quantity as bigint) as q, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax,
        l_returnflag, l_linestatus from {lineitem}""",
    ),
    "v_region": (
        ("v_line",),
        """select sample_id, idx, src0 - (case when l_tax > 0.07 then 2 else 0 end) as src_lo, src0 + q as src_hi,
        1000 * idx as dst_lo, 1000 * idx + q + (sample_id + idx) % 7 - 3 as dst_hi
        from (select *, 4 + cast(coalesce(sum(q) over (partition by sample_id order by idx
          rows between unbounded preceding and 1 preceding), 0) as bigint) as src0 from {v_line}) r where q > 3""",
    ),
    "v_size": (
        ("v_line",),
        """select sample_id, cast(4 as bigint) as header_len, cast(4 + sum(q) + 8 as bigint) as file_size,
        cast(4 + sum(q) as bigint) as overlay_offset from {v_line} group by sample_id""",
    ),
    "v_box": (
        ("v_line",),
        """select sample_id as image_id, idx as box_id, l_returnflag as label,
        (l_partkey * 37) % 560 as x1, (l_suppkey * 53) % 560 as y1, 16 + q as w, 16 + q as h,
        (l_partkey * 37) % 560 + idx - 3 as px1, (l_suppkey * 53) % 560 + idx - 3 as py1,
        round(1 - l_discount * 5, 6) as score from {v_line}""",
    ),
    "v_delta": (
        ("v_line",),
        """select sample_id, f.fill, idx as block,
        case when l_returnflag = 'R' and idx % 2 = 0 then null
             when f.fill = 'primary' then round((l_discount - 0.05) * 100, 6)
             else round((l_tax - 0.04) * 100, 6) end as delta
        from {v_line} cross join (values ('primary'), ('zero')) as f(fill)""",
    ),
    "v_pair": (
        ("v_line", "orders"),
        """select l.sample_id, o.o_orderstatus as stratum,
        round(avg(case when idx % 2 = 1 then l_extendedprice end), 6) as treatment,
        round(avg(case when idx % 2 = 0 then l_extendedprice end), 6) as control
        from {v_line} l join {orders} o on o.o_orderkey = l.sample_id group by l.sample_id, o.o_orderstatus
        having count(case when idx % 2 = 1 then 1 end) > 0 and count(case when idx % 2 = 0 then 1 end) > 0""",
    ),
    "v_pred": (
        ("documents", "labels"),
        """select d.doc_id as sample_id, l.quality as truth,
        case when d.doc_id % 5 = 0 then 1 - l.quality else l.quality end as pred
        from {documents} d join {labels} l on l.doc_id = d.doc_id""",
    ),
    "v_manifest": (
        ("orders",),
        """select o_orderkey as sample_id, case when o_orderkey % 10 < 6 then 'train' when o_orderkey % 10 < 8
        then 'validation' else 'test' end as split, case when o_custkey % 5 = 0 then 'reserve' else 'primary' end as role,
        o_orderkey as pos, o_orderkey % 17 <> 0 as ok, o_totalprice as size from {orders}""",
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Views whose rows stay with one key from the first window to the last step, and that key.
DEALT = {"v_line": ("lineitem", "l_orderkey")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view as a DataFrame.

    The rows of ``v_line`` are dealt by order over a number of tasks that follows the files. The
    steps on an order run in one stage, whose sorts and joins need many times the bytes shuffled.
    """
    if name in TABLES:
        return table(spark, sf_dir, name)
    deps, text = VIEWS[name]
    frames = {d: view(spark, sf_dir, d) for d in deps}
    if name in DEALT:
        d, key = DEALT[name]
        frames[d] = frames[d].repartition(16 * read_tasks(frames[d]), key)
    return spark.sql(text, **frames)


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def add(n: str) -> None:
        if n in TABLES or n in out:
            return
        for d in VIEWS[n][0]:
            add(d)
        out.append(n)

    for n in names:
        add(n)
    return out


def with_views(sql: str, uses: tuple[str, ...], recursive: bool = False) -> str:
    """Prefix a SQL twin with the text of the views it reads.

    The twin may itself start with ``with``; its CTEs are then merged.
    """
    ctes = [f"{n} as ({VIEWS[n][1].format(**{d: d for d in VIEWS[n][0]})})" for n in _order(uses)]
    body = sql.strip()
    if not ctes:
        return body
    head = "with recursive " if recursive else "with "
    low = body.lower()
    if low.startswith("with recursive "):
        return "with recursive " + ", ".join(ctes) + ", " + body[len("with recursive "):]
    if low.startswith("with "):
        return head + ", ".join(ctes) + ", " + body[len("with "):]
    return head + ", ".join(ctes) + " " + body
