"""Quality rules by distribution divergence, as DataFrame expressions only.

A document's histogram of character classes and its histogram of common words are held
against references of its language by Jensen-Shannon distance. The references are
counted over all documents: class totals, and the most frequent words by an exact count.
A short document, or a language with little text, is not judged by a histogram. Counts
that need no reference (words, symbols, repeated lines and windows) are taken in the
same narrow pass, inside the row: nothing of a text is shuffled there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm.common import written
from spanframe.llm.registry import query, table

#: Documents under these sizes are not judged by the histogram of classes or of words.
MIN_CHARS, MIN_WORDS = 200, 50
#: Largest Jensen-Shannon distance (base 2, so 0 to 1) to the language of a document.
MAX_CLASSES, MAX_WORDS = 0.30, 0.45
#: Common words of a language; a language with less than 1 / SHARE of all words has no
#: reference, so there are at most SHARE references and they may be broadcast.
COMMON, SHARE = 24, 1000
#: Character classes of words: what each pattern takes out of what the ones before it left; then the rest.
CLASSES = ("[a-z]+", "[A-Z]+", "[^\\x00-\\x7F]+", "[0-9]+", "[.,;:!?'\"()\\-]+")
SPACE = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, also where the body uses it in a loop."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space, tab, line and page breaks."""
    return F.array_remove(F.split(text, SPACE), "")


def with_repeated_words(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: the ``words`` that lie in a window of three found twice or more.

    Windows are sorted inside the row; each step is a column of its own, so that the long
    array is built by generated code and the loops only read it.
    """
    n = F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))
    grams = [F.slice("words", F.lit(k + 1), n).alias(f"w{k}") for k in range(WINDOW)]
    at = F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), F.lit(1), n).alias("at")
    out = rows.withColumn("windows", F.sort_array(F.arrays_zip(*grams, at)))
    same = lambda x, k: F.coalesce(reduce(and_, [x[f"w{j}"] == F.get("windows", k)[f"w{j}"] for j in range(WINDOW)]), F.lit(False))
    out = out.withColumn("again", F.array_sort(F.filter("windows", lambda x, k: same(x, k - 1) | same(x, k + 1))["at"]))
    reach = F.transform("again", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("again", j + 1) - x, F.lit(WINDOW))))
    return out.withColumn("n_repeat_words", F.aggregate(reach, F.lit(0).cast("bigint"), lambda total, x: total + x)).drop("windows", "again")


def times_of(words: Column, wanted: Column) -> Column:
    """How often each of ``wanted`` (distinct, few) occurs among ``words``."""

    def counts(c: Column) -> Column:  # sorted
        first = F.filter(F.transform(c, lambda x, k: F.struct(x.alias("w"), k.alias("k"))), lambda x: F.coalesce(x["w"] != F.get(c, x["k"] - 1), F.lit(True)))
        return let(first, lambda f: F.map_from_arrays(f["w"], F.transform(f["k"], lambda k, j: (F.coalesce(F.get(f["k"], j + 1), F.size(c)) - k).cast("bigint"))))

    found = F.filter(words, lambda x: F.array_contains(wanted, x))
    return let(let(F.sort_array(found), counts), lambda m: F.transform(wanted, lambda w: F.coalesce(F.element_at(m, w), F.lit(0).cast("bigint"))))


def class_counts(rows: DataFrame, source: str) -> DataFrame:
    """Adds ``classes``, the code points of each class in the column ``source``, which holds no
    white space, and ``rest``, the symbols."""
    out = rows.withColumn("rest", F.col(source))
    for k, pattern in enumerate(CLASSES):
        out = out.withColumn("less", F.regexp_replace("rest", pattern, "")).withColumn(f"c{k}", (F.length("rest") - F.length("less")).cast("bigint"))
        out = out.drop("rest").withColumnRenamed("less", "rest")
    counts = [f"c{k}" for k in range(len(CLASSES))]
    return out.withColumn("classes", F.array(*counts, F.length("rest").cast("bigint"))).drop(*counts)


def with_counts(rows: DataFrame) -> DataFrame:
    """The counts of ``text`` that need no reference."""
    out = rows.withColumn("words", words_of(F.col("text"))).withColumn("joined", F.array_join("words", ""))
    out = class_counts(out, "joined").withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    return with_repeated_words(out).select(
        *rows.columns, "classes", "words", F.size("words").cast("bigint").alias("n_words"), F.length("joined").cast("bigint").alias("word_chars"),
        (F.length("rest") - F.length(F.translate("rest", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
    )


def shares(counts: Column) -> Column:
    """Counts as shares of their sum; the sum must not be 0."""
    return let(counts, lambda c: let(F.aggregate(c, F.lit(0).cast("double"), lambda a, x: a + x), lambda n: F.transform(c, lambda x: x / n)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares of equal length."""

    def part(z: Column) -> Column:
        term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        return let((z["p"] + z["q"]) / 2, lambda m: term(z["p"], m) + term(z["q"], m))

    pairs = F.zip_with(p, q, lambda a, b: F.struct(a.alias("p"), b.alias("q")))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(pairs, F.lit(0.0), lambda total, z: total + part(z)) / 2))


def language_references(rows: DataFrame, common: int = COMMON, share: int = SHARE) -> DataFrame:
    """(lang, ref_classes, ref_words, ref_shares) for languages with at least 1 / ``share`` of all
    words: shares of the classes, the most frequent words and, after them the share of all others."""
    counts = rows.select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("c"))
    counts = written(counts, "words-of-languages")
    # the bound of the rank cuts every task to ``common`` words per language before the shuffle
    order = Window.partitionBy("lang").orderBy(F.desc("c"), "word")
    top = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= common)
    lists = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "word", "c"))).alias("w"))
    spelled = class_counts(counts, "word")  # a class total is a sum over distinct words
    totals = spelled.groupBy("lang").agg(F.sum("c").alias("n"), *[F.sum(F.get("classes", F.lit(k)) * F.col("c")).alias(f"s{k}") for k in range(len(CLASSES) + 1)])
    enough = totals.join(F.broadcast(counts.agg(F.sum("c").alias("all_words"))), F.col("n") * share >= F.col("all_words"))
    listed = F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + x["c"])
    return lists.join(enough, "lang").select(
        "lang", shares(F.array(*[f"s{k}" for k in range(len(CLASSES) + 1)])).alias("ref_classes"), F.col("w.word").alias("ref_words"),
        shares(F.concat(F.col("w.c"), F.array(F.col("n") - listed))).alias("ref_shares"),
    )


def divergence_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS, max_classes: float = MAX_CLASSES, max_words: float = MAX_WORDS, common: int = COMMON, share: int = SHARE,
) -> DataFrame:
    """One row per row of ``docs``: id, the counts, base_failed, kept, and the two distances.

    A null text counts as empty and fails the base rule (under 50 words); a null language
    is one of its own, "und". A distance is null where it is not judged: below
    ``min_chars`` code points in words or ``min_words`` words, or without a reference. Repeated
    rows and ids, and null ids, give a row each. An empty table gives no rows. Other
    columns are not read. A text is handled inside its row, so one text must fit in
    memory a few times over.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    refs = language_references(rows.select("lang", "text"), common, share)
    counted = with_counts(rows).join(F.broadcast(refs), "lang", "left")  # at most ``share`` references
    counted = counted.withColumn("times", times_of(F.col("words"), F.col("ref_words")))
    listed = F.aggregate("times", F.lit(0).cast("bigint"), lambda a, x: a + x)
    known = F.col("ref_words").isNotNull()
    by_class = F.when(known & (F.col("word_chars") >= max(1, min_chars)), js_distance(shares(F.col("classes")), F.col("ref_classes")))
    by_word = F.when(known & (F.col("n_words") >= max(1, min_words)), js_distance(shares(F.concat("times", F.array(F.col("n_words") - listed))), F.col("ref_shares")))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = counted.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        by_class.alias("class_distance"), by_word.alias("word_distance"),
    )
    near = (F.coalesce("class_distance", F.lit(0.0)) <= max_classes) & (F.coalesce("word_distance", F.lit(0.0)) <= max_words)
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & near).alias("kept"), "class_distance", "word_distance",
    )


def _sql_twin() -> str:
    rest, steps = "t", []
    for k, pattern in enumerate((SPACE, *CLASSES)):
        quoted = pattern.replace("'", "''")
        steps.append(f"s{k} as (select *, regexp_replace({rest}, '{quoted}', '', 'g') as t{k} from {'docs' if k == 0 else f's{k - 1}'})")
        rest = f"t{k}"
    last = len(CLASSES)
    lengths = [f"length(t{k})" for k in range(last + 1)]
    classes = ", ".join([*[f"{a} - {b}" for a, b in zip(lengths, lengths[1:])], lengths[-1]])
    total = "+".join(f"classes[{k + 1}]" for k in range(last + 1))
    sums = ", ".join(f"sum(classes[{k + 1}])" for k in range(last + 1))
    # sqrt of half the sum of p log2(p / m) + q log2(q / m)
    js = lambda rows: f"(select sqrt(greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)) from ({rows}))"
    return f"""
with docs as (select row_number() over () as i, doc_id, coalesce(lang, 'und') as lang, coalesce(text, '') as t from documents),
{", ".join(steps)},
counted as (select i, doc_id, lang, t, [{classes}] as classes, t{last} as rest, length(t0) as word_chars,
    regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from s{last}),
word as (select i, lang, unnest(words) as w, generate_subscripts(words, 1) as k from counted),
win as (select i, k, w || ' ' || lead(w) over a || ' ' || lead(w, 2) over a as t from word window a as (partition by i order by k)),
again as (select i, k from win where t is not null qualify count(*) over (partition by i, t) > 1),
covered as (select i, count(distinct k + d) as n from again, (select unnest([0, 1, 2]) as d) group by i),
freq as (select lang, w, count(*) as c from word group by lang, w),
total as (select lang, sum(c) as n from freq group by lang),
ranked as (select *, row_number() over (partition by lang order by c desc, w) as r from freq),
ref_word as (select lang, r, w, c / n as q from ranked join total using (lang) where r <= {COMMON} and n * {SHARE} >= (select sum(n) from total)),
ref_words as (select lang, list(w order by r) as ws, list(q order by r) as qs from ref_word group by lang),
class_sum as (select lang, [{sums}] as classes from counted group by lang),
base as (select c.i, c.doc_id, c.lang, len(words) as n_words, word_chars,
    length(rest) - length(translate(rest, '{SYMBOLS}', '')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(v.n, 0) as n_repeat_words, classes from counted c left join covered v on v.i = c.i),
class_js as (select i, {js(f"select unnest(list_transform(b.classes, lambda x: x / ({total.replace('classes', 'b.classes')}))) as p, unnest(list_transform(s.classes, lambda x: x / ({total.replace('classes', 's.classes')}))) as q")} as d
    from base b join class_sum s using (lang) join ref_words using (lang) where b.word_chars >= {MIN_CHARS}),
hits as (select i, r, count(*) as c from word join ref_word using (lang, w) group by i, r),
hist as (select i, r, q, coalesce(c, 0) / n_words as p from base join ref_word using (lang) left join hits using (i, r) where n_words >= {MIN_WORDS}),
whole as (select i, p, q from hist union all select i, 1 - sum(p), 1 - sum(q) from hist group by i),
word_js as (select i, sqrt(greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)) as d from whole group by i),
failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and coalesce(class_js.d, 0) <= {MAX_CLASSES} and coalesce(word_js.d, 0) <= {MAX_WORDS} as kept
from failed left join class_js using (i) left join word_js using (i)
"""


@query("op11_divergence_rules", _sql_twin())
def op11_divergence_rules(spark: SparkSession, sf: str) -> DataFrame:
    return divergence_rules(table(spark, sf, "documents")).drop("class_distance", "word_distance")
