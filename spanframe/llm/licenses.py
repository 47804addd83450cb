"""Licence scan: sparse TF-IDF cosine to templates, then inheritance along paths.

The candidates of a file are its lines, its passages that run over several lines
(sentences of wrapped notices, cut at sentence ends and at lines without letters or
digits), and the whole text of a licence file. A candidate is the set of its terms,
weighted by inverse document frequency over all lines of the table; a weight depends on
the share of lines that hold the term, so a notice scores alike in small and large tables.

1. One pass counts the lines of every term. The counts are written, never collected; only
   those of the template terms, bounded by the templates, reach the driver.
2. A second pass takes the candidates with a template term (others have cosine zero),
   their best template and the weight of its terms in the row. Their other terms are
   joined to the counts, hot terms salted, and summed to the norms.
3. A file without a match of its own inherits from the nearest directory at or above its
   own that holds a matched licence file: a join over the distinct directories.

Texts are not shuffled before the last join, which carries only the columns that are used.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.functions.ranking import attach_group
from spanframe.llm.common import lower_ascii, written
from spanframe.llm.html_text import STOP_WORDS
from spanframe.llm.registry import query, table

#: Notices by licence; several notices of a licence are separate templates. Fixed values.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind, either express or implied."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law the author has waived all copyright and related rights to this work: CC0 1.0 Universal public domain dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions."),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)"
#: Where passages end: at a sentence mark before white space, and at a line without a letter or digit of ASCII.
PASSAGE_END = r"[.!?][\"')\]]*[ \t\r\n]|\n[^a-z0-9\n]*\n"
THRESHOLD = 0.6
#: Added to the share of lines that hold a term: bounds the weight of rare terms at every size.
FLOOR = 0.001
#: A term of more candidates than this is joined in several parts.
HOT = 20_000
_IGNORED = frozenset(STOP_WORDS["en"].split())


def template_terms(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    """(licence, sorted terms) of each template, without function words."""
    return [(name, sorted(set(re.findall(TERM, text.lower())) - _IGNORED)) for name, text in templates]


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({t for _, terms in template_terms(templates) for t in terms})


def _any_term(terms: list[str]) -> str:
    return "(?:^|[^a-z0-9])(?:" + "|".join(re.escape(t) for t in terms) + ")(?:[^a-z0-9]|$)"


def _atoms(terms: list[str]) -> Column:
    """One run of letters or digits of each term; a text that holds the term holds the run."""
    return F.array(*[F.lit(a) for a in sorted({max(re.split("[.-]", t)[::-1], key=len) for t in terms})])


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def lines_of(text: Column) -> Column:
    return F.split(lower_ascii(F.coalesce(text, F.lit(""))), "\n")


def candidates(text: Column, whole: Column, terms: list[str]) -> Column:
    """Lower-cased lines, passages of several lines and, where ``whole`` holds, the text itself,
    as far as they may hold a term of some template; others have cosine zero."""
    low = lower_ascii(F.coalesce(text, F.lit("")))
    may = lambda x: F.arrays_overlap(F.split(x, "[^a-z0-9]+"), _atoms(terms))
    bare = lambda x: F.regexp_replace(x, "^[^a-z0-9]+|[^a-z0-9]+$", "")
    passages = F.filter(F.transform(F.split(low, PASSAGE_END), bare), lambda x: F.contains(x, F.lit("\n")))
    units = F.concat(F.split(low, "\n"), passages, F.when(whole, F.array(low)).otherwise(F.array().cast("array<string>")))
    return F.when(may(low), F.filter(F.array_distinct(units), may)).otherwise(F.array().cast("array<string>"))


def term_set(unit: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(unit, F.lit(TERM), F.lit(0))), _strings(sorted(_IGNORED)))


def line_counts(texts: DataFrame) -> DataFrame:
    """(term, n): the number of lines that hold each term of the column ``text``, and under the
    empty term the number of all lines."""
    held = F.transform(lines_of(F.col("text")), lambda x: F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(x, F.lit(TERM), F.lit(0)))))
    terms = texts.select(F.explode(F.flatten(held)).alias("term")).filter(~F.col("term").isin(sorted(_IGNORED)))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def squared_weight(n: Column, lines: int) -> Column:
    """The squared weight of a term of ``n`` lines, in millionths: whole numbers add up alike in any order."""
    w = F.log(F.lit(1 + FLOOR) / (n / F.lit(float(max(lines, 1))) + FLOOR)) + 1
    return F.floor(w * w * 1e6 + 0.5).cast("bigint")


def _millionths(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5) / 1e6


def best_template(own: Column, known: Column, weights: Mapping[str, int], templates) -> Column:
    """(ratio, license) of the template with the largest dot product over its length."""
    listed = [
        F.struct(_strings(terms).alias("terms"), F.lit(math.sqrt(sum(weights[t] for t in terms))).alias("length"), F.lit(name).alias("license"))
        for name, terms in template_terms(templates)
    ]
    ratio = lambda t: _millionths(_total(F.array_intersect(own, t["terms"]), known) / t["length"])
    return F.array_max(F.transform(F.array(*listed), lambda t: F.struct(ratio(t).alias("ratio"), t["license"].alias("license"))))


def _total(terms: Column, known: Column) -> Column:
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, t: a + F.element_at(known, t))


def best_matches(texts: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(row, best) of each row of (row, text, whole) that has a candidate; best is (score, license)."""
    counts = written(line_counts(texts), "license-terms")
    terms = vocabulary(templates)
    lines = sum(r["n"] for r in counts.filter("term = ''").collect())
    absent = texts.sparkSession.range(1).select(squared_weight(F.lit(0), lines).alias("w")).first()["w"]
    priced = counts.filter(F.col("term").isin(terms)).select("term", squared_weight(F.col("n"), lines).alias("w"))
    weights = dict.fromkeys(terms, absent) | {r["term"]: r["w"] for r in priced.collect()}  # at most one row per template term
    units = texts.select("row", F.explode(candidates(F.col("text"), F.col("whole"), terms)).alias("unit")).select("row", term_set(F.col("unit")).alias("found"))
    split = units.select("row", F.array_intersect("found", _strings(terms)).alias("own"), F.array_except("found", _strings(terms)).alias("others")).filter(F.size("own") > 0)
    known = F.create_map(*[F.lit(x) for x in (v for pair in weights.items() for v in pair)])
    judged = split.select(F.monotonically_increasing_id().alias("unit"), "row", _total(F.col("own"), known).alias("inside"), best_template(F.col("own"), known, weights, templates).alias("best"), "others")
    judged = written(judged, "license-candidates")
    uses = judged.select("unit", F.explode("others").alias("term"))
    facts = uses.groupBy("term").agg(F.count(F.lit(1)).alias("uses")).join(counts, "term").select("term", "uses", squared_weight(F.col("n"), lines).alias("w"))
    outside = attach_group(uses, facts, ["term"], "uses", HOT).groupBy("unit").agg(F.sum("w").alias("outside"))
    norm = F.sqrt(F.col("inside") + F.coalesce("outside", F.lit(0)))
    scored = judged.select("unit", "row", "inside", "best").join(outside, "unit", "left")
    match = F.struct(_millionths(F.col("best.ratio") / norm).alias("score"), F.col("best.license").alias("license"))
    return scored.groupBy("row").agg(F.max(match).alias("best"))


def parent(path: Column) -> Column:
    """The directory of a path; the empty string at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Adds own_score, own_license, license, inherited_from to every row of ``files``.

    ``own_license`` is the best template from the threshold, else null; between equal
    scores the last name wins. ``license`` is the own one or that of the nearest directory
    at or above the file's with a matched licence file (named licence, copying or notice);
    of several there the best score wins. ``inherited_from`` names that directory, the
    empty string for the top. A null or empty text matches nothing; a null path inherits
    nothing; rows that repeat a path are judged each; very long texts give many candidates,
    which are rows of their own. Columns of those names are replaced, all others stay,
    whatever their names. An empty table gives no rows. The input is read more than once
    and must give the same rows: a table or a checkpoint.
    """
    new = ["own_score", "own_license", "license", "inherited_from"]
    kept = [c for c in files.columns if c not in new]
    path = F.col(f"`{path_col}`").cast("string")
    named = F.coalesce(F.regexp_extract(path, r"[^/]*$", 0).rlike(LICENSE_FILE), F.lit(False))
    placed = files.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{text_col}`").cast("string").alias("text"),
        parent(path).alias("dir"), named.alias("whole"), F.monotonically_increasing_id().alias("row"))
    best = written(best_matches(placed.select("row", "text", "whole"), templates), "license-matches")
    matched = placed.filter("whole").select("row", "dir").join(best.filter(F.col("best.score") >= threshold), "row")
    held = matched.groupBy(F.col("dir").alias("above")).agg(F.max("best").alias("held"))
    dirs = placed.select("dir").filter("dir is not null").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ups = dirs.withColumn("above", F.explode(F.array_distinct(above)))
    nearest = ups.join(held, "above").groupBy("dir").agg(F.max_by(F.struct("above", "held"), F.length("above")).alias("source"))
    rows = placed.select(*[f"c{i}" for i in range(len(kept))], "row", "dir").join(best, "row", "left").join(nearest, "dir", "left")
    own = F.when(F.col("best.score") >= threshold, F.col("best.license"))
    return rows.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.coalesce("best.score", F.lit(0.0)).alias("own_score"), own.alias("own_license"),
        F.coalesce(own, F.col("source.held.license")).alias("license"), F.when(own.isNull(), F.col("source.above")).alias("inherited_from"),
    )


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql() -> str:
    terms, named = vocabulary(), template_terms()
    rows = ", ".join(f"({k}, '{name}', {_list(listed)})" for k, (name, listed) in enumerate(named))
    anchors, ends = _any_term(terms), PASSAGE_END.replace("'", "''")
    sets = f"[x for x in list_distinct(regexp_extract_all(unit, '{TERM}')) if not list_contains({_list(sorted(_IGNORED))}, x)]"
    return f"""
with recursive f as (
  select doc_id, source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
    regexp_matches(coalesce(text, ''), '(?i)(licensed|released) under') as is_file from documents),
p as (
  select doc_id, low, is_file, concat_ws('/', source, cast(doc_id // 1000 as varchar),
    case when is_file and doc_id % 3 = 0 then null else cast(doc_id // 100 as varchar) end) as dir from f),
l as (select doc_id, unnest(string_split(low, chr(10))) as unit from f),
n as (select count(*) as n from l),
counted as (select term, count(*) as k from (select unnest(list_distinct(regexp_extract_all(unit, '{TERM}'))) as term from l) group by 1),
t as (select unnest({_list(terms)}) as term union select term from counted),
idf as (select term, ln({1 + FLOOR} / (coalesce(k, 0) / cast(n as double) + {FLOOR})) + 1 as w from t left join counted using (term), n),
w as (select term, cast(floor(w * w * 1e6 + 0.5) as bigint) as w from idf),
tpl(k, license, terms) as (values {rows}),
tw as (select k, license, terms, (select sqrt(sum(w)) from w where list_contains(tpl.terms, w.term)) as len from tpl),
cut as (select doc_id, regexp_replace(unnest(string_split_regex(low, '{ends}')), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') as unit from f),
units as (select distinct doc_id, unit from (select * from l union all select * from cut where contains(unit, chr(10)) union all select doc_id, low from p where is_file)
  where regexp_matches(unit, '{anchors}')),
us as (select doc_id, unit, {sets} as found from units),
ut as (select doc_id, unit, unnest(found) as term from us),
norms as (select doc_id, unit, sqrt(sum(w)) as len from ut join w using (term) group by all),
dots as (select ut.doc_id, ut.unit, tw.k, tw.license, floor(sum(w.w) / tw.len * 1e6 + 0.5) / 1e6 as ratio from ut join w using (term) join tw on list_contains(tw.terms, ut.term) group by ut.doc_id, ut.unit, tw.k, tw.license, tw.len),
tops as (select doc_id, unit, max({{'ratio': ratio, 'license': license}}) as top from dots group by all),
s as (select doc_id, top.license as license, floor(top.ratio / norms.len * 1e6 + 0.5) / 1e6 as score from tops join norms using (doc_id, unit)),
b as (select doc_id, max({{'score': score, 'license': license}}) as best from s group by 1),
o as (select p.doc_id, p.dir, p.is_file, coalesce(b.best.score, 0.0) as score, b.best.license as lic from p left join b using (doc_id)),
held as (select dir, max({{'score': score, 'license': lic}}) as h from o where is_file and score >= {THRESHOLD} group by dir),
ups as (select dir, dir as above, 0 as d from (select distinct dir from o)
  union all select dir, regexp_replace(above, '/?[^/]*$', ''), d + 1 from ups where above <> ''),
near as (select ups.dir, arg_min(ups.above, d) as above, arg_min(held.h.license, d) as lic from ups join held on held.dir = ups.above group by ups.dir)
select o.doc_id, o.score as own_score, case when o.score >= {THRESHOLD} then o.lic end as own_license,
  coalesce(case when o.score >= {THRESHOLD} then o.lic end, near.lic) as license,
  case when o.score < {THRESHOLD} then near.above end as inherited_from
from o left join near on near.dir = o.dir
"""


@query("op2_license_scan", _sql())
def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of a tree by source and number; those that say under what they are
    licensed or released are its licence files, a third of them one level up."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    says = F.coalesce(F.col("text"), F.lit("")).rlike("(?i)(licensed|released) under")
    leaf = F.when(~(says & (F.col("doc_id") % 3 == 0)), F.expr("cast(doc_id div 100 as string)"))
    path = F.concat_ws("/", "source", F.expr("cast(doc_id div 1000 as string)"), leaf, F.concat(F.when(says, "LICENSE-").otherwise("text-"), F.col("doc_id").cast("string")))
    return scan_licenses(docs.withColumn("path", path).select("doc_id", "path", "text")).drop("path", "text")
