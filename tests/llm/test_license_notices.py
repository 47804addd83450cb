"""Wrapped notices and weights that do not depend on the size of the table."""

import pytest
from pyspark.sql import functions as F

from spanframe.llm.licenses import best_matches, scan_licenses

FREE = """/*
 * This {what} is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {kind}General Public License as published by
 * the Free Software Foundation, either version {version} of the License, or
 * (at your option) any later version.
 */
int main() {{ return 0; }}"""
NOTICES = {
    "GPL-2.0": FREE.format(what="program", kind="", version="2"),
    "GPL-3.0": FREE.format(what="program", kind="", version="3"),
    "LGPL-2.1": FREE.format(what="library", kind="Lesser ", version="2.1"),
    "LGPL-3.0": FREE.format(what="library", kind="Lesser ", version="3"),
    "AGPL-3.0": FREE.format(what="program", kind="Affero ", version="3"),
    "Apache-2.0": '# Copyright 2020 Someone\n#\n# Licensed under the Apache License,\n# Version 2.0 (the "License");\n# you may not use this file except\n# in compliance with the License.\n\nimport os\n',
    "BSD-3-Clause": "# Redistribution and use in source and binary\n# forms, with or without modification, are\n# permitted provided that the following\n# conditions are met:\n#\n# 1. Redistributions ...",
    "MIT": "MIT License\n\nCopyright (c) 2019 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n",
}


def test_wrapped_notices(spark):
    prose = [(f"p/{i}.txt", f"some prose {i} about the river\nand the hills beyond {i % 7}") for i in range(2000)]
    rows = [(f"{name}/main.c", text) for name, text in NOTICES.items()] + prose
    found = {r.path: r.own_license for r in scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {name: found[f"{name}/main.c"] for name in NOTICES} == {name: name for name in NOTICES}
    assert all(found[path] is None for path, _ in prose)


def scored(spark, lines):
    """The score of one file among so many lines of one mix, one in a hundred a notice."""
    notice = "Released under the MIT License.  Copyright Acme"
    n = F.col("id")
    text = F.when(n == 0, F.lit(notice)).when(n % 100 == 1, F.lit("Licensed under the Apache License, Version 2.0.")).when(
        n % 100 == 2, F.lit("Released under the MIT License.")).otherwise(F.concat(F.lit("the river and hill "), (n % 1000).cast("string")))
    rows = spark.range(lines).select(n.alias("row"), text.alias("text"), F.lit(False).alias("whole"))
    return best_matches(rows).filter("row = 0").first()["best"]


def test_scores_do_not_depend_on_the_size_of_the_table(spark):
    small, large = scored(spark, 10_000), scored(spark, 1_000_000)
    assert small["license"] == large["license"] == "MIT" and abs(small["score"] - large["score"]) < 0.02 and large["score"] >= 0.6


@pytest.mark.parametrize("name", ["_dir", "_best", "_from", "row", "dir", "best", "source", "whole", "text2", "c0", "unit", "a.b"])
def test_callers_columns_stay(spark, name):
    df = spark.createDataFrame([("LICENSE", "Released under the MIT License.", 7), ("x.c", None, 8)], ["path", "text", name])
    got = scan_licenses(df)
    assert got.columns == ["path", "text", name, "own_score", "own_license", "license", "inherited_from"]
    assert sorted((r["path"], r[name], r["license"]) for r in got.collect()) == [("LICENSE", 7, "MIT"), ("x.c", 8, "MIT")]


def test_a_very_long_text(spark):
    text = "\n".join(f"file {i} of the software" for i in range(30_000)) + "\n\n" + NOTICES["Apache-2.0"]
    rows = [("a.c", text), ("LICENSE", text), ("e.c", "")]
    assert {r.path: r.own_license for r in scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()} == {
        "a.c": "Apache-2.0", "LICENSE": "Apache-2.0", "e.c": None}
