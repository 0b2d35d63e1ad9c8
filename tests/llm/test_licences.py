import duckdb
import pytest

from tallyleaf.llm import licences


def test_every_sentence_has_a_cue():
    for sentence in licences.SENTENCES.values():
        assert any(c.replace("-", " ") in sentence for c in licences.CUES), sentence
        assert sentence == licences.normalised(sentence)


ROWS = [
    (1, "Some prose.\nReleased under the MIT License.\nMore prose."),
    (2, "Licensed under the Apache License, Version 2.0."),
    (3, "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://x"),
    (4, None),
    (5, ""),
    (6, "this mentions the mit license in passing. no sentence"),
    (7, "All rights reserved.\nAll rights reserved.\nLicensed under CC BY-NC 4.0."),
    (7, "All rights reserved."),
    (None, "word " * 30_000 + "\nSPDX-License-Identifier: MIT"),
]


def test_rules(spark):
    got = [tuple(r.licences) for r in licences.scan(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()]
    assert got == [("MIT",), ("Apache-2.0",), ("Apache-2.0",), (), (), (), ("CC-BY-NC-4.0", "proprietary"), ("proprietary",), ("MIT",)]


def test_longer_rules_consume(spark):
    ids = licences.scan(spark.createDataFrame(ROWS[2:3], "doc_id long, text string")).first().ids
    assert ids == ["apache_the", "apache_comply", "apache_copy"]


def test_equals_sql_on_the_cases(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = licences.op3_licences(spark, str(tmp_path)).toPandas()
    key = lambda p: sorted(map(str, p[sorted(p.columns)].astype(object).where(p[sorted(p.columns)].notna(), None).itertuples(index=False, name=None)))
    want = c.sql(licences.oracle()).df()
    assert key(got.astype({"doc_id": "Int64"})) == key(want.astype({"doc_id": "Int64"}))


def test_empty_table_and_clashes(spark):
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert licences.scan(spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, ids string")).first().licences == []


@pytest.mark.parametrize("name", ["op3_licences"])
def test_no_python_in_the_plan(spark, name):
    plan = licences.op3_licences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


MIT = """MIT License
Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.
"""
BSD = """# Copyright (c) 2020, Someone
# All rights reserved.
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright notice, this
#    list of conditions and the following disclaimer.
# 2. Redistributions in binary form must reproduce the above copyright notice,
#    this list of conditions and the following disclaimer in the documentation
#    and/or other materials provided with the distribution.
"""


def test_wrapped_texts(spark):
    rows = [(1, MIT), (2, BSD), (3, MIT.replace("\n", "\r\n")), (4, "mit | license\nreleased under\n\nthe mit license\nmit\nlicense")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].ids == got[3].ids == ["mit_title2", "mit_grant", "mit_notice", "as_is"] and got[1].licences == got[3].licences == ["MIT"]
    assert got[2].ids == ["rights", "bsd_grant", "bsd_source", "bsd_binary"] and got[2].licences == ["BSD-3-Clause", "proprietary"]
    assert got[4].ids == ["mit_title2", "mit_title"]
