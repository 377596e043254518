import re
import textwrap

import pytest
from llm_helpers import ODD
from pyspark.sql import functions as F

from binroute.llm import licences


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def scanner(documents):
    return licences.train(documents)


def test_every_statement_of_the_corpus(documents, scanner):
    found = {(r["doc_id"], r["paragraph"]): r for r in scanner.scan(documents).collect()}
    expected = {"apache": "apache-2.0", "mit": "mit", "gnu": "gpl-3.0", "by-nc": "cc-by-nc"}
    seen = set()
    for row in documents.collect():
        for at, line in enumerate(row["text"].split("\n")):
            if re.search("licen[cs]e", line.lower()):
                claim = found[row["doc_id"], at]
                assert claim["family"] == next(f for word, f in expected.items() if word in line.lower())
                assert claim["confirmed"] and claim["text"] == line
                seen.add((row["doc_id"], at))
    assert seen and all(not r["confirmed"] for key, r in found.items() if key not in seen)
    assert len(found) - len(seen) <= 0.002 * sum(r["text"].count("\n") + 1 for r in documents.collect())


def test_unseen_wordings(spark, scanner):
    cases = {
        1: ("This project is released under the MIT License, see below.", "mit"),
        2: ("This file is licensed under the Apache License, Version 2.0, by its authors.", "apache-2.0"),
        3: ("You may redistribute it under the terms of the GNU General Public License, either version 3 or any later version.", "gpl-3.0"),
        4: ("Text licensed under CC BY-NC 4.0.", "cc-by-nc"),
        5: ("He lost his driving licence in the general store.", None),
        6: ("Nothing of the kind was ever said.", None),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string")
    found = {r["doc_id"]: r["family"] for r in scanner.scan(docs).where("confirmed").collect()}
    assert found == {i: f for i, (_, f) in cases.items() if f}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_statements_wrapped_over_lines(spark, scanner, mark):
    rows = [(f, "int x = 1;\n\n" + "\n".join(mark + line for line in textwrap.wrap(max(own, key=len), 72))) for f, own in licences.TEMPLATES.items()]
    found = scanner.scan(spark.createDataFrame(rows, "doc_id string, text string")).where("confirmed").collect()
    assert {(r["doc_id"], r["family"]) for r in found} == {(f, f) for f in licences.TEMPLATES}
    assert {r["paragraph"] for r in found if r["doc_id"] in ("mit", "gpl-3.0", "bsd")} == {2}


def test_held_out_rows_are_not_fitted(documents, monkeypatch):
    seen, fit = [], licences.LogisticRegression.fit
    monkeypatch.setattr(licences.LogisticRegression, "fit", lambda self, rows: seen.append(rows.select("text", "family", "held").collect()) or fit(self, rows))
    licences.train(documents.limit(200))
    assert not any(r["held"] for r in seen[0])
    assert {r["text"] for r in seen[0]} >= {t for own in licences.TEMPLATES.values() for t in own}


def test_confirmation_by_words(spark):
    rows = [(1, "Released under the MIT License.", "mit"), (2, "released under some other terms", "mit")]
    found = {r["i"]: r for r in licences.confirm(spark.createDataFrame(rows, "i long, text string, family string")).collect()}
    assert found[1]["template_share"] == 1 and found[1]["confirmed"]
    assert found[2]["template_share"] == pytest.approx(0.4) and not found[2]["confirmed"]


def test_odd_rows(texts, scanner):
    docs = texts(*ODD, (20, "x\nReleased under the MIT License.\n\nReleased under the MIT License."), (20, "Released under the MIT License."))
    found = scanner.scan(docs.withColumnsRenamed({"rank": "probability", "class": "family", "node": "features"})).where("confirmed")
    assert sorted((r["doc_id"], r["paragraph"]) for r in found.collect()) == [(20, 0), (20, 1), (20, 3)]
    assert scanner.scan(texts((1, "x")).where("doc_id > 1")).count() == 0


def test_no_python_in_the_plan(documents, scanner):
    plan = scanner.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_marks_are_those_of_the_whole_pattern(spark):
    """Lines that cannot begin or end with marks skip the patterns; the others lose what one pattern of both finds."""
    marks = r"^\s*(?:<!--|/\*+|\*+/|\*+|//+[!/]*|#+|--+|;+|%+|>+|\.\.|(?i:rem|dnl)\b)?\s*|\s*(?:\*+/|-->|\*+|#+)?\s*$"
    words = ("a", "rem", "Rem x", "REMARK", "dnl y", "Done", "red", "é", "a-->b", "x */ y")
    edges = ("", " ", "\t", "/* ", "*/", "//! ", "# ", "-- ", "-->", "<!-- ", ";;", "%", ">", ".. ", ".", "\x0b", "\r", "\x85", "\u2028", "\u2029", "\u00a0", "/", "-")
    rows = spark.createDataFrame([(f"{a}{w}{b}",) for a in edges for w in words for b in edges], "line string")
    both = rows.select("line", licences._unmarked(F.col("line")).alias("mine"), F.regexp_replace("line", marks, "").alias("plain"))
    assert both.where(~F.col("mine").eqNullSafe(F.col("plain"))).collect() == []


def test_a_run_is_joined_once_and_a_paragraph_scored_once(documents, scanner, capsys):
    scanner.scan(documents).explain()
    plan = capsys.readouterr().out
    filters = [line for line in plan.splitlines() if "Filter (" in line]
    assert filters and not any("UDF(" in line for line in filters)
    assert "xxhash64(__whole" in plan and "xxhash64(array_join" not in plan


def test_lines_keep_their_numbers(spark):
    text = "\n\nfirst \x01 1\x01\n# second\n--\n\n12\x01x\n\n \n/* last */"
    rows = licences.paragraphs(spark.createDataFrame([(1, text), (2, "\n"), (3, ""), (4, None)], "doc_id int, text string"))
    got = sorted((r["doc_id"], r["paragraph"], r["text"], r["__run"], r["__wrapped"]) for r in rows.collect())
    assert got == [
        (1, 2, "first \x01 1\x01", 2, False), (1, 2, "first \x01 1\x01 second", 2, True), (1, 3, "# second", 2, False),
        (1, 6, "12\x01x", 6, False), (1, 9, "/* last */", 9, False),
    ]
