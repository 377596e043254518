"""Files with broken rows: good rows and a table of the others."""

import pytest
from helpers import tuples

from binroute.sources import readers

HEADER = "bin,merchant,card_type,status,is_3d,currency,processor_name,project_name"
GOOD = "510123,m,Visa,approved,t,EUR,P1,X"


def load(spark, path, **options):
    return readers.read_training_csv_tolerant(spark, str(path), **options)


def test_reasons(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [HEADER, GOOD, GOOD + ",more", "1,m", "x1,m,Visa,approved,t,EUR,P1,X", "462263.0,,n/a,,f,NULL,P2,", "NA,m,Visa,declined,t,EUR,P1,X", ""]
    (tmp_path / "in" / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "in" / "b.csv").write_text(HEADER.replace("merchant,card_type", "card_type,merchant") + "\n1,v,m,approved,t,EUR,P1,X\n")
    (tmp_path / "in" / "c.csv").write_text("bin,status\n1,approved\n")
    loaded = load(spark, tmp_path / "in", max_share=0.9, columns=HEADER.split(","))
    assert tuples(loaded.rows) == [
        (462263, None, None, None, "f", None, "P2", None),
        (510123, "m", "Visa", "approved", "t", "EUR", "P1", "X"),
        (None, "m", "Visa", "declined", "t", "EUR", "P1", "X"),
    ]
    found = {(r["file"].rsplit("/", 1)[1], r["reason"], r["record"]) for r in loaded.rejects.collect()}
    assert found == {
        ("a.csv", "fields", GOOD + ",more"), ("a.csv", "fields", "1,m"), ("a.csv", "bin", "x1,m,Visa,approved,t,EUR,P1,X"),
        ("b.csv", "header", HEADER.replace("merchant,card_type", "card_type,merchant")), ("b.csv", "header", "1,v,m,approved,t,EUR,P1,X"),
        ("c.csv", "header", "bin,status"), ("c.csv", "header", "1,approved"),
    }
    counts = {(r["file"].rsplit("/", 1)[1], r["reason"]): r["records"] for r in loaded.reject_counts.collect()}
    assert counts == {("a.csv", "fields"): 2, ("a.csv", "bin"): 1, ("b.csv", "header"): 2, ("c.csv", "header"): 2}


def test_the_share_is_bounded(spark, tmp_path):
    (tmp_path / "t.csv").write_text("\n".join([HEADER, *[GOOD] * 8, "1,m", "x,m,Visa,approved,t,EUR,P1,X"]))
    assert load(spark, tmp_path / "t.csv", max_share=0.2).rows.count() == 8
    with pytest.raises(readers.TooManyRejects, match="2 of 10 records .*'fields': 1"):
        load(spark, tmp_path / "t.csv", max_share=0.19)


def test_good_files_have_no_rejects(spark, tmp_path):
    (tmp_path / "t.csv").write_text(f'{HEADER}\n510123,"two\nlines, ""x""",Visa,approved,t,EUR,P1,X\n')
    loaded = load(spark, tmp_path / "t.csv")
    assert loaded.rejects.count() == 0 and tuples(loaded.rows, "merchant") == [('two\nlines, "x"',)]
    assert tuples(loaded.rows) == tuples(readers.read_training_csv(spark, str(tmp_path / "t.csv")))
    (tmp_path / "empty.csv").write_text(HEADER + "\n")
    assert load(spark, tmp_path / "empty.csv").rows.count() == 0
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="lacks the columns"):
        load(spark, tmp_path / "other.csv")
