import re
from collections import Counter

import pytest
from compare import compare, connect
from llm_helpers import ODD, SF

from binroute.llm import oracles, registry, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(windows)
    again = {at + k for at, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


CASES = (*ODD, (20, "a b c a b c"), (21, "x x x x x"), (22, "a b\na b\n\n \na b"), (23, "#*$ %&| <> !! ok"), (24, "p q r s p q r"))


def test_measurements(texts):
    rows = rules.measure(texts(*CASES)).collect()
    found = sorted(str((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in rows)
    assert found == sorted(str((doc, *plain(text))) for doc, text in CASES)


def test_agrees_with_sql(spark):
    query = registry.queries()["op8_quality_rules"](spark, SF)
    assert compare(query, connect(SF), oracles.oracle_sql()["op8_quality_rules"]) == []


def test_bits_policies_and_ablation(texts):
    good = "alpha beta gamma delta " * 1 + " ".join(f"word{i}" for i in range(60))
    noisy = " ".join(f"w{i}!!" for i in range(60))
    rows = rules.decide(rules.ledger(rules.measure(texts((1, good), (2, noisy), (3, "few words"), (4, "a b c " * 30), (5, None))))).collect()
    kept = {r["doc_id"]: (r["kept_base"], r["kept_v1"]) for r in rows}
    assert kept == {1: (True, True), 2: (True, False), 3: (False, False), 4: (False, False), 5: (False, False)}
    found = rules.ablate(rules.ledger(rules.measure(texts((1, good), (2, noisy), (3, "few words")))))
    table = {(r["version"], r["rule"]): (r["n_failed"], r["n_only"], r["n_kept"], r["n_kept_without"]) for r in found.collect()}
    assert table["v1", "exclamations"] == (1, 1, 1, 2)
    assert table["base", "few_words"] == (1, 1, 2, 3)


def test_bits_stay_in_place():
    assert [name for name in rules.RULES][:3] == ["few_words", "repeated_words", "symbols"]
    assert rules.POLICIES[0].mask == 3


def test_empty_and_no_python(texts, spark):
    measured = rules.decide(rules.ledger(rules.measure(texts((1, "x")).where("doc_id > 1"))))
    assert measured.count() == 0
    plan = measured._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("text", ["a  b", "\ta\x0bb\x0cc\r", "é" * 10])
def test_spaces(texts, text):
    row = rules.measure(texts((1, text))).first()
    assert (row["n_words"], row["word_chars"]) == plain(text)[:2]
