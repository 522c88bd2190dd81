"""J7 with rules as a table, against each pattern on each line."""

import random
import re

import pytest

from tidewatch.operators import rules


@pytest.mark.parametrize(
    "pattern,pieces",
    [
        ("abcdef", ["abcdef"]),
        ("(?i)ABC def", ["abc def"]),
        (r"\bfoobar\b", ["foobar"]),
        ("ab[0-9]cdefg.*xy", ["cdefg"]),
        ("(hello|world!) x", ["hello", "world!"]),
        ("(hello|wo)there", ["there"]),
        ("(hello|wo)", []),
        ("(longer)?text", ["text"]),
        ("(?:pass){2,}word", ["pass"]),
        ("(?:pass)*wor", []),
        ("naïve text", ["ve text"]),
        (r"\p{L}+abcde", []),
        ("[abcd]+", []),
        ("(?=ahead)behind", ["behind"]),
        ("((abcd)|(efgh))(ijklm)+", ["ijklm"]),
    ],
)
def test_needed_pieces(pattern, pieces):
    assert rules.needed_pieces(pattern) == pieces


def test_ten_thousand_rules_equal_each_pattern_on_each_line(spark):
    rng = random.Random(2)
    letters = "abcdefgh"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(500)]
    lines = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))).replace("a", rng.choice("aA"))) for i in range(150)] + [(900, None), (901, "")]
    made = []
    for k in range(10_000):
        a, b, c = (rng.choice(words) for _ in range(3))
        shape = k % 5
        made.append((k, [f"{a} {b}", f"(?i){a}{b[0]}? {c}", f"({a} {b}|{b} {c})", f"^{a} .*{b}{c}", f"{a}x{b}"][shape], c if k % 3 == 0 else None))
    made += [(10_000, "[ab]b+", None), (10_001, "zz?|hh", "ab"), (10_002, None, None), (10_003, r"\bhh", None)]
    found = rules.match_rules(spark.createDataFrame(lines, "id long, line string"), "line", spark.createDataFrame(made, "rule_id long, pattern string, exempt_pattern string"), ["id"])
    want = {(i, k) for k, p, e in made if p for i, t in lines if t is not None and re.search(p, t) and not (e and re.search(e, t))}
    assert {tuple(r) for r in found.collect()} == want and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_shuffled_pieces_and_limits(spark, monkeypatch):
    lines = spark.createDataFrame([(1, "error: disk full"), (2, "all is well"), (1, "error: disk full")], "id long, line string")
    table = spark.createDataFrame([("full", "disk (full|gone)"), ("well", "well$")], "rule_id string, pattern string")
    monkeypatch.setattr(rules, "BROADCAST", 0)
    assert sorted(map(tuple, rules.match_rules(lines, "line", table, ["id"]).collect())) == [(1, "full"), (2, "well")]
    assert rules.match_rules(lines, "line", table.limit(0), ["id"]).count() == 0
    monkeypatch.setattr(rules, "WITHOUT", 1)
    with pytest.raises(ValueError, match="no text"):
        rules.match_rules(lines, "line", spark.createDataFrame([(1, "a"), (2, "b")], "rule_id long, pattern string"), ["id"])
