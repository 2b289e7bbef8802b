"""Lines on both sides of the size from which sets keep more parity bits."""

import random

import pytest

from furrow.llm.line_dedup import LONG, PERCENT, repeated_lines


def test_long_sets_against_all_pairs(spark):
    rnd = random.Random(5)
    lines = []
    for _ in range(40):
        base = rnd.sample(range(600), rnd.randrange(LONG - 12, 2 * LONG))
        lines.append(base)
        for _ in range(3):  # about the threshold, some longer and some shorter
            cut = rnd.sample(base, len(base) - rnd.randrange(0, len(base) // 6))
            lines.append(cut + rnd.sample(range(600, 900), rnd.randrange(0, len(base) // 6)))
    rnd.shuffle(lines)
    sets = [set(x) for x in lines]
    assert min(map(len, sets)) < LONG < max(map(len, sets))
    expected = {j for j, b in enumerate(sets) for a in sets[:j] if 100 * len(a & b) >= PERCENT * len(a | b)}
    docs = spark.createDataFrame([(i, " ".join(f"w{t}" for t in x)) for i, x in enumerate(lines)], "d bigint, text string")
    assert {r.d for r in repeated_lines(docs).collect()} == expected
    assert 20 < len(expected) < len(lines)


def test_rarity_stands_in_no_plan_and_words_are_found_once(spark, monkeypatch):
    from furrow.llm import line_dedup

    plans = {}
    keep = line_dedup.materialize

    def note(df, name):
        plans.setdefault(name, df._jdf.queryExecution().toString())
        return keep(df, name)

    monkeypatch.setattr(line_dedup, "materialize", note)
    docs = spark.createDataFrame([(1, "a b c\n\n \nx"), (2, "a b c\nd\n"), (3, None), (4, "")], "d long, text string")
    assert sorted(map(tuple, repeated_lines(docs).collect())) == [(2, 0)]
    assert max(map(len, plans.values())) < 1 << 20  # 2 ** 20 levels as a literal take twice that
    physical = plans["lines"].split("== Physical Plan ==")[1]
    assert not [x for x in physical.splitlines() if "Filter" in x and "split" in x]


def _random_lines():
    rnd = random.Random(8)
    common, rare = [f"c{i}" for i in range(10)], [f"r{i}" for i in range(300)]
    base = [rnd.sample(common, 5) + rnd.sample(rare, rnd.randrange(1, 12)) for _ in range(12)]
    lines = []
    for _ in range(250):
        x = list(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            x[rnd.randrange(len(x))] = rnd.choice(rare)
        lines.append(rnd.choice([" ", "\t", "  ", "\r", "\x0b"]).join(x))
    return lines


@pytest.mark.parametrize("group", [4, 256])
def test_groups_on_both_sides_of_the_limit_against_all_pairs(spark, monkeypatch, group):
    """Also words parted by other white space than blanks."""
    from furrow.llm import line_dedup

    monkeypatch.setattr(line_dedup, "GROUP", group)
    lines = _random_lines()
    sets = [set(x.split()) for x in lines]
    expected = {j for j, b in enumerate(sets) for a in sets[:j] if 100 * len(a & b) >= PERCENT * len(a | b)}
    docs = spark.createDataFrame(list(enumerate(lines)), "d bigint, text string")
    assert sorted(r.d for r in repeated_lines(docs).distinct().collect()) == sorted(expected)
    assert 20 < len(expected) < len(lines)


def test_rows_of_a_word_that_a_hundred_lines_share_are_not_written(spark, monkeypatch):
    """Such rows, nearly all of a large table's, made its disk grow faster than the table."""
    from furrow.llm import line_dedup

    written = []
    keep = line_dedup.materialize

    def note(df, name):
        out = keep(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(line_dedup, "materialize", note)
    rows = [(i, f"shared own{i}") for i in range(100)]
    assert repeated_lines(spark.createDataFrame(rows, "d bigint, text string")).count() == 0
    assert [n for name, n in written if name == "lines-pairs"] == [0, 0]


def test_words_that_share_a_number_against_all_pairs(spark, monkeypatch):
    """Numbers are kept in few bits: with 2 of them nearly all words share one."""
    from furrow.llm import line_dedup

    monkeypatch.setattr(line_dedup, "HASH", 2)
    lines = _random_lines()
    sets = [set(x.split()) for x in lines]
    expected = {j for j, b in enumerate(sets) for a in sets[:j] if 100 * len(a & b) >= PERCENT * len(a | b)}
    docs = spark.createDataFrame(list(enumerate(lines)), "d bigint, text string")
    assert sorted(r.d for r in repeated_lines(docs).distinct().collect()) == sorted(expected)


def test_equal_sets_are_found_by_name_and_words_are_distinct_before_they_are_ranked(spark, monkeypatch):
    """Grouping whole rows sorted them, and every repeat of a word was ranked."""
    from furrow.llm import line_dedup

    plans = {}
    keep = line_dedup.materialize

    def note(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(line_dedup, "materialize", note)
    docs = spark.createDataFrame([(1, "a b c\nc b a\nx"), (2, "a b c\nd\n")], "d long, text string")
    assert sorted(map(tuple, repeated_lines(docs).collect())) == [(1, 1), (2, 0)]
    assert not [x for x in plans["lines-pairs"].splitlines() if "Aggregate(" in x and "prefix" in x]
    ranked = [x for x in plans["lines"].splitlines() if "Subquery" in x and "transform(" in x]
    assert ranked and not [x for x in ranked if "split(" in x]
