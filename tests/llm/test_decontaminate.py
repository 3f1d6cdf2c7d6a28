import random

import pytest

from lingua_spark.llm.decontaminate import Matcher, Matching, Pattern, budget, drop_leaks, find_leaks, plain


def slow(item, text, most):
    """Least edit distance of the item to any passage, by the full table."""
    before, best = list(range(len(item) + 1)), None
    for letter in [*text]:
        now = [0]
        for i, own in enumerate(item, 1):
            now.append(min(before[i] + 1, now[-1] + 1, before[i - 1] + (own != letter)))
        before = now
        if now[-1] <= most and (best is None or now[-1] < best):
            best = now[-1]
    return best


@pytest.mark.parametrize("seed", range(30))
def test_equals_the_full_table(seed):
    draw, options = random.Random(seed), Matching(error_rate=0.2, least_letters=5)
    for _ in range(40):
        item = "".join(draw.choice("abc") for _ in range(draw.randint(5, 25)))
        inside = list(item)
        for _ in range(draw.randint(0, 6)):
            at, kind = draw.randrange(len(inside) + 1), draw.random()
            if kind < 0.4:
                inside.insert(at, draw.choice("abcd"))
            elif inside:
                inside[min(at, len(inside) - 1)] = "" if kind < 0.7 else draw.choice("abcd")
        text = "".join(draw.choice("abcd") for _ in range(draw.randint(0, 40)))
        text = plain(text + "".join(inside) + text[::-1])
        got = Matcher([("x", item)], options).matches(text)
        want = slow(item, text, budget(item, options))
        assert (got[0][1] if got else None) == want


def test_pattern_without_error():
    assert Pattern("needle").best("hay needle hay", 2) == (0, 10)
    assert Pattern("needle").best("hay", 2) is None


ITEM = "what is the name of the river that runs through the oldest part of the town"


def test_frames(spark, odd, none):
    near = "Some text. What is  the NAME of the rivr that runs through the oldest part of a town? And more."
    docs = spark.createDataFrame([(11, near), (12, ITEM.replace("oldest part of the", "")), (11, ITEM), (None, ITEM)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (5, ITEM)], "item_id bigint, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in find_leaks(docs, bench).collect()), key=str)
    assert got == sorted([(11, 1, 4), (11, 5, 4), (11, 1, 0), (11, 5, 0), (None, 1, 0), (None, 5, 0)], key=str)
    # blocks of one item each give the same
    small = Matching(block_letters=10)
    assert sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in find_leaks(docs, bench, small).collect()), key=str) == got
    assert [r["doc_id"] for r in drop_leaks(docs, bench).collect()] == [12]
    assert find_leaks(odd, bench.limit(0)).count() == 0 and find_leaks(none, bench).count() == 0
    kept = drop_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 10
