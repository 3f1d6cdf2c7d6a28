import random

import pytest

from lingua_spark.llm.chosen_path import Join, keep_one, shingles, similar
from lingua_spark.llm.components import components


def slow(rows, threshold=0.8):
    sets = [set(shingles(t).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    out = []
    for i, (key, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((key, min(group) if group else None if sets[i] else key, links[i]))
    return sorted(out, key=str)


def world(seed, docs=260):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [draw.choice(vocabulary) for _ in range(60)]
    texts = []
    base = [draw.choice(vocabulary) for _ in range(80)]
    for i in range(docs):
        kind = draw.random()
        if kind < 0.45:  # one large group of near copies
            words = list(base)
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
        elif kind < 0.6 and texts:
            words = draw.choice(texts).split()
            if words and draw.random() < 0.6:
                words[draw.randrange(len(words))] = "x"
        else:
            words = [draw.choice(vocabulary) for _ in range(draw.randint(0, 90))]
            if draw.random() < 0.5:
                words += common
        texts.append(" ".join(words))
    return [(i * 3 % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = world(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    # small nodes and blocks, so that splitting, bands and blocks all happen
    join = Join(brute=6, block_tokens=1500)
    assert sorted(map(tuple, similar(docs, join).collect()), key=str) == slow(rows)
    kept = sorted(r["doc_id"] for r in keep_one(docs, join).collect())
    classes = {c for _, c, _ in slow(rows)}
    assert set(kept) == classes


def test_runs_reach_the_recall():
    assert Join(recall=0.9).runs < Join(recall=0.999999).runs


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, similar(odd).collect()), key=str) == slow(rows)
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "5", "6", "7", "8", "None"]
    assert similar(none).count() == 0 and keep_one(none).count() == 0
    same = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (None, "q r s t u"), (None, "q r s t u"), (4, "other words in this row")], "doc_id bigint, text string")
    assert sorted(map(str, (tuple(r) for r in keep_one(same).collect()))) == ["(4, 'a b c d e f')", "(4, 'other words in this row')", "(None, 'q r s t u')"]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 8), (5, 1), (4, 5)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert {got[i] for i in (1, 2, 3, 4, 5)} == {1} and got[9] == got[8] == 8
    assert {got[100 + i] for i in range(61)} == {100}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0
