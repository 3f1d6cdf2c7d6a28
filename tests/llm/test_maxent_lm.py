import math
import re
import zlib
from collections import Counter

import pyarrow as pa

from lingua_spark.llm.maxent_lm import CLASSES, Training, buffers, classed_tokens, score, word_shapes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def is_held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def slow(rows):
    counts = Counter(t for i, text in rows if not is_held(i) for t in tokens_of(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        words = tokens_of(text)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in words)
        out.append((i, is_held(i), len(words), sum(counts[t] > 0 for t in words), n, round(base, 6)))
    return sorted(out, key=str)


def plain(rows):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    return sorted((*(r[c] for c in names), round(r["base_score"], 6)) for r in rows) if False else sorted(
        ((*(r[c] for c in names), round(r["base_score"], 6)) for r in rows), key=str
    )


def test_base_equals_counting_and_model_is_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for options in (Training(), Training(head_words=50, flush_words=100)):
        got = score(docs, options).collect()
        assert plain(got) == slow(rows)
        held = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_odd_rows(odd, none):
    got = score(odd).collect()
    assert plain(got) == slow([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert all(math.isfinite(r["score"]) for r in got)
    assert score(none).count() == 0
    held = odd.filter("doc_id is null")
    assert score(held).first()["train_tokens"] == 0


def test_model_is_a_probability(spark):
    """Over all classes after any history, and over a class's tokens, it sums to one."""
    import numpy as np

    from lingua_spark.llm.maxent_lm import HISTORIES, train

    cells = spark.createDataFrame([(0, 1, 30), (0, 2, 10), (40, 0, 5), (HISTORIES - 1, 7, 9)], "history int, class int, n bigint")
    shares = np.exp(train(cells, Training(steps=30)))
    assert np.allclose(shares.sum(1), 1)
    assert shares[0].argmax() == 1 and shares[40].argmax() == 0


def test_tokens_of_buffers():
    texts = pa.array(["Ab cd", None, "", " x\tY z", "end"], pa.string())
    raw, bounds = buffers(texts)
    kinds, _, before = word_shapes(raw, bounds)
    assert before.tolist() == [0, 2, 2, 2, 5, 6] and len(kinds) == 6
    history, classes, starts = classed_tokens(raw, bounds)
    assert starts.tolist() == [0, 3, 4, 5, 9] and (classes == 0).sum() == 5
    assert history[starts].tolist() == [0] * 5
    assert (history[starts[[0, 3]] + 1] % CLASSES).tolist() == [0, 0]
    lower = word_shapes(*buffers(pa.array(["ab"])))
    upper = word_shapes(*buffers(pa.array(["AB"])))
    assert lower[0] == upper[0] and lower[1] == upper[1]


def test_places_of_any_history_sum_to_one():
    import numpy as np

    from lingua_spark.llm.maxent_lm import FREQUENT, SHARED, SPREAD, class_odds, decisions, lexicon_of

    random = np.random.default_rng(3)
    words = [(b"w%d" % i, int(n), (FREQUENT + 1 + i % 5) * SPREAD + i % 7) for i, n in enumerate(random.integers(1, 300, 60))]
    lexicon = lexicon_of(words, {200: (50, 9)}, sum(n for _, n, _ in words) + 50)
    logits = random.normal(size=(2, CLASSES))
    odds = np.tile(class_odds(logits - np.log(np.exp(logits).sum(1, keepdims=True))), 5000)
    weights = random.normal(size=1 << 10).astype(np.float32)
    places = np.array([0, *range((FREQUENT + 1) * SPREAD, SHARED + len(words))])
    for before, earlier in ((0, 0), (SHARED + 4, 200), (201, SHARED)):
        first, branch, found, _ = decisions(
            places, np.full_like(places, before), np.full_like(places, earlier), lexicon, odds, weights, 10
        )
        logs = [math.log(1 / (1 + math.exp(-z if b else z))) for b, z in zip(branch.tolist(), found.tolist())]
        stops = [*first[1:].tolist(), len(logs)]
        used = sum(math.exp(sum(logs[i:j])) for i, j in zip(first.tolist(), stops))
        empty = [c for c in range(1, FREQUENT + 1) if c not in set((lexicon.shapes // SPREAD)[SHARED:].tolist())]
        assert used <= 1 + 1e-4
        assert empty or abs(used - 1) < 1e-4


def test_history_decides_inside_a_class(spark):
    """Equally frequent words with one ending, each after its own word."""
    rows = [(i, "a a a a a p wen" if i % 2 else "a a a a a q yen") for i in range(400)]
    rows += [(1000, "a a a a a p yen"), (1001, "a a a a a q wen")]
    got = {r["doc_id"]: r["score"] for r in score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] > got[1000] + 0.2 and got[0] > got[1001] + 0.2
