import random
import re
from collections import Counter

import pytest

from lingua_spark.llm.quality_rules import Bands, duplicate_lines, judge, keep_good, quality, repeated_words

import zstandard


def slow_repeats(words, window):
    spans = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    seen, covered = Counter(spans), set()
    for i, span in enumerate(spans):
        if seen[span] > 1:
            covered.update(range(i, i + window))
    return len(covered)


@pytest.mark.parametrize("seed", range(40))
def test_repeated_words_equal_brute_force(seed):
    draw = random.Random(seed)
    words = [draw.choice([b"a", b"b", b"c"][: draw.randint(1, 3)]) for _ in range(draw.randint(0, 60))]
    assert repeated_words(words, 5) == slow_repeats(words, 5)


def test_duplicate_lines_need_a_word_and_an_equal_earlier_line():
    assert duplicate_lines("a\nb\na\n\n \n \na ") == 1
    assert duplicate_lines("") == 0


def test_columns_equal_brute_force():
    draw, bands = random.Random(3), Bands()
    compressor = zstandard.ZstdCompressor(level=bands.level)
    for trial in range(300):
        pieces = ["a", "é", "日本", "#", "<|>", "$%", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\u2028", "word", "\n\n", " x y z w v "]
        text = "".join(draw.choices(pieces, k=draw.choice((0, 5, 60, 6000) if trial % 10 == 0 else (0, 5, 60))))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        n, chars, symbols, lines, repeats, failed, ratio, share, kept = judge(text, bands, compressor)
        assert (n, chars, symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        filled = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert lines == sum(x in filled[:i] for i, x in enumerate(filled))
        assert repeats == slow_repeats(words, 5)
        assert failed == (n < 10 or 100 * repeats > 20 * n)
        raw = text.encode()
        low, high = [b[1:] for b in bands.whole if b[0] <= len(raw)][-1]
        chunks = [raw[i : i + bands.chunk_bytes] for i in range(0, len(raw), bands.chunk_bytes)]
        chunks = [c for c in chunks if len(c) >= bands.least_chunk]
        bad = sum(len(c) for c in chunks if not bands.chunk[0] <= len(c) / len(compressor.compress(c)) <= bands.chunk[1])
        fits = bool(raw) and low <= len(raw) / len(compressor.compress(raw)) <= high
        assert kept == (not failed and fits and bad <= bands.bad_share * sum(map(len, chunks)))


def verdict(text):
    return judge(text, Bands(), zstandard.ZstdCompressor(level=3))[-1]


def test_bands_reject_repetition_and_noise():
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdefghijklmnoprstu") for _ in range(draw.randint(2, 9))) for _ in range(900)]
    prose = " ".join(draw.choice(vocabulary) for _ in range(1500))
    assert verdict(prose)
    assert not verdict("buy now cheap pills " * 300)
    noise = "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") + " " * (i % 9 == 8) for i in range(9000))
    assert not verdict(noise)
    assert not verdict(prose[:3000] + " ".join(str(i % 3) + "abab" for i in range(4000)))


def test_odd_rows(odd, none):
    rows = quality(odd).collect()
    assert len(rows) == 10
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["n_words"] == 0 and by_id[2]["base_failed"] and not by_id[2]["kept"]
    for row, text in ((by_id[r["doc_id"]], r["text"]) for r in odd.collect()):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert row["n_words"] == len(words) and row["word_chars"] == sum(map(len, words))
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
    assert by_id[6]["n_repeat_words"] == 52_000 and by_id[6]["base_failed"]
    kept = keep_good(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "4", "8", "None"]
    assert quality(none).count() == 0 and keep_good(none).count() == 0
