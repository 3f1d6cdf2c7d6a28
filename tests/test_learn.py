import math
import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from lingua_spark.functions.segmentation import best_path, merge_symbols, merge_with_dropout
from lingua_spark.learn import batching, bpe, context, parity, phrases, unigram, wordtable
from lingua_spark.learn.api import fit
from lingua_spark.learn.model import EventReplay, initial_symbols, read_tokenizer
from lingua_spark.learn.wordtable import segment_all, symbol_table
from lingua_spark.operators.corpus import first_bytes
from lingua_spark.sources.sinks import write_tokenizer


def corpus(seed=3, n=300):
    rng = random.Random(seed)
    stems = ["the", "then", "there", "aaaa", "aaab", "banana", "bandana", "été", "être", "lower", "lowest", "new", "newer"]
    return [" ".join(rng.choice(stems) + rng.choice(["", "s", "er", "é"]) for _ in range(12)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def count_pairs(words):
    pairs = Counter()
    for symbols, n in words.values():
        for pair in zip(symbols, symbols[1:]):
            pairs[pair] += n
    return pairs


def rewrite(symbols, old, new):
    out, i = [], 0
    while i < len(symbols):
        if symbols[i : i + len(old)] == old:
            out += new
            i += len(old)
        else:
            out.append(symbols[i])
            i += 1
    return out


def table(texts, unit="byte"):
    counts = Counter(w for t in texts for w in t.split())
    return {w: (initial_symbols(w, unit), n) for w, n in counts.items()}


def best(words, low=2, allowed=lambda pair: True):
    pairs = [(n, p) for p, n in count_pairs(words).items() if n >= low and allowed(p)]
    return min(pairs, key=lambda x: (-x[0], x[1])) if pairs else None


def apply(words, old, new):
    return {w: (rewrite(s, old, new), n) for w, (s, n) in words.items()}


def one_by_one(texts, n, unit="byte", allowed=lambda pair: True):
    words, out = table(texts, unit), []
    while len(out) < n and (found := best(words, 2, allowed)):
        (left, right) = found[1]
        words = apply(words, [left, right], [left + right])
        out.append((left, right, found[0]))
    return out


def learned(model):
    return [(e.left, e.right, e.n) for e in model.events]


def test_batched_merges_equal_one_by_one(df, texts):
    assert learned(bpe.learn_bpe(df, n_merges=45, preset="words")) == one_by_one(texts, 45)


def by_epochs(words, n, pairs):
    """The learner's loop on a plain dictionary of words."""
    out, known, epochs = [], {s for symbols, _ in words.values() for s in symbols}, 0
    while len(out) < n:
        ranked = sorted((-k, *p) for p, k in count_pairs(words).items() if k >= 2)
        if not ranked:
            break
        keys = {p[1:] for p in ranked[:pairs]}
        segments = Counter()
        for symbols, k in words.values():
            for segment in batching.segments_of(symbols, keys):
                segments[segment] += k
        now = batching.Epoch(keys)
        for segment, k in segments.items():
            now.add((), segment, k)
        bound = ranked[pairs] if len(ranked) > pairs else None
        now.ready({(): bound and batching.Candidate(bound[1], bound[2], -bound[0])})
        epochs, before = epochs + 1, len(out)
        while len(out) < n and (pair := now.next((), 2)):
            made = now.merge(pair.left, pair.right)
            after = apply(words, [pair.left, pair.right], [pair.merged])
            assert made.get((), 0) == sum((len(s) - len(after[w][0])) * k for w, (s, k) in words.items())
            words = after
            out.append((pair.left, pair.right, pair.n))
            if pair.merged in known:
                break
            known.add(pair.merged)
        assert len(out) > before
    return out, epochs


def test_epochs_equal_one_by_one():
    """Small alphabets: ties, overlaps and symbols that two merges make."""
    rng, fewer = random.Random(7), 0
    for _ in range(300):
        letters = rng.choice(["ab", "abc", "abcdef"])
        texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 25)))]
        expected = one_by_one(texts, 30)
        got, epochs = by_epochs(table(texts), 30, rng.choice([1, 2, 3, 5, 20]))
        assert got == expected
        fewer += epochs < len(expected)
    assert fewer > 100


@pytest.mark.parametrize("width", [dict(pairs=1, most=2), dict(pairs=64, segments=40), dict(pairs=8, letters=300, most=9)])
def test_width_changes_no_merge(df, texts, monkeypatch, width):
    monkeypatch.setattr(bpe, "Width", lambda: batching.Width(**width))
    assert learned(bpe.learn_bpe(df, n_merges=12, preset="words")) == one_by_one(texts, 12)


def test_character_symbols_and_maximum_length(df, texts):
    got = bpe.learn_bpe(df, n_merges=15, preset="words", unit="char", max_type_length=3)

    def short(pair):
        return sum(len(bytes.fromhex(s).decode()) for s in pair) <= 3

    assert learned(got) == one_by_one(texts, 15, "char", short)


def test_stops_below_the_minimum_frequency(spark):
    df = spark.createDataFrame([("ab ab cd",)], "text string")
    assert [(e.left, e.right) for e in bpe.learn_bpe(df, n_merges=9, preset="words").events] == [("61", "62")]


def test_vocabulary_size_and_ids(df):
    model = bpe.learn_bpe(df, vocab_size=40, preset="words")
    rows = model.vocab_table().orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(40))
    assert [r["token"] for r in rows[:5]] == ["<pad>", "<s>", "</s>", "<unk>", "<mask>"]
    assert model.vocab_size == 40


def test_same_merges_as_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    # Counts without ties, so that both must agree.
    words = {"hug": 101, "pug": 53, "pun": 127, "bun": 41, "hugs": 57, "gnu": 13}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    library = tokenizers.Tokenizer(tokenizers.models.BPE())
    library.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    library.train_from_iterator([text], tokenizers.trainers.BpeTrainer(vocab_size=14, show_progress=False))
    import json

    expected = [tuple(m) for m in json.loads(library.to_str())["model"]["merges"]]
    df = spark.createDataFrame([(text,)], "text string")
    model = bpe.learn_bpe(df, n_merges=len(expected), preset="whitespace")
    assert [tuple(bytes.fromhex(s).decode() for s in m) for m in model.merges] == expected
    tokens = model.encode(df, as_tokens=True, out="tokens").first()["tokens"]
    assert [bytes.fromhex(t).decode() for t in tokens] == library.encode(text).tokens


def test_decoding_gives_the_text_back(spark, df, texts):
    model = bpe.learn_bpe(df, n_merges=10)
    rows = model.encode(df, out="tokens", as_tokens=True).collect()
    assert {r["doc_id"]: bytes.fromhex("".join(r["tokens"])).decode() for r in rows} == dict(enumerate(texts))
    other = spark.createDataFrame([(0, "the 東")], "doc_id long, text string")
    assert model.encode(other).first()["input_ids"].count(model.special.index("<unk>")) == 3


def test_heap_merging_equals_replaying():
    rng = random.Random(0)
    for _ in range(200):
        symbols = [rng.choice("abc") for _ in range(rng.randrange(1, 14))]
        merges, known = [], ["a", "b", "c"]
        for _ in range(6):
            pair = (rng.choice(known), rng.choice(known))
            if "".join(pair) not in known:
                merges.append(pair)
                known.append("".join(pair))
        # Each step merges the lowest-ranked pair present.
        ranks, parts = {m: i for i, m in enumerate(merges)}, list(symbols)
        while present := [ranks[p] for p in zip(parts, parts[1:]) if p in ranks]:
            left, right = merges[min(present)]
            parts = rewrite(parts, [left, right], [left + right])
        assert merge_symbols(symbols, ranks) == parts
        assert merge_with_dropout(symbols, ranks, 0.0, "k") == parts
        assert merge_with_dropout(symbols, ranks, 1.1, "k") == symbols


def test_merge_lists_are_replayed_alike(spark, df):
    model = bpe.learn_bpe(df, n_merges=55, preset="words")
    words = symbol_table(df, preset="words")
    ways = [sorted(r["syms"] for r in segment_all(words, model.merges, n).collect()) for n in (0, 54, 55)]
    assert ways[0] == ways[1] == ways[2]


def test_picky_equals_a_loop(df, texts):
    model = bpe.learn_picky_bpe(df, n_events=25, preset="words", threshold=0.6)
    words, made, alive, expected = table(texts), {}, set(), []
    while len(expected) < 25:
        n, (left, right) = best(words)
        freq = Counter()
        for symbols, k in words.values():
            for s in symbols:
                freq[s] += k
        words = apply(words, [left, right], [left + right])
        made[left + right] = (left, right)
        alive.add(left + right)
        expected.append(("+", left, right))
        queue = [s for s in dict.fromkeys((left, right)) if s in made and n / freq[s] >= 0.6]
        while queue:
            token = queue.pop(0)
            words = apply(words, [token], list(made[token]))
            alive.discard(token)
            expected.append(("-", *made[token]))
            queue += [s for s in dict.fromkeys(made[token]) if s in made and s not in alive]
    assert [(e.kind, e.left, e.right) for e in model.events] == expected
    assert any(e.kind == "-" for e in model.events)
    replay = EventReplay([(e.kind, e.left, e.right) for e in model.events])
    assert {w: replay.apply(initial_symbols(w, "byte")) for w in words} == {w: s for w, (s, _) in words.items()}
    tokens = {t for r in model.encode(df, out="t", as_tokens=True).collect() for t in r["t"]}
    assert tokens <= set(model.tokens)


def replay_by_scan(events, symbols):
    """One event after the other over the whole word."""
    for kind, left, right in events:
        done, i = [], 0
        while i < len(symbols):
            if kind == "+" and symbols[i : i + 2] == [left, right]:
                done.append(left + right)
                i += 2
                continue
            done += [left, right] if kind == "-" and symbols[i] == left + right else [symbols[i]]
            i += 1
        symbols = done
    return symbols


def random_events(rng, n):
    """Merges of known tokens, some of them removed and some made again."""
    known, made, events = ["61", "62", "63"], [], []
    for _ in range(n):
        if made and rng.random() < 0.35:
            events.append(("-", *rng.choice(made)))
            continue
        left, right = rng.choice(known), rng.choice(known)
        if len(left + right) <= 16:
            events.append(("+", left, right))
            made.append((left, right))
            known.append(left + right)
    return events


def test_replay_of_events_equals_a_scan():
    rng = random.Random(11)
    for trial in range(400):
        events = random_events(rng, 40)
        replay = EventReplay(events)
        for word in ("", "a", "aaaaaaa", "".join(rng.choice("abc") for _ in range(rng.randint(2, 60)))):
            symbols = initial_symbols(word, "byte")
            assert replay.apply(list(symbols)) == replay_by_scan(events, symbols), (trial, word)


def test_replay_of_a_long_word_is_near_linear():
    rng = random.Random(12)
    replay, spent = EventReplay(random_events(rng, 60)), []
    for size in (100_000, 1_000_000):
        symbols = initial_symbols("".join(rng.choices("abc", k=size)), "byte")
        start = time.process_time()
        found = replay.apply(symbols)
        spent.append(time.process_time() - start)
        assert "".join(found) == "".join(symbols)
    assert spent[1] < 40 * spent[0] + 1


def test_scaffolds_are_rarer_than_the_next_pair(df, texts):
    model = bpe.learn_scaffold_bpe(df, n_merges=25, preset="words")
    words = table(texts)
    for left, right in model.merges:
        found = best(words, 2, lambda p: len(p[0] + p[1]) <= 32)
        assert found[1] == (left, right)
        words = apply(words, [left, right], [left + right])
    assert model.hidden and model.hidden.isdisjoint(model.alphabet)
    tokens = [t for r in model.encode(df, out="t", as_tokens=True).collect() for t in r["t"]]
    assert model.hidden.isdisjoint(tokens)
    assert bytes.fromhex("".join(tokens[:200])).decode("utf-8", "ignore")


def test_trimming_expands_rare_tokens(df):
    model = bpe.learn_bpe(df, n_merges=30, preset="words")
    counts = {r["token"]: r["n"] for r in bpe.token_counts(model, df).collect()}
    trimmed = bpe.trim_bpe(model, df, min_count=150)
    made = {left + right for left, right in model.merges}
    assert trimmed.hidden == {t for t in made if counts.get(t, 0) < 150} != set()
    tokens = {t for r in trimmed.encode(df, out="t", as_tokens=True).collect() for t in r["t"]}
    assert trimmed.hidden.isdisjoint(tokens) and tokens <= set(trimmed.tokens)


def test_second_phase_merges_across_words(df):
    model = bpe.learn_super_bpe(df, n_merges=40, phase1_merges=25, preset="words", preset_phase2="text")
    first = bpe.learn_bpe(df, n_merges=25, preset="words")
    assert model.merges[:25] == first.merges
    assert any("20" in bytes.fromhex(a + b).hex(" ").split() for a, b in model.merges[25:])


def test_second_phase_from_given_merges(df):
    both = bpe.learn_super_bpe(df, n_merges=12, phase1_merges=8, preset="words", preset_phase2="text")
    given = bpe.learn_super_bpe(df, n_merges=12, phase1_merges=8, preset_phase2="text", merges=both.merges[:10])
    assert given.merges == both.merges and set(given.alphabet) == set(both.alphabet)


def test_first_bytes(spark, df):
    rows = [(1, "ab"), (2, None), (3, "é"), (4, ""), (5, "abc"), (5, "abc"), (5, "abc"), (6, "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def kept(n):
        return sorted((r["doc_id"], r["text"] or "") for r in first_bytes(table, n).collect())

    plain = [(i, t or "") for i, t in rows]
    for n in (0, 2, 3, 7, 10, 14):
        fits, total = [], 0
        for row in plain:
            total += len(row[1].encode())
            if total > n:
                break
            fits.append(row)
        assert kept(n) == sorted(fits), n
    assert first_bytes(table.limit(0), 5).count() == 0
    size = sum(len(r["text"].encode()) for r in df.filter("doc_id < 50").collect())
    options = {"n_merges": 20, "phase1_merges": 12, "preset": "words", "preset_phase2": "text"}
    assert bpe.learn_super_bpe(df, num_bytes=size, **options).events == bpe.learn_super_bpe(df.filter("doc_id < 50"), **options).events


def test_dropout_is_reproducible(spark, df):
    model = bpe.learn_bpe(df, n_merges=20, preset="words")
    plain = {r["doc_id"]: r["t"] for r in model.encode(df, out="t", as_tokens=True).collect()}
    none = {r["doc_id"]: r["tokens"] for r in model.encode_dropout(df, 0.0).collect()}
    some = {r["doc_id"]: r["tokens"] for r in model.encode_dropout(df, 0.3).collect()}
    again = {r["doc_id"]: r["tokens"] for r in model.encode_dropout(df.repartition(7), 0.3).collect()}
    assert none == plain and some == again != plain
    assert all("".join(some[k]) == "".join(plain[k]) for k in plain)


def two_languages(spark):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        lang = "a" if i % 3 else "b"
        letters = "abcd" if lang == "a" else "wxyz"
        rows.append((i, lang, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(9))))
    return rows, spark.createDataFrame(rows, "doc_id long, lang string, text string")


def test_parity_serves_the_worst_language(spark):
    rows, df = two_languages(spark)
    model = parity.learn_parity_bpe(df, 18, dev=df, unit="byte")
    words = {(lang, w): None for _, lang, t in rows for w in t.split()}
    counts = Counter((lang, w) for _, lang, t in rows for w in t.split())
    words = {k: (initial_symbols(k[1], "byte"), counts[k]) for k in words}
    units = Counter()
    for _, lang, t in rows:
        units[lang] += len(t.encode())
    for left, right in model.merges:
        tokens = Counter()
        for (lang, _), (symbols, n) in words.items():
            tokens[lang] += n * len(symbols)
        worst = min("ba", key=lambda lang: units[lang] / tokens[lang])  # b comes first
        n, pair = best({k: v for k, v in words.items() if k[0] == worst})
        assert pair == (left, right)
        words = apply(words, [left, right], [left + right])


def test_parity_preconditions(spark):
    _, df = two_languages(spark)
    with pytest.raises(ValueError, match="development texts or target ratios"):
        parity.learn_parity_bpe(df, 2)
    with pytest.raises(ValueError, match="two languages"):
        parity.learn_parity_bpe(df.filter("lang = 'a'"), 2, dev=df)
    with pytest.raises(ValueError, match="match"):
        parity.learn_parity_bpe(df, 2, dev=df.filter("lang = 'a'"))


def test_parity_ratio_moves_the_turns(spark):
    _, df = two_languages(spark)

    def served(ratio):
        merges = parity.learn_parity_bpe(df, 10, ratio=ratio).merges
        return sum(bytes.fromhex(left + right).decode() > "m" for left, right in merges)

    assert served({"a": 1.0, "b": 3.0}) > served({"a": 3.0, "b": 1.0})


def test_unigram_likelihood_and_size(df, texts):
    model = unigram.learn_unigram(df, 40, initial_vocab_size=200, max_piece_length=6)
    assert model.vocab_size <= 40
    assert set("".join(texts).replace(" ", "")) <= set(model.logp)
    assert sum(math.exp(p) for p in model.logp.values()) == pytest.approx(1.0, abs=0.05)
    tokens = {r["doc_id"]: "".join(r["tokens"]) for r in model.encode(df, out="tokens", as_tokens=True).collect()}
    assert tokens == {i: t.replace(" ", "") for i, t in enumerate(texts)}


def test_em_raises_the_likelihood(spark, df):
    words = unigram.stage_spread(unigram.word_counts(df, preset="words"))
    seeds = unigram.seed_pieces(words, 100, 5).toPandas()
    logp = np.log(seeds["score"].to_numpy(float) / seeds["score"].sum())
    pieces = list(seeds["piece"])
    index = spark.sparkContext.broadcast(unigram.numbers(pieces))
    history, plain = [], {r["word"]: r["freq"] for r in words.collect()}
    for _ in range(5):
        value, counts = unigram._expectation(words, index, logp, 5)
        known = {p: logp[i] for i, p in enumerate(pieces) if np.isfinite(logp[i])}
        assert value == pytest.approx(sum(f * forward(w, known) for w, f in plain.items()))
        history.append(value)
        with np.errstate(divide="ignore"):
            logp = np.log(counts / counts.sum())
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:]))


def forward(word, logp):
    """Log-likelihood of a word, plainly."""
    ahead = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        ahead[j] = sum(ahead[i] * math.exp(logp[word[i:j]]) for i in range(j) if word[i:j] in logp)
    return math.log(ahead[-1])


@pytest.mark.parametrize("cells", [1 << 19, 7, 1])
def test_lattices_by_enumeration(monkeypatch, cells):
    monkeypatch.setattr(unigram, "CELLS", cells)
    logp = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -2.2, "aba": -4.0}
    index, values = unigram.numbers(list(logp)), np.array(list(logp.values()))

    def paths(word):
        if not word:
            yield []
        for i in range(1, len(word) + 1):
            if word[:i] in logp:
                yield from ([word[:i], *rest] for rest in paths(word[i:]))

    freq = {"a": 1, "b": 2, "ab": 3, "ba": 1, "abab": 2, "baab": 5, "ababa": 1, "c": 4, "abc": 1}
    likelihood, expected, best = 0.0, Counter(), Counter()
    for word, n in freq.items():
        weights = [(p, math.exp(sum(logp[x] for x in p))) for p in paths(word)]
        if not weights:
            continue
        norm = sum(w for _, w in weights)
        likelihood += n * math.log(norm)
        for path, w in weights:
            for piece in path:
                expected[piece] += n * w / norm
        for piece in best_path(word, logp, 3, -9):
            best[piece] += n
        assert sum(logp[x] for x in best_path(word, logp, 3, -9)) == pytest.approx(math.log(max(w for _, w in weights)))
    total, counts, paths_taken = 0.0, np.zeros(len(logp)), np.zeros(len(logp))
    frame = pd.DataFrame({"word": list(freq), "freq": list(freq.values())})
    seen = 0
    for group, n in unigram.equal_lengths(frame, 3):
        value, some = unigram.Lattices(group, index, values, 3).expectation(n)
        total, counts, seen = total + value, counts + some, seen + len(group)
        paths_taken += unigram.Lattices(group, index, values, 3).best(n)
    assert seen == len(freq) and total == pytest.approx(likelihood)
    assert dict(zip(logp, counts)) == pytest.approx({p: expected[p] for p in logp})
    assert dict(zip(logp, paths_taken)) == {p: best[p] for p in logp}


def test_seeds_are_cut_exactly(spark, df):
    words = unigram.stage_spread(unigram.word_counts(df, preset="words"))
    every = {r["piece"]: r["score"] for r in unigram.seed_pieces(words, 10**6, 5).collect()}
    longer = sorted((p for p in every if len(p) > 1), key=lambda p: (-every[p], p.encode()))
    for size in (0, 1, 7, len(longer) - 1, len(longer)):
        got = [r["piece"] for r in unigram.seed_pieces(words, size, 5).collect()]
        assert sorted(got) == sorted([p for p in every if len(p) == 1] + longer[:size])
    assert unigram.seed_pieces(words.limit(0), 5, 5).count() == 0


def test_the_unigram_query_learns_the_published_vocabulary(spark, tmp_path):
    """Words of 12 letters that come often each stay a piece: many more than 300."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(700)]
    rows = [(i, "en", " ".join(rng.sample(words, 350))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["token"] for r in spark_entry.queries()["learn_unigram"](spark, str(tmp_path)).collect()}
    assert set(words) <= found


def word_trie(words):
    letters = unigram.letters_of(pa.array(words))
    return unigram.trie(letters.codes(), letters.first)


def test_paths_of_tries_are_those_of_lattices():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abé🙂") for _ in range(rng.randint(1, 14))) for _ in range(300)} | {"ab" * 90, "zab", "z"})
    freq = np.array([rng.randint(1, 9) for _ in words], float)
    spelled = [w for w in words if "z" not in w]
    pieces = sorted({w[i : i + k] for w in spelled for i in range(0, len(w), 3) for k in (2, 3, 5)} | set("abé🙂"))
    logp = np.array([unigram.NOTHING if len(p) == 3 and rng.random() < 0.5 else -rng.random() * 9 - 1 for p in pieces])
    automaton = unigram.Automaton(pa.array(pieces))
    nodes, endings = word_trie(words), automaton.endings(logp)
    paths = unigram.Paths(nodes, automaton.states(nodes), endings)
    alive = np.flatnonzero(logp > unigram.NOTHING)
    total, counts, best = 0.0, np.zeros(len(pieces)), np.zeros(len(pieces))
    for group, n in unigram.equal_lengths(pd.DataFrame({"word": words, "freq": freq}), 5):
        lattices = unigram.Lattices(group, unigram.numbers(pieces), logp, 5)
        value, some = lattices.expectation(n)
        total, counts, best = total + value, counts + some, best + lattices.best(n)
    value, some = paths.expectation(freq)
    assert value == pytest.approx(total) and some == pytest.approx(counts[alive])
    value, some = paths.best(freq)
    known = {pieces[i]: logp[i] for i in alive}
    routes = {w: best_path(w, known, 5, -1e6) for w in spelled}
    scores = {w: sum(known[p] for p in route) for w, route in routes.items()}
    assert value == pytest.approx(sum(scores.get(w, 0) * n for w, n in zip(words, freq)))
    assert some == pytest.approx(best[alive])

    gaps = unigram.Paths(automaton.nodes, np.arange(len(automaton.nodes.parent)), endings).gaps()
    for i in alive:
        others = {p: v for p, v in known.items() if p != pieces[i]}
        if len(pieces[i]) > 1:
            rest = sum(others[p] for p in best_path(pieces[i], others, 5, -1e6))
            assert gaps[automaton.nodes.ends[i]] == pytest.approx(logp[i] - rest)


def test_no_pieces_and_unknown_letters_spell_nothing():
    automaton = unigram.Automaton(pa.array(["a", "ab"]))
    nodes = word_trie(["b", "ba", "c"])
    paths = unigram.Paths(nodes, automaton.states(nodes), automaton.endings(np.array([-1.0, -2.0])))
    for value, counts in (paths.expectation(np.ones(3)), paths.best(np.ones(3))):
        assert value == 0 and not counts.any()


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_substrings_of_runs_add_up(rows):
    """Runs of sorted tails, cut anywhere, give each substring once or in parts."""
    rng = random.Random(rows)
    counts = Counter("".join(rng.choice("aé🙂") for _ in range(rng.randint(1, 9))) for _ in range(200))
    found = unigram.tails(pa.array(list(counts)), np.array(list(counts.values())), 4)
    ends = sorted(zip(found["tail"].to_pylist(), found["freq"].to_pylist()))
    whole, parts = {}, Counter()
    for at in range(0, len(ends), rows):
        texts, n = zip(*ends[at : at + rows])
        for piece, count, complete in zip(*unigram.part_counts(pa.array(texts), np.array(n), 2)):
            if complete:
                assert piece.as_py() not in whole
                whole[piece.as_py()] = count
            else:
                parts[piece.as_py()] += count
    plain = Counter()
    for word, n in counts.items():
        for i in range(len(word)):
            for k in range(1, min(4, len(word) - i) + 1):
                plain[word[i : i + k]] += n
    assert not set(whole) & set(parts)
    assert {p: n for p, n in (whole | parts).items() if n > 1 or len(p) == 1} == {
        p: n for p, n in plain.items() if n > 1 or len(p) == 1
    }


def test_unigram_falls_back_to_bytes(spark, tmp_path):
    rows = [(i, "lower newest widest") for i in range(40)] + [(99, "lößer 🙂w"), (100, ""), (101, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit(df, "kudopiece", 300, character_coverage=0.99, initial_vocab_size=100)
    assert model.vocab_size <= 300 and not {"ö", "ß", "🙂"} & set("".join(model.logp))
    copy = str(tmp_path / "model")
    write_tokenizer(model, copy)
    for same in (model, read_tokenizer(spark, copy)):
        got = {r["doc_id"]: r["tokens"] for r in same.encode(df, out="tokens", as_tokens=True).collect()}
        assert "".join(got[99]) == "l<0xC3><0xB6><0xC3><0x9F>er <0xF0><0x9F><0x99><0x82>w"
        assert got[100] == got[101] == [] and "".join(got[0]) == "lower newest widest"
        ids = {r["token"]: r["id"] for r in same.vocab_table().collect()}
        assert len(ids) == same.vocab_size and sorted(ids.values()) == list(range(len(ids)))
        coded = {r["doc_id"]: r["input_ids"] for r in same.encode(df).collect()}
        assert coded == {i: [ids[t] for t in tokens] for i, tokens in got.items()}
    plain = fit(df, "kudopiece", 40, character_coverage=0.99, byte_fallback=False, initial_vocab_size=100)
    assert plain.special.index("<unk>") in plain.encode(df.filter("doc_id = 99")).first()["input_ids"]
    assert fit(df.limit(0), "unigram", 30).logp == {}


def test_substrings_by_hand(spark):
    words = spark.createDataFrame([("abab", 2), ("b", 1)], "word string, freq long")
    got = {r["piece"]: r["n"] for r in unigram.substrings(words, 3).collect()}
    assert got == {"a": 4, "b": 5, "ab": 4, "ba": 2, "aba": 2, "bab": 2}


def test_endless_words_are_windowed(spark):
    rng = random.Random(2)
    for n in (255, 256, 257, 511, 512, 700):
        word = "".join(rng.choice("abc") for _ in range(n))
        table = spark.createDataFrame([(word, 1)], "word string, freq long")
        got = {r["piece"]: r["n"] for r in unigram.substrings(table, 4).collect()}
        assert got == Counter(word[i : i + k] for k in range(1, 5) for i in range(n - k + 1))
        grams = phrases.ngram_vocab(table.select(F.col("word").alias("text")))
        assert {r["token"]: r["n"] for r in grams.collect()} == Counter(word[i : i + 3] for i in range(n - 2))


def test_ngrams_skip_short_words(spark):
    df = spark.createDataFrame([("ab abc abcd",)], "text string")
    assert {r["token"]: r["n"] for r in phrases.ngram_vocab(df).collect()} == {"abc": 2, "bcd": 1}


def test_lzw_phrases():
    assert phrases.lzw_phrases(["ababab"]) == {"a": 1, "b": 1, "ab": 2}
    assert phrases.lzw_phrases(["aaaa", "aaaa"]) == {"a": 3, "aa": 1, "aaa": 1}


def test_lzw_counts_do_not_depend_on_partitions(df):
    runs = [sorted(map(tuple, phrases.lzw_vocab(f, 50).collect())) for f in (df, df.coalesce(1))]
    assert runs[0] == runs[1] and len(runs[0]) == 50


def test_context_pairs(spark):
    tokens = spark.createDataFrame([(["a", "b", "c"],), (["a"],)], "tokens array<string>")
    got = {(r["token"], r["context"]): r["n"] for r in phrases.context_pairs(tokens, 2).collect()}
    assert got == {(x, y): 1 for x in "abc" for y in "abc" if x != y}


def test_sage_keeps_base_symbols_and_size(df):
    model = bpe.learn_bpe(df, n_merges=12, preset="words")
    kept = [r["token"] for r in context.sage_prune(model, df, model.vocab_size - 5, dimension=4).collect()]
    assert len(kept) == model.vocab_size - 5 - len(model.special)
    assert set(model.alphabet) <= set(kept) <= set(model.tokens)


def plain_prune(model, texts, target, o):
    """Context pruning in loops, every text segmented anew after each cut."""
    base, hidden, old = set(model.alphabet), set(), {}
    parents = model.parents()

    def spell(token):
        return [s for p in parents[token] for s in spell(p)] if token in hidden else [token]

    whole = [merge_symbols(initial_symbols(w, "byte"), {m: i for i, m in enumerate(model.merges)}) for t in texts for w in [t]]
    surplus, losses = model.vocab_size - target, {}
    for cut in range(o.cuts):
        pairs = Counter()
        for symbols in whole:
            symbols = [s for t in symbols for s in spell(t)]
            for i, a in enumerate(symbols):
                for b in symbols[i + 1 : i + 1 + o.window]:
                    pairs[a, b] += 1
                    pairs[b, a] += 1
        count = Counter()
        for (a, _), n in pairs.items():
            count[a] += n
        names = sorted(count)
        counts = np.array([count[t] for t in names], float)
        v = {
            (side, t): old.get((side, t), (context.first_vector(t, o.dimension, o.seed, side), np.full(o.dimension, 1e-8)))
            for side in ("token", "context")
            for t in names
        }
        for step in range(o.next_steps if cut else o.first_steps):
            g = {k: np.zeros(o.dimension) for k in v}
            against = context.drawn(counts, o, step)
            terms = [(a, b, n, 1) for (a, b), n in pairs.items()]
            terms += [(a, names[j], count[a] * o.negative_weight / o.negatives, -1) for i, a in enumerate(names) for j in against[i]]
            for a, b, n, sign in terms:
                u, w = v["token", a][0], v["context", b][0]
                slope = sign * n * (1 - 1 / (1 + math.exp(-sign * float(u @ w))))
                g["token", a] += slope * w
                g["context", b] += slope * u
            for k, (x, squares) in v.items():
                d = g[k] / counts.mean()
                v[k] = (x + o.rate * d / np.sqrt(squares + d * d), squares + d * d)
        old = v
        merged = [t for t in model.tokens if t not in base and t not in hidden]
        losses = {}
        for t in merged:
            if t not in count:
                continue
            total = 0.0
            for (a, b), n in pairs.items():
                if a == t:
                    def fit(s):
                        return -math.log1p(math.exp(-float(v["token", s][0] @ v["context", b][0]))) if s in count else math.log(0.5)

                    parts = [s for p in parents[t] for s in spell(p)]
                    total += n * (fit(t) - sum(map(fit, parts)) / len(parts))
            losses[t] = total
        gone = surplus * (cut + 1) // o.cuts - surplus * cut // o.cuts
        hidden |= set(sorted(merged, key=lambda t: (t in losses, losses.get(t, 0.0), t))[:gone])
    return hidden, {t: losses.get(t, 0.0) for t in merged if t not in hidden}


def test_context_pruning_equals_loops(spark):
    texts = ["".join(w.split()) for w in corpus(5, 60)]
    df = spark.createDataFrame([*enumerate(texts), (98, None), (99, "")], "doc_id long, text string").repartition(3)
    model = bpe.learn_bpe(df, n_merges=24, preset="text")
    o = context.ContextOptions(dimension=4, cuts=3, first_steps=4, next_steps=2, negatives=5)
    pruned, losses = context.prune(model, df, model.vocab_size - 13, options=o)
    hidden, expected = plain_prune(model, texts, model.vocab_size - 13, o)
    assert pruned.hidden == hidden and len(hidden) == 13
    assert losses.keys() == expected.keys()
    assert all(math.isclose(losses[t], expected[t], rel_tol=1e-6, abs_tol=1e-6) for t in losses)
    for row in pruned.encode(df, out="t", as_tokens=True).collect():
        assert set(row["t"]) <= set(pruned.tokens)
        assert bytes.fromhex("".join(row["t"])).decode() == (row["text"] or "")


def test_changed_pairs_equal_counting_anew(spark):
    rng = random.Random(2)
    texts = [[rng.choice("abcdef") for _ in range(rng.randint(0, 12))] for _ in range(80)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "tokens array<string>").repartition(4)
    before, after = {"a": ["x", "y"]}, {"a": ["x", "y"], "b": ["x", "x"], "c": ["d"]}

    def counted(spelling):
        rows = [([s for x in t for s in spelling.get(x, [x])],) for t in texts if t is not None]
        pairs = context.context_pairs(spark.createDataFrame(rows, "tokens array<string>"), 2)
        return Counter({(r["token"], r["context"]): r["n"] for r in pairs.collect()})

    found = counted(before)
    found.update({(r["token"], r["context"]): r["n"] for r in context.changed_pairs(df, before, after, 2).collect()})
    assert +found == counted(after) and all(n >= 0 for n in found.values())


def test_coverage_falls_back_to_bytes(spark):
    df = spark.createDataFrame([("aaaa aaaa é",)], "text string")
    model = bpe.learn_bpe(df, n_merges=0, preset="words", unit="char", character_coverage=0.8)
    assert model.alphabet == ["61", "A9", "C3"]


def test_lzw_counts_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, "abcabcabd " * (i % 7 + 1) + "xyzxyz" * 200) for i in range(40)], "doc_id long, text string")
    one = {r["token"]: r["n"] for r in phrases.lzw_vocab(df.coalesce(1), 50).collect()}
    many = {r["token"]: r["n"] for r in phrases.lzw_vocab(df.repartition(9), 50).collect()}
    assert one == many and len(one) == 50


def test_long_texts_are_spread(spark):
    from lingua_spark.runtime import stage_spread

    df = spark.range(300).selectExpr("id", "array_join(transform(sequence(1, 4000), i -> hex(hash(id, i))), ' ') as text")
    assert stage_spread(df.coalesce(1)).rdd.getNumPartitions() > 1


def test_encoders_take_null_texts_and_models_come_back(spark, tmp_path):
    from lingua_spark.learn.model import read_tokenizer
    from lingua_spark.sources.sinks import write_tokenizer

    df = spark.createDataFrame([(1, "low lower lowest low"), (2, None), (3, ""), (None, "lower")], "doc_id long, text string")
    merges = fit(df, "bpe-dropout", 60, dropout_probability=1.0)
    pieces = fit(df, "unigram", 30)
    for i, model in enumerate((merges, pieces)):
        rows = {r["doc_id"]: list(r["input_ids"]) for r in model.encode(df).collect()}
        assert rows[2] == [] and rows[3] == [] and rows[1] and all(isinstance(x, int) for x in rows[1])
        write_tokenizer(model, f"{tmp_path}/{i}")
        back = read_tokenizer(spark, f"{tmp_path}/{i}")
        assert {r["doc_id"]: list(r["input_ids"]) for r in back.encode(df).collect()} == rows
        assert back.vocab_size == model.vocab_size
    # with probability one no merge is made, unless the caller wants none skipped
    tokens = merges.encode(df, as_tokens=True, out="t").first()["t"]
    assert all(len(t) == 2 for t in tokens)
    assert len(merges.encode(df, dropout=0.0).first()["input_ids"]) < len(tokens)


def test_sage_prunes_and_still_encodes(df, texts):
    model = fit(df, "sage", 60)
    assert model.vocab_size == 60 and model.hidden
    for row in model.encode(df, out="t", as_tokens=True).collect():
        assert set(row["t"]) <= set(model.tokens)
        assert bytes.fromhex("".join(row["t"])).decode().replace(" ", "") == texts[row["doc_id"]].replace(" ", "")


def test_symbols_side_by_side_equal_a_loop(spark):
    from lingua_spark.learn import flat
    from lingua_spark.learn.batching import segment_table, segments_of
    from lingua_spark.learn.wordtable import pair_counts, symbol_counts

    random.seed(5)
    words = [("<" + "><".join(random.choice(["A", "BB", "CCC", "D"]) for _ in range(random.randint(1, 9))) + ">") for _ in range(300)]
    rows = [(random.choice(["x", "y", None]), w, random.randint(1, 9)) for w in words]
    df = spark.createDataFrame(rows, "lang string, syms string, freq bigint").coalesce(2)
    keys = {("A", "BB"), ("BB", "BB"), ("CCC", "D"), ("E", "A")}
    for by in ((), ("lang",)):
        pairs, single, cut = {}, {}, {}
        for lang, word, n in rows:
            g, parts = ((lang,) if by else ()), word[1:-1].split("><")
            for s in parts:
                single[(*g, s)] = single.get((*g, s), 0) + n
            for p in zip(parts, parts[1:]):
                pairs[(*g, *p)] = pairs.get((*g, *p), 0) + n
            for s in segments_of(parts, keys):
                cut[(*g, s)] = cut.get((*g, s), 0) + n
        for found, wanted in ((pair_counts(df, by), pairs), (symbol_counts(df, by), single), (segment_table(df, keys, by), cut)):
            assert {tuple(r[:-1]): r[-1] for r in found.collect()} == wanted
    batch = pa.RecordBatch.from_pylist([{"syms": w, "freq": 1} for w in words])
    parts = list(flat.in_parts(batch, np.array([len(w) for w in words]), 200))
    assert len(parts) > 10 and sum(p.num_rows for p in parts) == len(words)


def test_texts_are_encoded_in_parts(spark, monkeypatch):
    """However many rows a batch has, few letters are Python objects at once."""
    from lingua_spark.learn import model as models

    texts = [None, "", "low lower " * 300, "x"] * 50
    column = pa.array([None if t is None else t.split() for t in texts]).slice(3)
    monkeypatch.setattr(models, "PART", 500)
    parts = list(models.row_parts(column))
    assert [at for at, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
    assert sum(n for _, n in parts) == len(column) and len(parts) >= 49
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    model = bpe.learn_bpe(frame, n_merges=4, preset="words")
    plain = {r["doc_id"]: r["tokens"] for r in model.encode(frame, out="tokens", as_tokens=True).collect()}
    again = {r["doc_id"]: r["tokens"] for r in model.encode_dropout(frame, 0.0).collect()}
    assert plain == again and plain[0] == [] and len(plain) == len(texts)
    assert "".join(plain[2]) == "low lower ".replace(" ", "").encode().hex().upper() * 300


def test_pairs_of_texts_side_by_side(spark):
    """Counts in parts of few tokens equal a loop, whatever the spelling."""
    random.seed(8)
    texts = [[random.choice(["a", "b", "ab", "c"]) for _ in range(random.randint(0, 9))] for _ in range(80)]
    column = pa.array([None, *texts])
    rows = list(context.rows_of(iter([pa.RecordBatch.from_arrays([column], names=["tokens"])])))
    spelling = {"ab": ["a", "b"]}
    for spell, row in (({}, rows[0]), (spelling, rows[0].spelled(spelling))):
        wanted = Counter()
        for text in texts:
            symbols = [s for t in text for s in spell.get(t, [t])]
            for k in (1, 2):
                wanted.update(zip(symbols, symbols[k:]))
        got = {(r["token"], r["context"]): r["n"] for r in row.pairs(2).to_pylist()}
        assert got == wanted
    held = rows[0].holding({"c"})
    assert len(held.ids) == sum(len(t) for t in texts if "c" in t)


def test_words_segmented_side_by_side():
    """The arrays of distinct words give what one word at a time gives."""
    import random

    import pyarrow as pa

    from lingua_spark.functions.segmentation import best_path
    from lingua_spark.learn import model as models
    from lingua_spark.learn.segmenting import copied_to_rows, path_segmenter

    draw = random.Random(3)
    for unit in ("byte", "char") * 10:
        word = lambda: "".join(draw.choice("ababcé日x") for _ in range(draw.choice([0, 1, 2, 3, 5, 9, 70])))
        rows = [None] + [[word() for _ in range(draw.randrange(9))] for _ in range(20)]
        column = pa.array(rows, pa.list_(pa.string()))
        symbols = sorted({s for w in ("ab", "cé", "日x") for s in models.initial_symbols(w, unit)})
        merges = {}
        for i in range(draw.choice([0, 1, 30])):
            pair = draw.choice(symbols), draw.choice(symbols)
            merges.setdefault(pair, i)
            symbols.append(pair[0] + pair[1])
        hidden = {a + b for a, b in merges if draw.random() < 0.3} - set(symbols[:6])
        events = [models.Event("+", *m) for m in merges]
        plan = models.MergeModel(None, symbols[:6], events, unit=unit, hidden=hidden)._plan()
        one, many = models.segmenter(plan), models.side_by_side(plan)
        for part in (column, column.slice(4, 9), column):
            want = [[t for w in words or [] for t in one(w)] for words in part.to_pylist()]
            assert copied_to_rows(part, many).to_pylist() == want
            assert copied_to_rows(part, many, len).to_pylist() == [[len(t) for t in tokens] for tokens in want]
        logp = {p: -draw.choice([1.0, 2.0, 4.5]) for p in ("a", "b", "ab", "ba", "aba", "c", "日", "b日")[: draw.randrange(9)]}
        for respell in (lambda c: [c], models.spelled):
            alone = lambda w: [t for p in best_path(w, logp, 3, -9.0) for t in ([p] if p in logp else respell(p))]  # noqa: B023, E731
            got = copied_to_rows(column, path_segmenter(logp, 3, -9.0, respell, alone)).to_pylist()
            assert got == [[t for w in words or [] for t in alone(w)] for words in rows]


def test_words_counted_once(spark, df, monkeypatch):
    """Trimming and parity with the same development texts count the words once."""
    calls = []
    for module in (bpe, wordtable):
        counted = module.word_counts
        monkeypatch.setattr(module, "word_counts", lambda *a, counted=counted, **k: calls.append(1) or counted(*a, **k))
    trimmed = bpe.learn_trimmed_bpe(df, n_merges=12, min_count=30, preset="words")
    assert len(calls) == 1
    model = bpe.learn_bpe(df, n_merges=12, preset="words")
    assert trimmed.events == model.events and trimmed.hidden == bpe.trim_bpe(model, df, 30).hidden
    calls.clear()
    texts = df.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b"))
    shared = parity.learn_parity_bpe(texts, 8, dev=texts, unit="byte")
    assert len(calls) == 1
    apart = parity.learn_parity_bpe(texts, 8, dev=texts.select("*"), unit="byte")
    assert shared.events == apart.events


def test_merges_on_codes_equal_replacing_text():
    """Each merge once, in order, from the left; longer lists by rank; no pair over a word's border."""
    from lingua_spark.functions.segmentation import merge_symbols
    from lingua_spark.learn.coded import BYTES, Replay

    random.seed(11)
    for round_ in range(60):
        words = ["".join(random.choice("aab") for _ in range(random.randint(1, 30))) for _ in range(20)]
        known, merges = ["61", "62"], []
        for _ in range(random.choice([1, 5, 16, 25])):
            pair = random.choice(known), random.choice(known)
            if len("".join(pair)) < 20 and (round_ % 2 or ("".join(pair) not in known and pair not in merges)):
                merges.append(pair)
                known.append("".join(pair))
        replay = Replay(BYTES)
        replay.add(merges)
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        ids, sizes = replay(raw, np.array([len(w) for w in words]))
        names, at = list(replay.number), 0
        for word, size in zip(words, sizes):
            got, at = [names[i] for i in ids[at : at + size]], at + size
            parts = [f"{b:02X}" for b in word.encode()]
            if len(merges) > 16:
                wanted = merge_symbols(parts, {m: i for i, m in enumerate(merges)})
            else:
                text = f"<{'><'.join(parts)}>"
                for left, right in merges:
                    text = text.replace(f"<{left}><{right}>", f"<{left}{right}>")
                wanted = text[1:-1].split("><")
            assert got == wanted, (merges, word)
        assert at == len(ids)


def test_codes_count_and_cut_as_symbols_do(spark):
    from lingua_spark.learn.batching import segment_table
    from lingua_spark.learn.coded import coded, segment_text
    from lingua_spark.learn.wordtable import counted_words, pair_counts, symbol_counts

    random.seed(3)
    rows = [(random.choice(["x", "y", None]), " ".join(random.choice(["über", "low", "aaaa", "é"]) for _ in range(9))) for _ in range(40)]
    rows += [("x", None), (None, ""), ("y", "a")]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    merges = [("6C", "6F"), ("61", "61"), ("20", "6C6F")]
    keys = {("6C6F", "77"), ("6161", "6161"), ("C3", "A9"), ("20", "C3")}
    for by, preset in (((), "text"), (("lang",), "text"), (("lang",), "words")):
        plain = segment_all(symbol_table(df, preset=preset, by=by), merges)
        codes = coded(counted_words(df, preset=preset, by=by), merges)
        for count in (pair_counts, symbol_counts):
            assert sorted(map(str, count(codes, by).collect())) == sorted(map(str, count(plain, by).collect()))
        cut = [(*r[:-2], segment_text(r["segment"], codes.names), r["freq"]) for r in segment_table(codes, keys, by).collect()]
        assert sorted(map(str, cut)) == sorted(map(str, map(tuple, segment_table(plain, keys, by).collect())))


def test_phase_two_reads_few_bytes_and_makes_clear_merges(spark, texts, monkeypatch):
    """Whole texts were kept as strings of four letters a byte, and their segments fetched."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, plain = [], bpe.leading_pairs
    monkeypatch.setattr(bpe, "leading_pairs", lambda words, *a: seen.append(dict(words.frame.dtypes)["syms"]) or plain(words, *a))
    model = bpe.learn_super_bpe(df, n_merges=24, phase1_merges=4, preset="words", preset_phase2="text")
    assert set(seen) == {"binary"} and len(seen) < 20
    words = [[f"{b:02X}" for b in t.encode()] for t in texts]
    for i, event in enumerate(model.events):
        counts = Counter(p for w in words for p in zip(w, w[1:]))
        if i >= 4:
            pair = min(counts, key=lambda p: (-counts[p], p))
            assert (event.left, event.right, event.n) == (*pair, counts[pair])
        words = [rewrite(w, [event.left, event.right], [event.left + event.right]) for w in words]


def test_clear_leads_stop_at_ties_and_touching_pairs():
    from lingua_spark.learn.batching import Candidate, clear_leads

    a, b, c, d = Candidate("a", "b", 9), Candidate("c", "d", 7), Candidate("b", "x", 5), Candidate("e", "f", 5)
    assert clear_leads([a, b, d], True) == [a, b, d] and clear_leads([], True) == []
    assert clear_leads([a, b, d], False) == [a, b]
    assert clear_leads([a, b, c, d], True) == [a, b] == clear_leads([a, b, d, c], True)
    assert clear_leads([Candidate("a", "a", 9), b], True) == [Candidate("a", "a", 9)]  # (aa, a) may be before b
