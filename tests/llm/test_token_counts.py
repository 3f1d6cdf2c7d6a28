import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lingua_spark.llm.token_counts import Counting, PreTokens, count_tokens, frequent, vocabulary

FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a\x1cb \x85c ᠎d​e 　f g",
    "J̌X İstanbul ΣΣ okΣ",
    "x<|endoftext|>y <|startoftext|><|endoftext|> <|endo",
    "it's they'd 'ss ''t don't''ll 12345 ١٢ a_b--c",
    "é é " * 5,
    "à́ ̈́ 각 ﬁ \U0001d400",
    "=" * 3000,
    "nospace" * 500,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def expected(library, rows, limit):
    out = []
    for r in rows:
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        out.append((r["doc_id"], len((r["text"] or "").encode()), n, n > limit))
    return sorted(out, key=str)


@pytest.mark.parametrize("counting", [Counting(), Counting(known=0), Counting(known=3, stretch=7, held=5, limit=10)])
def test_equals_the_library(spark, odd, library, counting):
    docs = odd.select("doc_id", "text", "key", "n_tokens").unionByName(
        spark.createDataFrame([(100 + i, t, "k", 0) for i, t in enumerate(ODD)], "doc_id bigint, text string, key string, n_tokens int")
    )
    got = count_tokens(docs, counting=counting)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(library, docs.collect(), counting.limit)


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(map(tuple, count_tokens(docs).collect()), key=str)
    assert got == expected(library, docs.collect(), 2048)


def test_each_pre_token_once(spark, library):
    docs = spark.createDataFrame([(1, "red green red"), (2, "green blue"), (3, None)], "id int, body string")
    words = {r["word"]: (r["n"], r["pieces"]) for r in vocabulary(docs, text="body").collect()}
    assert words == {w: (n, len(library.encode(w, add_special_tokens=False).ids)) for w, n in (("red", 2), ("green", 2), ("blue", 1))}


def test_what_is_sent_is_bounded(spark):
    words = spark.range(1000).selectExpr("concat('w', id) as word", "id % 40 + 1 as n", "id as pieces")
    for known in (0, 10, 25, 100, 999, 1000):
        sent = frequent(words, Counting(known=known))
        assert sent.count() <= known
    assert frequent(words, Counting(known=1000)).count() == 1000
    long = words.selectExpr("repeat('x', 129) as word", "n", "pieces")
    assert frequent(long, Counting()).count() == 0


def test_empty_and_one_hot_row(spark, none, library):
    assert count_tokens(none).count() == 0
    same = spark.range(500).selectExpr("cast(7 as bigint) as doc_id", "'one and the same text' as text")
    assert {tuple(r) for r in count_tokens(same).collect()} == set(expected(library, [{"doc_id": 7, "text": "one and the same text"}], 2048))
    assert count_tokens(same).count() == 500


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        PreTokens(public_tokenizers.path("byte_bpe_50k.json"), 1 << 20)
