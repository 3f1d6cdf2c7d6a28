import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lingua_spark.llm.bpe_prefix import PrefixEncoder, decode, digest, encode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def own():
    return PrefixEncoder(PATH)


PIECES = (
    ["a", "b", "é", "É", "İ", "Σ", "ß", "日本", "ไทย", "123", "'s", "'LL", " ", "\t", "\n", "\x1c", "\x85", "\x00"]
    + ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "</w>", "_", "-", "é", "\U0001f600", "¼", "the", "ing"]
)


@pytest.mark.parametrize("seed", range(8))
def test_ids_and_text_equal_the_library(library, own, seed):
    draw = random.Random(seed)
    texts = ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 30))) for _ in range(300)]
    texts += ["".join(draw.choice("abeinrst") for _ in range(draw.randint(0, 40))) for _ in range(300)]
    texts += ["".join(draw.choice("an") for _ in range(draw.randint(0, 40))) for _ in range(100)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_ids_above_16_bits(library, own, tmp_path):
    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    places = {t: i * 65_537 + 5 for t, i in spec["model"]["vocab"].items()}
    wide = {i: places[t] for t, i in spec["model"]["vocab"].items()}
    spec["model"]["vocab"] = places
    for token in spec["added_tokens"]:
        token["id"] = places.get(token["content"], token["id"])
    path = tmp_path / "wide.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    spread, draw = PrefixEncoder(str(path)), random.Random(1)
    for _ in range(200):
        text = "".join(draw.choice("abeinrst ") for _ in range(draw.randint(0, 60)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert spread.encode(text) == [wide[i] for i in ids]


def test_frames(odd, none, library):
    expected = {}
    for row in odd.collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected[row["doc_id"]] = (
            len(ids),
            hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(),
        )
    rows = digest(odd).collect()
    assert len(rows) == 10 and all(tuple(r[1:]) == expected[r["doc_id"]] for r in rows)
    assert digest(none).count() == 0
    back = decode(encode(odd.select("doc_id", "text")), out="decoded").collect()
    for row in back:
        assert row["decoded"] == library.decode(row["input_ids"], skip_special_tokens=False)
