"""BPE encoding and decoding by dynamic programming over prefixes.

Byte-pair encoding has a useful property: if ``t1 .. tn`` encodes a string,
``t1 .. tk`` encodes the prefix it spells. So every prefix has one last token,
and a token ``t`` that ends a prefix is that last token exactly if the prefix
before it ends with a token ``s`` such that the pair ``(s, t)`` survives
encoding, which the merge table alone decides. Encoding a word is then one pass:

1. an automaton over all tokens reports, at each position, the tokens that are
   a suffix of the prefix ending there;
2. the pair test picks the one compatible with the prefix before it;
3. back-pointers from the last position spell the ids.

No merge is ever simulated, and long words cost time in proportion to their
length. Texts are encoded map-only; the vocabulary file is small and fixed, and
every Python worker reads its own copy from the installed package.

Defined cases: a null text counts as empty and gives no ids; very long texts
and words take time in proportion to their length; no tie is possible, as each
prefix has one last token; each row stands for itself, so repeated rows give
equal results and empty tables none; ``encode`` and ``decode`` keep all columns
and replace one of the name asked for; ids below 2^32 are told apart.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import normalizers

from lingua_spark.llm.common import frugal

END = "</w>"
#: Entries of the per-worker memories.
WORDS_KEPT, PAIRS_KEPT = 300_000, 1_000_000
#: Words of a text that are spelled out at once.
RUN = 65_536


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the rest follow from
    code point 256 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in own}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(own)))
    return [letters[b] for b in range(256)]


class Memory(dict):
    """Results by key, made when first asked for and forgotten when full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        if not isinstance(key, str) or len(key) <= 64:
            self[key] = value
        return value


class PrefixEncoder:
    """Encoder of one vocabulary file with word ends and byte letters.

    Inside, a word is a string of symbols: the code point of each byte, plus 256
    for the last byte, which carries the word end.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["end_of_word_suffix"] != END or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError("a vocabulary with word ends and without a decoder is asked for")
        self.pattern = regex.compile(split[0]["pattern"]["Regex"], regex.V0)
        self.fold = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}

        def symbols(token: str) -> str:
            body = token.removesuffix(END)
            codes = [byte_of[c] for c in body]
            if token != body:
                codes[-1] += 256
            return "".join(map(chr, codes))

        vocabulary = model["vocab"]
        self.text = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        #: (left, right) -> rank, and merged -> (rank, left, right)
        self.merge, self.parts = {}, {}
        for rank, (left, right) in enumerate(model["merges"]):
            pair = vocabulary[left], vocabulary[right]
            merged = vocabulary[left + right]
            if any(p in self.parts and self.parts[p][0] > rank for p in pair) or merged in self.parts:
                raise ValueError("merges must make each token once, after its parts")
            self.merge[pair] = rank
            self.parts[merged] = (rank, *pair)
        self.pairs = Memory(lambda key: self.survives(key >> 32, key & 0xFFFFFFFF), PAIRS_KEPT)
        self.ids_of, self.tokens_of = Memory(self.word_ids, WORDS_KEPT), Memory(self.word_tokens, WORDS_KEPT)
        self.spine = lru_cache(maxsize=None)(self._spine)  # two per token at most
        # A token that its own string does not encode to is never the last one.
        self.automaton = ahocorasick.Automaton()
        for token, i in vocabulary.items():
            if i not in self.special.values() and self.stands(i):
                self.automaton.add_word(symbols(token), (i, len(symbols(token))))
        self.automaton.make_automaton()

    def stands(self, token: int) -> bool:
        """Whether nothing breaks the merges that make the token."""
        made = self.parts.get(token)
        return made is None or (
            self.stands(made[1]) and self.stands(made[2]) and self.survives(made[1], made[2], made[0])
        )

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces at the token's right (2) or left (1) edge, from the token
        down to a single byte, each with the rank of the merge that ends it."""
        steps, ends = [], float("inf")
        while True:
            steps.append((token, ends))
            made = self.parts.get(token)
            if made is None:
                return steps
            token, ends = made[side], made[0]

    def survives(self, left: int, right: int, until: float = float("inf")) -> bool:
        """Whether no merge before rank ``until`` joins pieces across the seam.

        Merges happen in rank order. Two pieces face each other at the seam for
        as long as neither has been taken into a larger piece of its own side. A
        merge of the two in that time would cross the seam. Of equal ranks the
        leftmost goes first: the left piece's own merge comes before the seam's,
        the right piece's after it.
        """
        lefts, rights = self.spine(left, 2), self.spine(right, 1)
        a = b = 0
        while True:
            (x, x_ends), (y, y_ends) = lefts[a], rights[b]
            rank = self.merge.get((x, y))
            if rank is not None and rank < until and rank < x_ends and rank <= y_ends:
                return False
            # step back to the time before the younger of the two was made
            x_born = self.parts[x][0] if x in self.parts else -1
            y_born = self.parts[y][0] if y in self.parts else -1
            if x_born < 0 and y_born < 0:
                return True
            if x_born > y_born:
                a += 1
            else:  # of two made by the same merge the left one came first
                b += 1

    def encode_symbols(self, word: str) -> list[int]:
        last, start, pairs = [-1] * len(word), [0] * len(word), self.pairs
        for end, (token, length) in self.automaton.iter(word):
            if last[end] < 0:
                before = end - length
                if before < 0 or pairs[last[before] << 32 | token]:
                    last[end], start[end] = token, before
        ids, at = [], len(word) - 1
        while at >= 0:
            ids.append(last[at])
            at = start[at]
        return ids[::-1]

    def word_ids(self, word: str) -> str:
        """The ids of a word, joined by spaces."""
        raw = word.encode("utf-8")
        return " ".join(map(str, self.encode_symbols(raw[:-1].decode("latin-1") + chr(raw[-1] + 256))))

    def word_tokens(self, word: str) -> str:
        """The tokens of a word, joined by spaces."""
        return " ".join([self.text[int(i)] for i in self.ids_of[word].split(" ")])

    def runs(self, text: str) -> Iterator[tuple[str, str]]:
        """Ids and tokens of stretches of a text, each joined by spaces; special
        tokens are taken where the text spells them."""
        for part in self.cut.split(text) if "<|" in text else [text]:
            if part in self.special:
                yield str(self.special[part]), part
                continue
            part = part.lower() if part.isascii() else self.fold.normalize_str(part)
            words = self.pattern.findall(part)
            for at in range(0, len(words), RUN):
                run = words[at : at + RUN]
                yield " ".join(map(self.ids_of.__getitem__, run)), " ".join(map(self.tokens_of.__getitem__, run))

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _ in self.runs(text or "") for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, which is what a file without decoder means."""
        return " ".join(self.text[i] for i in ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "input_ids") -> DataFrame:
    """``docs`` with the ids of ``text``, as ``array<int>``."""
    frugal(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoder(_path(path))
        for texts in batches:
            yield pd.Series([coder.encode(t) for t in texts], dtype=object)

    return docs.withColumn(out, ids(docs[text]))


def decode(docs: DataFrame, path: str | None = None, ids: str = "input_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text that ``ids`` decode to; null ids count as none."""
    frugal(docs.sparkSession)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoder(_path(path))
        for rows in batches:
            yield pd.Series([coder.decode([] if r is None else list(r)) for r in rows], dtype=object)

    return docs.withColumn(out, texts(docs[ids]))


DIGEST = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digest(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id`` with the count and digests of ids and decoded text, and the
    ids themselves if asked for.

    Ids and tokens are spelled run by run, so that neither list ever exists for
    a whole text of millions of words unless the ids are asked for.
    """
    frugal(docs.sparkSession)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["input_ids"] * with_ids

    @F.pandas_udf(DIGEST + ", input_ids array<int>" * with_ids)
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = encoder(_path(path))
        for rows in batches:
            yield pd.DataFrame([_digest(coder, t, with_ids) for t in rows], columns=names)

    return docs.select("doc_id", digests(docs["text"]).alias("digest")).select("doc_id", "digest.*")


def _digest(coder: PrefixEncoder, text: str | None, with_ids: bool) -> tuple:
    count, all_ids, all_tokens, kept = 0, hashlib.sha256(), hashlib.sha256(), []
    for ids, tokens in coder.runs(text or ""):
        gap = " " if count else ""
        count += ids.count(" ") + 1
        all_ids.update((gap + ids).encode())
        all_tokens.update((gap + tokens).encode("utf-8"))
        if with_ids:
            kept.append(np.array(ids.split(" "), np.int32))
    row = count, all_ids.hexdigest(), all_tokens.hexdigest()
    return (*row, np.concatenate(kept) if kept else np.empty(0, np.int32)) if with_ids else row
