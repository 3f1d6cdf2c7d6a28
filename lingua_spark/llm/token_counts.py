"""Token counts of documents from the pieces of distinct pre-tokens.

A tokenizer splits a text into pre-tokens and each pre-token, on its own, into
pieces. So a document has as many tokens as its pre-tokens have pieces, and no
id of any document is needed:

1. the pre-tokens of the corpus with their frequencies, counted in every task
   and then by one shuffle of distinct pre-tokens;
2. the pieces of each distinct pre-token, counted once by the model;
3. per document, the sum over its pre-tokens of frequency times pieces.

Step 3 is a join on the pre-token. Most occurrences belong to few pre-tokens,
which would also be its hot keys. So at most ``Counting.known`` of the most
frequent ones, each of at most ``Counting.known_chars`` characters, go to the
tasks that cut the texts and are summed there; the size of what is sent is
thereby bounded, whatever the corpus. All other pre-tokens leave with their
frequency in the document and are joined by a shuffle.

Inside a task, chunks between spaces are cut once per distinct chunk. Texts are
cut in stretches of ``Counting.stretch`` characters that end at white
space, so a text of millions of words never becomes one list of pre-tokens.

Defined cases: a null text counts as empty, with no bytes and no tokens; rows
are counted each on their own, equal keys or equal rows too; the special tokens
of the file are one token each where a text spells them; an empty table gives
no rows; columns besides the key and the text are not read.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers

from lingua_spark.llm.common import frugal, stage


@dataclass(frozen=True)
class Counting:
    """``limit``: tokens beyond which a document is over the limit. ``known``
    and ``known_chars``: how many pre-tokens, of which length at most, are sent
    to the tasks. ``stretch``: characters of a text that are cut at once.
    ``held``: distinct chunks of texts that a task remembers, and
    ``held_chars``: of how many characters at most."""

    limit: int = 2048
    known: int = 100_000
    known_chars: int = 128
    stretch: int = 1 << 20
    held: int = 300_000
    held_chars: int = 1 << 26


class PreTokens:
    """Pre-tokens of texts and pieces of pre-tokens, by one tokenizer file.

    Pre-tokens are kept as folded text; the model sees them in byte letters.
    """

    def __init__(self, path: str, stretch: int):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = steps[0] if steps else {}
        plain = all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
        if (
            kinds != ["NFC", "Replace", "Lowercase"]
            or [s["type"] for s in steps] != ["Split", "ByteLevel"]
            or (split["behavior"], split["invert"], steps[1]["use_regex"], steps[1]["add_prefix_space"]) != ("Removed", True, False, False)
            or not plain
        ):
            raise ValueError("a vocabulary of lower-cased words cut by one pattern is asked for")
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = self.tokenizer.pre_tokenizer[1]
        self.fold = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.pattern = regex.compile(split["pattern"]["Regex"], regex.V0)
        self.special = {t["content"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.space = regex.compile(r"\s")
        self.stretch = stretch

    def stretches(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > self.stretch:
            gap = self.space.search(text, at + self.stretch)
            if gap is None:
                break
            yield text[at : gap.start()]
            at = gap.start()
        yield text[at:] if at else text

    def chunks(self, text: str | None) -> Iterator[tuple[Counter, int]]:
        """Chunks between spaces with their frequencies, and special tokens, by
        stretch. No pre-token holds a space, and folding does not look across
        one, so a text has the pre-tokens of its chunks."""
        parts = self.cut.split(text) if text and self.cut else [text or ""]
        for part in parts:
            if part in self.special:
                yield Counter(), 1
                continue
            for some in self.stretches(part):
                yield Counter(some.split(" ")), 0

    def cut_chunk(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk."""
        return self.pattern.findall(chunk.lower() if chunk.isascii() else self.fold.normalize_str(chunk))

    def pieces(self, word: str) -> int:
        return sum(len(self.tokenizer.model.tokenize(part)) for part, _ in self.letters.pre_tokenize_str(word))


@lru_cache(maxsize=2)
def pre_tokens(path: str | None, stretch: int) -> PreTokens:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return PreTokens(path, stretch)


def vocabulary(docs: DataFrame, path: str | None = None, counting: Counting = Counting(), text: str = "text") -> DataFrame:
    """Every distinct pre-token of the texts: ``word``, ``n`` (its occurrences)
    and ``pieces``, counted once each."""
    frugal(docs.sparkSession)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held = pre_tokens(path, counting.stretch), Counter()

        def leave() -> pa.RecordBatch:
            found: dict[str, int] = {}
            for chunk, times in held.items():
                for word in cutter.cut_chunk(chunk):
                    found[word] = found.get(word, 0) + times
            held.clear()
            batch = pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.string(), size=len(found)), pa.array(found.values(), pa.int64(), size=len(found))],
                names=["word", "n"],
            )
            return batch

        letters = 0
        for batch in batches:
            for value in batch.column(0):
                for chunks, _ in cutter.chunks(value.as_py()):
                    held.update(chunks)
                    letters += sum(map(len, chunks))
                    if len(held) >= counting.held or letters >= counting.held_chars:
                        letters = 0
                        yield leave()
        yield leave()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = pre_tokens(path, counting.stretch)
        for batch in batches:
            pieces = [cutter.pieces(word) for word in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], names=["word", "n", "pieces"])

    words = docs.select(F.col(text).alias("text")).mapInArrow(occurrences, "word string, n bigint")
    words = words.groupBy("word").agg(F.sum("n").alias("n"))
    return stage(words.mapInArrow(count, "word string, n bigint, pieces bigint"), "pre_tokens")


def frequent(words: DataFrame, counting: Counting) -> DataFrame:
    """At most ``known`` pre-tokens: those from the least frequency on that
    leaves no more. The histogram has a row per step of frequency, about four
    for each doubling, so that neither a sort nor a large result is needed."""
    step = F.floor(F.log2("n") * 4).cast("int")
    short = words.filter(F.length("word") <= counting.known_chars)
    total, least = 0, None
    for row in short.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        total += row["words"]
        if total > counting.known:
            break
        least = row["step"]
    return short.filter(F.lit(False) if least is None else step >= least).select("word", "pieces")


def count_tokens(
    docs: DataFrame, path: str | None = None, counting: Counting = Counting(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key`` of each row with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    words = vocabulary(docs, path, counting, text)
    sent = docs.sparkSession.sparkContext.broadcast({r["word"]: r["pieces"] for r in frequent(words, counting).collect()})

    def known_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, known = pre_tokens(path, counting.stretch), sent.value

        def divide(chunk: str) -> tuple[int, list[str]]:
            words = cutter.cut_chunk(chunk)
            return sum(map(known.get, words, repeat(0))), [w for w in words if w not in known]

        seen: dict[str, tuple[int, list[str]]] = {}
        for batch in batches:
            sums, rare, times = [], [], []
            for value in batch.column("text"):
                total, rest = 0, {}
                for chunks, special in cutter.chunks(value.as_py()):
                    total += special
                    for chunk, often in chunks.items():
                        if (parts := seen.get(chunk)) is None:
                            if len(seen) >= counting.held:
                                seen.clear()
                            parts = divide(chunk)
                            if len(chunk) <= counting.known_chars:
                                seen[chunk] = parts
                        total += parts[0] * often
                        for word in parts[1]:
                            rest[word] = rest.get(word, 0) + often
                sums.append(total)
                rare.append(list(rest.keys()))
                times.append(list(rest.values()))
            columns = [pa.array(sums, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, *columns], names=["key", "n_bytes", "known", "rare", "times"])

    kind = dict(docs.dtypes)[key]
    cut = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.col(text).alias("text"),
    ).mapInArrow(known_sums, f"key {kind}, n_bytes bigint, known bigint, rare array<string>, times array<bigint>")
    rows = stage(cut.withColumn("row", F.monotonically_increasing_id()), "token_sums")
    # rows are numbered once, in the staged table; what is shuffled are rare pre-tokens
    rest = rows.select("row", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("times"))))
    summed = rest.join(words.select("word", "pieces"), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    return (
        rows.select("row", "key", "n_bytes", "known")
        .join(summed, "row", "left")
        .withColumn("n_tokens", F.col("known") + F.coalesce("more", F.lit(0)))
        .select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > counting.limit).alias("over_limit"))
    )


__all__ = ["Counting", "count_tokens", "frequent", "vocabulary"]
