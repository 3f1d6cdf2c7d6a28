import hashlib
import re

import public_tokenizers
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from lingua_spark.llm.chosen_path import shingles
from lingua_spark.llm.decontaminate import Matching, Pattern, budget, plain
from lingua_spark.llm.quality_rules import Bands, judge

FOLDER = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def valid(kind, hit):
    number = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        return 13 <= len(number) <= 19 and luhn(number)
    return kind == "email" or 9 <= len(number) <= 15


def redacted(text):
    spans = sorted(
        (m.start(), m.end(), kind) for kind, p in PATTERNS.items() for m in re.finditer(p, text) if valid(kind, m.group())
    )
    out, done = "", 0
    for start, end, kind in spans:
        if start >= done:
            out += text[done:start] + f"[{kind.upper()}]"
        done = max(done, end)
    return out + text[done:]


def slow(rows, items):
    rows = [r for r in rows if judge(r["text"], Bands(), zstandard.ZstdCompressor(level=3))[-1]]
    sets, root = [set(shingles(r["text"]).tolist()) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    first = {}
    for i, row in sorted(enumerate(rows), key=lambda x: x[1]["doc_id"]):
        first.setdefault(root[i], row)
    options, kept = Matching(), []
    for row in first.values():
        text = plain(row["text"])
        if not any(p.best(text, most) for p, most in items):
            kept.append((row["doc_id"], redacted(row["text"])))
    return options, kept


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    bench = [plain(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    items = [(Pattern(t), budget(t, Matching())) for t in bench if len(t) >= Matching().least_letters]
    _, kept = slow(docs, items)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert sorted(got) == sorted(i for i, _ in kept)
    for doc_id, text in kept:
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(got[doc_id]["input_ids"]) == ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_rows_and_empty_tables(spark, odd, none):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names[0] == "quality_rules" and len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    for docs in (odd, none):
        for name, apply in corpus_pipeline.STAGES[:-1]:
            out = apply(spark, docs, FOLDER)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()
