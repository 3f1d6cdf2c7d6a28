import json

import pytest
from pyspark.sql import functions as F

from lingua_spark.learn import bpe
from lingua_spark.learn.api import fit
from lingua_spark.runtime import checkpoint_root, scratch_path, stage
from lingua_spark.sources import scans, sinks
from lingua_spark.streaming import ingest


def test_jsonl_defaults(spark, tmp_path):
    lines = [{"text": "a", "language": "en"}, {"text": "", "language": "en"}, {"text": "b"}, {"language": "fr"}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = {tuple(r) for r in scans.scan_jsonl(spark, str(tmp_path)).collect()}
    assert got == {("a", "en"), ("b", "misc")}
    other = scans.scan_jsonl(spark, str(tmp_path), lang_default="unknown").filter("text = 'b'").first()
    assert other["language"] == "unknown"


def test_text_tree_layouts(spark, tmp_path):
    for lang, body in (("en", "one\n\ntwo\n"), ("fr", "un")):
        (tmp_path / lang).mkdir()
        (tmp_path / lang / "train.txt").write_text(body)
    (tmp_path / "de").mkdir()
    (tmp_path / "de" / "val.txt").write_text("drei")
    got = {tuple(r) for r in scans.scan_text_tree(spark, str(tmp_path), "train").collect()}
    assert got == {("one", "en"), ("two", "en"), ("un", "fr")}


def test_text_sink_newlines(spark):
    df = spark.createDataFrame([("en", "train", "a\nb\n"), ("en", "val", "c")], "lang string, split string, text string")
    plain, escaped = scratch_path(spark, "t"), scratch_path(spark, "t")
    sinks.write_text(df, plain)
    sinks.write_text(df, escaped, escape=True)
    assert {tuple(r) for r in scans.scan_text_tree(spark, plain, "train").collect()} == {("a", "en"), ("b", "en")}
    assert [r["text"] for r in scans.scan_text_tree(spark, escaped, "train").collect()] == ["a\\nb\\n"]


def test_files_direct_or_recursive(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "sub").mkdir()
    pq.write_table(pa.table({"text": ["x", "y"]}), tmp_path / "sub" / "aai_Latn.parquet")
    got = [(r["text"], r["language"], r["row_index"]) for r in scans.scan_parquet_files(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("x", "aai_Latn", 0), ("y", "aai_Latn", 1)]
    pq.write_table(pa.table({"text": ["z"]}), tmp_path / "fra_Latn.parquet")
    assert [r["language"] for r in scans.scan_parquet_files(spark, str(tmp_path)).collect()] == ["fra_Latn"]


def test_folders_with_other_schemas_and_junk(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "text string, n int").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([("b",), (None,)], "content string").write.parquet(f"{tmp_path}/b/deep")
    (tmp_path / "empty").mkdir()
    (tmp_path / "note.txt").write_text("x")
    rows = scans.scan_parquet_folders(spark, str(tmp_path)).collect()
    assert {(r["text"], r["source"], r["source_idx"]) for r in rows} == {("a", "a", 0), ("b", "b", 1), ("", "b", 1)}
    with pytest.raises(ValueError, match="no Parquet folders"):
        scans.scan_parquet_folders(spark, str(tmp_path / "empty"))


def test_results_are_a_union_of_keys(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "r.json").write_text(json.dumps({"model_size": "1B", "bits_per_byte": 0.5}, indent=2))
    (tmp_path / "s.json").write_text(json.dumps({"model_size": "3B", "seed": 4}, indent=2))
    got = {(r["model_size"], r["bits_per_byte"], r["seed"]) for r in scans.load_results(spark, str(tmp_path)).collect()}
    assert got == {("1B", 0.5, None), ("3B", None, 4)}


def test_manifest_of_an_empty_language(spark):
    splits = spark.createDataFrame([("a", "train", 5), ("a", "val", 2)], "lang string, split string, bytes long")
    targets = spark.createDataFrame([("a", 10), ("b", 3)], "lang string, target_bytes long")
    table = sinks.manifest(splits, targets, floor=1)
    rows = {r["lang"]: r for r in table.collect()}
    assert (rows["a"]["bytes_written"], rows["a"]["under_floor"]) == (7, False)
    assert (rows["b"]["train_lines"], rows["b"]["under_floor"]) == (0, True)
    nested = {r["language"]: r["lines"] for r in sinks.manifest_struct(table, "x").collect()}
    assert nested["a"] == {"train": 1, "val": 1, "test": 0}


def test_tokenizer_tables_round_trip(spark):
    df = spark.createDataFrame([("low lower lowest",)], "text string")
    model = bpe.learn_bpe(df, n_merges=3, preset="words")
    path = scratch_path(spark, "tok")
    sinks.write_tokenizer(model, path)
    merges = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
    assert [(r["left"], r["right"]) for r in merges] == model.merges
    assert spark.read.parquet(f"{path}/vocab").count() == model.vocab_size
    model.merges_table().orderBy("rank").select(F.concat_ws(" ", "left", "right")).coalesce(1).write.text(f"{path}/txt")
    back = scans.load_merges(spark, f"{path}/txt", first=2).orderBy("rank").collect()
    assert [(r["left"], r["right"]) for r in back] == model.merges[:2]


def test_fit_by_name_and_with_own_trainer(spark):
    df = spark.createDataFrame([("low lower lowest low",)], "text string")
    assert {r["token"] for r in fit(df, "ngram", 0).collect()} == {"low", "owe", "wer", "wes", "est"}
    assert fit(df, "classic-bpe", 14, preset="words").vocab_size == 14
    assert fit(df, lambda frame, size, **kw: (frame.count(), size, kw), 7, a=1) == (1, 7, {"a": 1})
    with pytest.raises(ValueError, match="unknown algorithm"):
        fit(df, "bpe-knockout", 10)


def test_staging_uses_the_named_folder(spark):
    df = stage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10
    assert all(checkpoint_root(spark) in f for f in df.inputFiles())


def test_restart_gives_no_duplicates(spark):
    source, sink, log = (scratch_path(spark, n) for n in ("in", "out", "log"))
    schema = "doc_id long, text string"

    def run():
        rows = ingest.read_folder(spark, source, schema, max_files_per_trigger=1)
        tokens = F.split("text", " ")
        ingest.write_stream(ingest.chunk_stream(rows, tokens, ("doc_id",), 2), sink, log).awaitTermination()
        return sorted((r["doc_id"], r["chunk_no"]) for r in spark.read.parquet(sink).collect())

    spark.createDataFrame([(1, "a b c d e")], schema).write.mode("append").parquet(source)
    assert run() == [(1, 0), (1, 1)]
    assert run() == [(1, 0), (1, 1)]
    spark.createDataFrame([(2, "a b"), (3, "a")], schema).write.mode("append").parquet(source)
    assert run() == [(1, 0), (1, 1), (2, 0)]


def test_encoded_stream_of_several_folders(spark, tmp_path):
    texts = spark.createDataFrame([("low lower lowest low lower",)] * 5, "text string")
    model = bpe.learn_bpe(texts, n_merges=6, preset="words")
    schema, sink, log = "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "log")
    folders = {name: str(tmp_path / name) for name in ("a", "b")}

    def add(name, *rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folders[name])

    def run():
        rows = ingest.read_folders(spark, folders, schema, 1)
        chunks = ingest.encoded_stream(rows, model, ("source", "doc_id"), 2)
        ingest.write_stream(chunks, sink, log).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(sink).select("source", "doc_id", "chunk_no", "input_ids").collect())

    def batch(*rows):
        ids = {r["doc_id"]: r["input_ids"] for r in model.encode(spark.createDataFrame([r[1:] for r in rows], schema)).collect()}
        return sorted((s, i, k, ids[i][2 * k : 2 * k + 2]) for s, i, _ in rows for k in range(len(ids[i]) // 2))

    first = [("a", 1, "lowest newer"), ("a", 2, None), ("b", 3, "low lowly")]
    for name, *row in first:
        add(name, tuple(row))
    assert run() == batch(*first)
    assert run() == batch(*first)
    add("b", (4, "lower wow"))
    assert run() == batch(*first, ("b", 4, "lower wow"))


def test_counts_are_read_in_whole_versions(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    with pytest.raises(FileNotFoundError):
        ingest.read_counts(spark, out)

    def run(*sources):
        spark.createDataFrame([(s, "x") for s in sources], "source string, text string").coalesce(1).write.mode("append").parquet(source)
        rows = ingest.read_folder(spark, source, "source string, text string")
        ingest.count_stream(rows, out, log).awaitTermination()
        return {r["source"]: r["n"] for r in ingest.read_counts(spark, out).collect()}

    assert run("a", "a", "b") == {"a": 2, "b": 1}
    held = ingest.read_counts(spark, out)
    (tmp_path / "out" / "version-9999999999").mkdir()  # a version that broke off
    (tmp_path / "out" / "version-9999999999" / "part-0.parquet").write_bytes(b"half")
    assert run("b", "c") == {"a": 2, "b": 2, "c": 1}
    assert {r["source"]: r["n"] for r in held.collect()} == {"a": 2, "b": 1}
    assert run("c") == {"a": 2, "b": 2, "c": 2}
    ingest.drop_versions(spark, out, 1)
    assert len(ingest.whole_versions(spark, out)) == 1
    assert ingest.read_counts(spark, out).count() == 3


def test_a_broken_file_is_skipped(spark, tmp_path, caplog):
    good = spark.range(5).selectExpr("id", "'x' as text")
    good.coalesce(1).write.parquet(f"{tmp_path}/a")
    good.coalesce(1).write.parquet(f"{tmp_path}/b")
    (tmp_path / "a" / "broken.parquet").write_bytes(b"PAR1 this is no footer PAR1")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "broken.parquet").write_bytes(b"nothing")
    rows = scans.scan_parquet_folders(spark, str(tmp_path), ("id",), with_place=True).collect()
    assert sorted((r["source"], r["id"], r["row_index"]) for r in rows) == [(s, i, i) for s in "ab" for i in range(5)]
    assert "broken.parquet" in caplog.text


def test_a_folder_of_parts_is_one_file(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "documents.parquet").mkdir()
    for part, ids in enumerate(([0, 1, 2], [3], [4, 5])):
        pq.write_table(pa.table({"doc_id": ids}), tmp_path / "documents.parquet" / f"part-{part}.parquet")
    pq.write_table(pa.table({"key": [1]}), tmp_path / "region.parquet")
    rows = scans.scan_parquet_files(spark, str(tmp_path), "documents.parquet").collect()
    assert sorted((r["doc_id"], r["language"], r["row_index"]) for r in rows) == [(i, "documents", i) for i in range(6)]


def test_merges_are_numbered_across_files_and_blocks(spark, tmp_path):
    lines = [f"a{i} b{i}" for i in range(3000)]
    for part in range(3):
        text = "\n".join(lines[1000 * part : 1000 * (part + 1)]) + "\n"
        (tmp_path / f"part-{part}").write_text(text + "\n\n" * (part == 2))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = scans.load_merges(spark, str(tmp_path)).orderBy("rank").collect()
        first = scans.load_merges(spark, str(tmp_path), first=1500).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [(r["rank"], f"{r['left']} {r['right']}") for r in got] == list(enumerate(lines))
    assert first == 1500
