import zlib

from lingua_spark.llm.byte_shards import byte_shards


def slow(rows, shards):
    order = sorted(
        ((r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1) for r in rows)
    )
    total, before, slots, out = sum(o[3] for o in order), 0, {}, []
    for there, doc_id, crc, size in order:
        shard = before * shards // total
        out.append((doc_id if there else None, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "size", "text_crc32", "shard", "slot")) for r in df.collect()), key=str)


def test_odd_rows(odd, none):
    for n in (1, 3, 16):
        assert rows_of(byte_shards(odd, n)) == sorted(slow(odd.collect(), n), key=str)
    assert byte_shards(none).count() == 0


def test_equals_running_sums(spark):
    docs = spark.range(0, 3000, 1, 7).selectExpr("id * 7 % 3000 as doc_id", "repeat('é', cast(id % 97 as int)) as text")
    got = rows_of(byte_shards(docs, 16))
    assert got == sorted(slow(docs.collect(), 16), key=str)
    sizes = [sum(r[1] for r in got if r[3] == s) for s in range(16)]
    assert max(sizes) - min(sizes) <= 2 * 193


def test_one_key_for_all_rows(spark):
    docs = spark.range(2000).selectExpr("cast(1 as bigint) as doc_id", "'same' as text")
    rows = byte_shards(docs, 4).collect()
    assert [sum(r["shard"] == s for r in rows) for s in range(4)] == [500] * 4
    assert sorted(r["slot"] for r in rows if r["shard"] == 2) == list(range(500))
