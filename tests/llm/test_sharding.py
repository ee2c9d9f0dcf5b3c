"""Jump hashing against the published loop on Python's integers, its law, slots, awkward rows and written shards."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelforge.llm import sharding as S
from labelforge.llm.common import table


def plain_jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def number(key) -> int:
    return int(hashlib.md5(b"-" if key is None else b"=" + str(key).encode()).hexdigest()[:16], 16)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 24, 1000])
def test_shard_is_that_of_the_loop(spark, n):
    keys = [*range(-50, 300), 2**62, -(2**63), 2**63 - 1, None]
    rows, shard = S.with_shards(spark.createDataFrame([(k,) for k in keys], "doc_id long"), n)
    assert {r.doc_id: r[shard] for r in rows.collect()} == {k: plain_jump(number(k), n) for k in keys}


def test_halves_of_extreme_keys(spark):
    keys = [0, 1, 2**32 - 1, 2**32, 2**63, 2**64 - 1, 0xFFFFFFFF00000000]
    rows = spark.createDataFrame([(k >> 32, k & 0xFFFFFFFF) for k in keys], "hi long, lo long")
    assert [r[0] for r in rows.select(S.jump("hi", "lo", 97)).collect()] == [plain_jump(k, 97) for k in keys]
    with pytest.raises(ValueError):
        S.jump("hi", "lo", 0)


def test_a_new_shard_takes_rows_only_into_itself(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    found = S.assign(docs, 24).collect()
    went = [r for r in found if r.shard != r.grown_shard]
    assert {r.grown_shard for r in went} == {24}
    assert abs(len(went) - 20_000 / 25) < 5 * (20_000 / 25) ** 0.5
    sizes = Counter(r.shard for r in found)
    assert len(sizes) == 24 and max(abs(n - 20_000 / 24) for n in sizes.values()) < 5 * (20_000 / 24) ** 0.5
    assert S.moved(docs, 24, 25).count() == len(went)


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = {r.doc_id: r.text for r in docs.collect()}
    by_shard: dict[int, list] = {}
    for r in S.assign(docs, 24).collect():
        raw = (held[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        by_shard.setdefault(r.shard, []).append((r.slot, r.doc_id))
    for rows in by_shard.values():
        assert [s for s, _ in sorted(rows)] == list(range(len(rows))) and sorted(rows) == sorted(rows, key=lambda x: x[1])


def test_awkward_rows(spark):
    rows = [(1, None, "s"), (1, None, "s"), (None, "é", "t"), (None, "", "t"), (2, "x" * 300_000, "u")] + [(7, "same", "v")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(7)
    found = S.assign(docs, 3).collect()
    assert len(found) == len(rows)
    assert sorted((r["size"], r.text_crc32) for r in found if r.doc_id is None) == [(8, 0), (10, zlib.crc32("é".encode()))]
    assert len({r.shard for r in found if r.doc_id == 7}) == 1
    for shard in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    sharded, name = S.with_shards(docs, 3)
    assert name == "_shard" and {r.shard for r in sharded.collect()} == {r[2] for r in rows}
    assert S.assign(docs.limit(0), 24).count() == 0
    assert S.assign(spark.createDataFrame([("a", "b")], "doc_id string, text string"), 24).first().doc_id == "a"


def test_written_shards(spark, tmp_path):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    S.write_shards(docs, str(tmp_path / "out"), 5, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {r.doc_id: r.shard for r in S.assign(docs, 5).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want


def test_query_against_sql(spark, sf_dir):
    from oracle import compare, duck

    from labelforge.llm import queries as Q

    assert compare(spark, duck(sf_dir), Q.op11_sharding, Q.oracle_sql()["op11_sharding"], sf_dir) == ""
