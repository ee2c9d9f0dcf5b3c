"""Sharding by jump consistent hashing, as DataFrame functions only.

A key's 64-bit number comes from the MD5 of its text, so a key of any type goes to the same shard in every engine. Jump hashing then walks that key's increasing sequence
of candidate shards, each drawn from a 64-bit linear congruential generator, and takes the last one below the number of shards: no ring table, and with
one more shard a key either stays or moves into the new one, which has its fair share in expectation. Spark's arithmetic refuses to
overflow, so the generator's product modulo 2^64 is put together from halves of the numbers.

Expected steps grow with the logarithm of the number of shards; each step's candidate is above the last, so ``n_shards`` steps are enough for any key. They are
taken ``STEPS`` at a time, and a row whose walk has ended passes over the rest.

Within a shard, rows get gapless slots in the order of key, size and checksum: rows are dealt into ranges of (shard, key, ...) by Spark's sampled splitters, and each
range's start in its shard comes from a prefix sum over the counts of ranges. No task holds a whole shard.

Defined results: all rows of a key are in one shard; a null key is a key of its own; a null text has no bytes; repeated rows
have a slot each; an empty table gives an empty result; other columns play no part, or are kept by ``with_shards``, whose new columns get underscores before their names where these clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import cut, fresh, rank_within, text_of

#: The generator's multiplier, 2862933555777941757, as two halves of 32 bits, the lower one also as two of 16.
HIGH, LOW = divmod(2862933555777941757, 1 << 32)
LOW_HIGH, LOW_LOW = divmod(LOW, 1 << 16)
WORD = 0xFFFFFFFF
STEPS = 16


def _next(hi: str, lo: str) -> str:
    """SQL for {hi, lo} of the generator's next number, key * multiplier + 1 modulo 2^64: no product has more than 62 bits."""
    low = f"({lo} * {LOW_LOW}L + shiftleft(({lo} * {LOW_HIGH}L) & 65535L, 16) + 1L)"
    carried = f"shiftright({low}, 32) + shiftright({lo} * {LOW_HIGH}L, 16)"
    high = f"({carried} + (({hi} * {LOW_LOW}L + shiftleft(({hi} * {LOW_HIGH}L) & 65535L, 16)) & {WORD}L) + (({lo} * {HIGH}L) & {WORD}L)) & {WORD}L"
    return f"named_struct('hi', {high}, 'lo', {low} & {WORD}L)"


def jump(hi: str, lo: str, n_shards: int) -> Column:
    """The shard, 0 to ``n_shards`` - 1, of the 64-bit key whose halves (0 to 2^32 - 1 each) the SQL ``hi`` and ``lo`` give."""
    if n_shards < 1:
        raise ValueError("n_shards is 1 or more")
    # state: the generator's halves, the last candidate below n_shards, the next one
    following = "floor((s.next + 1) * (2147483648D / (shiftright(x.hi, 1) + 1)))"
    step = f"if(s.next >= {n_shards}, s, transform(array({_next('s.hi', 's.lo')}), x -> named_struct('hi', x.hi, 'lo', x.lo, 'shard', s.next, 'next', {following}))[0])"
    some = f"aggregate(sequence(1, {STEPS}), t, (s, i) -> {step})"
    start = f"named_struct('hi', {hi}, 'lo', {lo}, 'shard', -1L, 'next', 0L)"
    return F.expr(f"int(aggregate(sequence(1, {-(-n_shards // STEPS)}), {start}, (t, j) -> if(t.next >= {n_shards}, t, {some})).shard)")


def _halves(key: str) -> list[str]:
    """SQL for the halves of a key's number; a null key has a text of its own, one character that no other key begins with."""
    digest = f"md5(coalesce(concat('=', string({key})), '-'))"
    return [f"bigint(conv(substr({digest}, {at}, 8), 16, 10))" for at in (1, 9)]


def with_shards(docs: DataFrame, n_shards: int, key_col: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with a column ``shard``, and that column's name."""
    hi, lo, shard = fresh(docs, "__hi", "__lo", "shard")
    keyed = docs.withColumns(dict(zip((hi, lo), map(F.expr, _halves(f"`{key_col}`")), strict=True)))
    return keyed.withColumn(shard, jump(f"`{hi}`", f"`{lo}`", n_shards)).drop(hi, lo), shard


def assign(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size (bytes of the text and 8), text_crc32, shard, slot and grown_shard (with one shard more) of each row."""
    text = text_of(text_col)
    hi, lo = _halves("id")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    keyed = rows.withColumns({"hi": F.expr(hi), "lo": F.expr(lo)})
    placed = keyed.select("id", "size", "text_crc32", jump("hi", "lo", n_shards).alias("shard"), jump("hi", "lo", n_shards + 1).alias("grown_shard"))
    return with_slots(placed).withColumnRenamed("id", id_col)


def with_slots(placed: DataFrame) -> DataFrame:
    """``placed`` (id, size, text_crc32, shard, ...) with ``slot``, from 0 and gapless in each shard, by id, size and checksum."""
    order = ["id", "size", "text_crc32"]
    # rows that are equal in all of these are dealt by where they came from, so they don't share one range
    ranged = placed.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange("shard", *order, "__tie").withColumn("__range", F.spark_partition_id())
    # range numbers are fixed before they are counted, as splitters are sampled anew in each run
    return rank_within(cut(ranged), "shard", [*order, "__tie"], "slot", ranges="__range").drop("__tie", "__range").withColumn("slot", F.col("slot").cast("long"))


def write_shards(docs: DataFrame, path: str, n_shards: int, key_col: str = "doc_id", files: int = 1) -> None:
    """``docs`` as Parquet, a folder for each shard, each shard in ``files`` files by a hash of the row's key and place, so that no task writes a whole large shard."""
    sharded, shard = with_shards(docs, n_shards, key_col)
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files))
    sharded.repartition(shard, deal).write.partitionBy(shard).parquet(path)


def moved(docs: DataFrame, before: int, after: int, key_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose shard differs between ``before`` and ``after`` shards, with columns ``shard`` (before) and ``new_shard``: what a resharding has to copy."""
    old, shard = with_shards(docs, before, key_col)
    new, new_shard = with_shards(old, after, key_col)
    (name,) = fresh(docs, "new_shard")
    return new.filter(F.col(f"`{shard}`") != F.col(f"`{new_shard}`")).withColumnRenamed(new_shard, name)
