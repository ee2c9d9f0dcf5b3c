"""Mixing sources to target weights by Pfair scheduling, as DataFrame functions only.

A source's rows are dealt into blocks of ``block_rows``. Block j of a source
with share w of the slots is released at floor(j / w) and due at
ceil((j + 1) / w); each slot takes the released block with the earliest
deadline. So after any number of slots a source has had its share of them to
within less than one block. Shares are the weights themselves, as whole numbers
without a common divisor, so the schedule repeats after their sum and is exact over any number
of periods. A period is planned once on the driver, from weights and row counts of the
streams alone, and no further than the phase goes. A caller may ask for shares that are
rounded to a given ``period`` (largest remainders).

When a stream has no block left, a new phase starts: the weights of the
others are scaled up to 1 and a new schedule begins. The bound holds within each
phase against the target weights of its streams. Streams of weight 0 come after all others, in equal shares. No row is dropped or repeated.

``weights`` names the streams; rows of every other source, null included, form
the stream ``*``, with weight ``other``. So the plan is bounded by the length of
``weights``, whatever the number of sources.

Within a stream rows go by hash bucket, then id (a fixed shuffle).
Defined results: a null source is in ``*``; a null id is a row like others;
repeated rows keep a place each; an empty table gives an empty result; an input
column that bears the name of a new one stays as it is, and the new one gets underscores before its name.
"""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import fresh, rank_within

OTHER = "*"


def exact_shares(weights: dict[str, float]) -> dict[str, int]:
    """The weights, as they are written in decimals, as whole numbers without a common divisor."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {k: int(x * scale) for k, x in exact.items()}
    divisor = math.gcd(*whole.values())
    return {k: n // divisor for k, n in whole.items()}


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Slots of a period for each stream: at least one, by largest remainders."""
    period = max(period, len(weights))
    total, spare = sum(weights.values()), period - len(weights)
    exact = {k: max(0.0, period * w / total - 1) for k, w in weights.items()}
    scale = spare / sum(exact.values()) if sum(exact.values()) else 0
    out = {k: 1 + int(x * scale) for k, x in exact.items()}
    for k in sorted(weights, key=lambda k: (int(exact[k] * scale) - exact[k] * scale, k))[: period - sum(out.values())]:
        out[k] += 1
    first = min(weights)
    out[first] += period - sum(out.values())
    return out


def earliest_deadline_first(share: dict[str, int], most: int | None = None) -> dict[str, list[int]]:
    """Slots that each stream's blocks take within a period, or within its first ``most`` slots."""
    period = sum(share.values())
    waiting = [(0, k, 0) for k in sorted(share)]  # release, stream, block
    ready: list[tuple[int, str, int]] = []  # deadline, stream, block
    taken: dict[str, list[int]] = {k: [] for k in share}
    heapq.heapify(waiting)
    for slot in range(period if most is None else min(period, most)):
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // share[k]), k, j))
        due, k, j = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block misses its deadline")
        taken[k].append(slot)
        if j + 1 < share[k]:
            heapq.heappush(waiting, ((j + 1) * period // share[k], k, j + 1))
    return taken


def phases(blocks: dict[str, int], weights: dict[str, float], period: int | None = None) -> list[dict]:
    """For each stream and phase: first and last block (excluded), blocks a period, first slot, slots in a period."""
    left = {k: n for k, n in blocks.items() if n}
    begun = dict.fromkeys(left, 0)
    base, rows = 0, []
    while left:
        due = {k: weights[k] for k in left if weights[k] > 0} or dict.fromkeys(left, 1)
        share = shares(due, period) if period else exact_shares(due)
        # each slot takes a block, so a stream runs out within as many slots as there are blocks
        plan, length = earliest_deadline_first(share, sum(left[k] for k in due)), sum(share.values())
        ends = ((n - 1) // share[k] * length + plan[k][(n - 1) % share[k]] for k, n in left.items() if k in due and (n - 1) % share[k] < len(plan[k]))
        stop = min(ends) + 1
        for k in due:
            n = stop // length * share[k] + sum(s < stop % length for s in plan[k])
            rows.append({"stream": k, "lo": begun[k], "hi": begun[k] + n, "share": share[k], "base": base, "period": length, "slots": plan[k]})
            begun[k] += n
            left[k] -= n
            if not left[k]:
                del left[k]
        base += stop
    return rows


_PLAN = "array<struct<stream:string,lo:long,hi:long,share:long,base:long,period:long,slots:array<long>>>"


def mix(docs: DataFrame, weights: dict[str, float], other: float, block_rows: int = 16, period: int | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with ``mix_stream``, ``mix_block``, ``mix_slot`` and ``mix_pos``; ordering by ``mix_pos`` interleaves the streams.

    ``mix_pos`` is unique; it has gaps where a block is not full and at the
    ends of phases.
    """
    known = F.array(*map(F.lit, sorted(weights))) if weights else F.expr("cast(array() as array<string>)")
    source = F.col(f"`{source_col}`")
    stream, block, slot, pos, rank, plan, key = fresh(docs, "mix_stream", "mix_block", "mix_slot", "mix_pos", "__mix_rank", "__mix_plan", "__stream")
    named = docs.withColumn(stream, F.when(F.array_contains(known, source), source).otherwise(F.lit(OTHER)))
    counts = {r[0]: r[1] for r in named.groupBy(stream).agg(F.count(F.lit(1))).collect()}  # len(weights) + 1 rows at most
    every = {**weights, OTHER: other}
    table = phases({k: -(-n // block_rows) for k, n in counts.items()}, every, period)
    ranked = rank_within(named, stream, [id_col], rank).withColumn(block, F.floor(F.col(rank) / block_rows).cast("long"))
    steps = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(table)), _PLAN)))
    by_stream = steps.groupBy(F.col("stream").alias(key)).agg(F.collect_list(F.struct("lo", "hi", "share", "base", "period", "slots")).alias(plan))
    placed = ranked.join(F.broadcast(by_stream), ranked[stream] == by_stream[key])  # len(weights) + 1 rows
    at = f"element_at(transform(filter(`{plan}`, p -> `{block}` >= p.lo and `{block}` < p.hi), p -> p.base + (`{block}` - p.lo) div p.share * p.period + element_at(p.slots, cast((`{block}` - p.lo) % p.share as int) + 1)), 1)"
    slotted = placed.withColumn(slot, F.expr(at))
    position = F.col(slot) * block_rows + F.col(rank) % block_rows
    return slotted.select(*[F.col(f"`{c}`") for c in docs.columns], stream, block, slot, position.cast("long").alias(pos))
