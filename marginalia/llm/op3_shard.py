"""Placement of documents on shards by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own (an offset and a step,
both hashes of its name). The shards take turns, each claiming the first slot of its order that is
free, until the table is full: each gets size/shards slots to within one, and adding or removing a
shard moves few of the others' slots. A document's slot is a hash of its id, so placement is one
lookup in a table whose size is a parameter, which is what makes it safe to broadcast.

Defined cases: a null doc_id is placed like the text 'null'; repeated rows go to one shard; an empty
table gives no rows; extra columns are kept.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import unused

SHARDS = tuple(f"shard-{k:02d}" for k in range(16))
SLOTS = 2039
#: The largest table that may be broadcast.
MOST_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard's number of each slot."""
    if not _is_prime(slots) or not len(set(shards)) == len(shards) <= slots <= MOST_SLOTS:
        raise ValueError("slots must be a prime of at least the number of (distinct) shards and at most MOST_SLOTS")
    draw = lambda name, salt, mod: int(md5(f"{salt}:{name}".encode()).hexdigest()[:8], 16) % mod

    def order(name):
        at, step = draw(name, "offset", slots), draw(name, "step", slots - 1) + 1 if slots > 2 else 1
        return ((at + j * step) % slots for j in range(slots))

    orders = [order(s) for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for k, order in enumerate(orders):
            if not free:
                break
            table[next(x for x in order if table[x] < 0)] = k
            free -= 1
    return table


def slot(slots: int = SLOTS) -> Column:
    """The slot of a row: a hash of its doc_id."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """docs with the columns slot and shard (in place of columns with these names)."""
    kept = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    (key,) = unused(docs, "key")
    table = docs.sparkSession.createDataFrame(list(enumerate(shards[k] for k in fill(shards, slots))), f"{key} int, shard string")
    return docs.select(*kept, slot(slots).alias("slot")).join(F.broadcast(table), F.col("slot") == F.col(key)).select(*kept, "slot", "shard")


def op3_shard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return place(docs.select("doc_id", "source")).select("doc_id", "slot", "shard")


def oracle(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> str:
    """DuckDB SQL for op3: turns claim slots in a recursive query over the list of free slots."""
    names = ", ".join(f"({k}, '{s}')" for k, s in enumerate(shards))
    draw = lambda salt, mod: f"(('0x' || substr(md5('{salt}:' || name), 1, 8))::BIGINT % {mod})"
    return f"""
WITH RECURSIVE shards(k, name) AS (VALUES {names}),
prefs AS (SELECT k, {draw("offset", slots)} AS o, {draw("step", slots - 1)} + 1 AS s FROM shards),
lists AS (SELECT list(o ORDER BY k) AS os, list(s ORDER BY k) AS ss FROM prefs),
fill(turn, free, claimed, owner) AS (
  SELECT 0, list_transform(range({slots}), lambda x: CAST(x AS BIGINT)), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT)
  UNION ALL
  SELECT turn + 1, list_filter(free, lambda x: x <> pick), pick, CAST(turn % {len(shards)} AS BIGINT)
  FROM (SELECT turn, free, (o + s * list_min(list_transform(free, lambda x: ((x - o + {slots}) * inv) % {slots}))) % {slots} AS pick
        FROM (SELECT f.turn, f.free, l.os[f.turn % {len(shards)} + 1] AS o, l.ss[f.turn % {len(shards)} + 1] AS s, i.invs[f.turn % {len(shards)} + 1] AS inv
              FROM fill f, lists l, (SELECT list(inv ORDER BY k) AS invs FROM (SELECT p.k, (SELECT min(r) FROM range({slots}) t(r) WHERE (r * p.s) % {slots} = 1) AS inv FROM prefs p)) i
              WHERE f.turn < {slots})))
SELECT d.doc_id, CAST(d.slot AS INTEGER) AS slot, s.name AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT % {slots} AS slot FROM documents) d
JOIN fill f ON f.claimed = d.slot JOIN shards s ON s.k = f.owner
"""
