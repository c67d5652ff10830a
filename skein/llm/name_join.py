"""Edit-distance name join by asymmetric q-chunks.

One side (the indexed names, here vendors) is cut into disjoint chunks, the other (the probing names, here clients)
offers its positional q-grams. A name of L code points has m = 2 * most + 2 chunks of q = L div m code points each, at
0, q, 2q and so on. An edit touches at most two chunks (an exchange may stand across a border), so of a pair within
``most`` edits at least m - 2 * most = 2 chunks stand unharmed in the other name, each moved by at most ``most``. That
bound is the index: every two chunks of an indexed name, with L and their numbers, are a key, and a probing name has a
key for every two of its q-grams that can be those chunks moved by insertions and deletions of which no more than
``most`` are needed in all. Names with chunks under ``LEAST_Q`` code points are handled exhaustively: all strings that
are left when up to ``most`` code points are taken out are keys on both sides (each edit costs either name at most one).

Names that share a key are verified by their exact unrestricted Damerau-Levenshtein distance. Equal names are one name
until the end: rows of a name are summed up before, so a name that a third of all rows have is one probe. All steps are
joins and sums by name or key; nothing is collected or broadcast (hints keep adaptive execution from broadcasting what
is small by chance), and the joins are plain equi-joins of two shuffled sides, which it can split where a key is hot.

Null and empty names take no part. Ids may repeat or be null: equal rows (id, name) of the indexed side are one, every
row of the probing side counts; a null probing id counts in n, is never the first and adds nothing to crc; a null
indexed id is kept, its name as it is. Names may have any length (verification takes time with the product of what
differs between equal heads and tails). Other columns aren't read. An empty side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: Fewest code points of a chunk; names with smaller chunks are short.
LEAST_Q = 2


def distance(a: str, b: str, most: int) -> int | None:
    """The unrestricted Damerau-Levenshtein distance of a and b if it is at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    # table[i + 1][j + 1] is the distance of the first i and j code points; row and column 0 are out of reach.
    far = len(a) + len(b)
    grid = [[far] * (len(b) + 2)] + [[far, *([i] + [0] * len(b) if i else range(len(b) + 1))] for i in range(len(a) + 1)]
    row_of: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        column = 0
        for j, y in enumerate(b, 1):
            up, left = row_of.get(y, 0), column
            if x == y:
                column = j
            exchanged = grid[up][left] + (i - up - 1) + 1 + (j - left - 1)
            grid[i + 1][j + 1] = min(grid[i][j] + (x != y), grid[i + 1][j] + 1, grid[i][j + 1] + 1, exchanged)
        row_of[x] = i
    out = grid[len(a) + 1][len(b) + 1]
    return out if out <= most else None


def moves(most: int) -> list[tuple[int, int, int, int, int]]:
    """(longer, i, j, di, dj): how much longer the probing name is, two chunks and how far each may have moved there."""
    steps = range(-most, most + 1)
    fits = lambda d, di, dj: abs(di) + abs(dj - di) + abs(d - dj) <= most
    return [(d, i, j, di, dj) for d in steps for i, j in combinations(range(2 * most + 2), 2) for di in steps for dj in steps if fits(d, di, dj)]


def _pair_key(size: Column, i: Column, j: Column, name: Column, at_i: Column, at_j: Column, q: Column) -> Column:
    part = lambda at: F.substring(name, at + 1, q)
    return F.xxhash64(size, i, j, part(at_i), part(at_j))


def _without(name: Column, most: int) -> Column:
    """All strings left of ``name`` when up to ``most`` code points are taken out."""
    less = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda k: F.concat(F.substring(s, F.lit(1), k - 1), F.substr(s, k + 1)))
    out = F.array(name)
    for _ in range(most):
        out = F.array_distinct(F.flatten(F.transform(out, lambda s: F.when(s == "", F.array(s)).otherwise(F.concat(F.array(s), less(s))))))
    return out


def _indexed_keys(names: DataFrame, most: int) -> DataFrame:
    """key and v for each key of the indexed names (name)."""
    chunks, size = 2 * most + 2, F.length("name")
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in combinations(range(chunks), 2)])
    long = names.where(size >= chunks * LEAST_Q).select("name", size.alias("size"), F.explode(pairs).alias("p"))
    q, i, j = F.floor(F.col("size") / chunks).cast("int"), F.col("p.i"), F.col("p.j")
    long = long.select(_pair_key(F.col("size"), i, j, F.col("name"), i * q, j * q, q).alias("key"), F.col("name").alias("v"))
    short = names.where(size < chunks * LEAST_Q).select(F.explode(_without(F.col("name"), most)).alias("left"), F.col("name").alias("v"))
    return long.unionByName(short.select(F.xxhash64(F.lit("short"), "left").alias("key"), "v"))


def _probing_keys(names: DataFrame, most: int) -> DataFrame:
    """key and c for each key of the probing names (name)."""
    chunks, length = 2 * most + 2, F.length("name")
    tries = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(move, ("d", "i", "j", "di", "dj"))]) for move in moves(most)])
    long = names.where(length >= chunks * LEAST_Q - most).select("name", F.explode(tries).alias("t"))
    size = F.length("name") - F.col("t.d")
    q = F.floor(size / chunks).cast("int")
    at_i, at_j = F.col("t.i") * q + F.col("t.di"), F.col("t.j") * q + F.col("t.dj")
    long = long.where((size >= chunks * LEAST_Q) & (at_i >= 0) & (at_j + q <= F.length("name")))
    long = long.select(_pair_key(size, F.col("t.i"), F.col("t.j"), F.col("name"), at_i, at_j, q).alias("key"), F.col("name").alias("c"))
    short = names.where(length < chunks * LEAST_Q + most).select(F.explode(_without(F.col("name"), most)).alias("left"), F.col("name").alias("c"))
    return long.unionByName(short.select(F.xxhash64(F.lit("short"), "left").alias("key"), "c"))


def close_names(indexed: DataFrame, probing: DataFrame, most: int = 1) -> DataFrame:
    """v, c, distance of all pairs of distinct names (name, not null or empty) that are within ``most`` edits."""
    met = _indexed_keys(indexed, most).join(_probing_keys(probing, most).hint("merge"), "key")
    # Each exchange is two plain edits, so plain distance bounds what can qualify before pairs are made distinct.
    met = met.where(F.levenshtein("v", "c", 2 * most) >= 0).select("v", "c").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distance(v.as_py(), c.as_py(), most) for v, c in zip(batch.column("v"), batch.column("c"))]
            out = pa.array(found, pa.int32())
            yield batch.append_column("distance", out).filter(out.is_valid())

    return met.mapInArrow(verify, "v string, c string, distance int")


def names_of(rows: DataFrame, id_name: str, name: str) -> DataFrame:
    """name with n (rows), first (smallest id) and crc (sum of the unsigned crc32 of each decimal id)."""
    crc = F.crc32(F.col(id_name).cast("string").cast("binary"))
    rows = rows.where(F.length(name) > 0).groupBy(F.col(name).alias("name"))
    return rows.agg(F.count("*").alias("n"), F.min(F.col(id_name).cast("long")).alias("first"), F.coalesce(F.sum(crc), F.lit(0).cast("long")).alias("crc"))


def misspelt(name: Column, number: Column) -> Column:
    """``name`` with two adjacent code points exchanged, at a place told by the crc32 of ``number``, if that is even."""
    h = F.crc32(number.cast("string").cast("binary"))
    at = F.pmod(h, (F.length(name) - 1).cast("long")).cast("int")
    part = lambda start, n: F.substring(name, start, n)
    swapped = F.concat(part(F.lit(1), at), part(at + 2, F.lit(1)), part(at + 1, F.lit(1)), F.substr(name, at + 3))
    return F.when((F.length(name) >= 2) & (h % 2 == 0), swapped).otherwise(name)


def linked_clients(vendors: DataFrame, clients: DataFrame, most: int = 1) -> DataFrame:
    """vendor_id, distance, n_clients, first_client_id, clients_crc for vendors (vendor_id, name) and clients
    (client_id, name): one row for each vendor and distance of a qualifying pair."""
    sellers = cut(vendors.where(F.length("name") > 0).select(F.col("vendor_id").cast("long"), "name").distinct())
    names = cut(names_of(clients, "client_id", "name"))
    pairs = close_names(sellers.select("name").distinct(), names.select("name"), most)
    sums = pairs.join(names.withColumnRenamed("name", "c").hint("merge"), "c").groupBy("v", "distance")
    sums = sums.agg(F.sum("n").alias("n_clients"), F.min("first").alias("first_client_id"), F.sum("crc").alias("clients_crc"))
    of_id = sellers.join(sums.withColumnRenamed("v", "name").hint("merge"), "name").groupBy("vendor_id", "distance")
    return of_id.agg(F.sum("n_clients").alias("n_clients"), F.min("first_client_id").alias("first_client_id"), F.sum("clients_crc").alias("clients_crc"))


def op11_name_join(spark, sf_dir: str) -> DataFrame:
    vendors = table(spark, sf_dir, "vendors").select("vendor_id", misspelt(F.col("name"), F.col("vendor_id")).alias("name"))
    return linked_clients(vendors, table(spark, sf_dir, "clients").select("client_id", "name"))


#: The same in DuckDB: every way of one edit as a join on what is left of both names. crc32 is the polynomial's table
#: (256 entries, eight halvings each) folded over the digits.
CRC_SQL = """
with recursive halved(i, c, k) as (
  select range, range::ubigint, 0 from range(256)
  union all select i, case when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end, k + 1 from halved where k < 8),
crcs as (select list(c order by i) as t from halved where k = 8)"""

OP11_SQL = CRC_SQL + """,
ids as (select vendor_id as id from vendors union select client_id from clients),
crc as (
  select id, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(id::varchar, ''), lambda d: ascii(d)::ubigint)),
    lambda c, d: xor(c // 256, t[(xor(c, d) % 256)::int + 1])), 4294967295::ubigint) as h from ids, crcs),
spelt as (
  select distinct vendor_id, case when h % 2 = 0 and length(name) >= 2
    then substr(name, 1, p) || substr(name, p + 2, 1) || substr(name, p + 1, 1) || substr(name, p + 3) else name end as v
  from (select vendor_id, name, h, case when length(name) >= 2 then (h % (length(name) - 1))::bigint end as p
    from vendors left join crc on id = vendor_id where length(name) > 0)),
names as (
  select name as c, count(*) as n, min(client_id) as first, sum(h) as crc
  from clients left join crc on id = client_id where length(name) > 0 group by name),
vs as (select distinct v from spelt),
vp as (select v, unnest(range(1, length(v) + 1)) as k from vs),
cp as (select c, unnest(range(1, length(c) + 1)) as k from names),
near as (
  select v, c, 0 as distance from vs join names on v = c
  union select v, c, 1 from (select v, k, substr(v, 1, k - 1) || chr(1) || substr(v, k + 1) as p from vp) x
    join (select c, k, substr(c, 1, k - 1) || chr(1) || substr(c, k + 1) as p from cp) y using (p) where v <> c
  union select v, c, 1 from (select v, substr(v, 1, k - 1) || substr(v, k + 1) as p from vp) x join names on c = p
  union select v, c, 1 from vs join (select c, substr(c, 1, k - 1) || substr(c, k + 1) as p from cp) y on v = p
  union select v, c, 1 from (select v, substr(v, 1, k - 1) || substr(v, k + 1, 1) || substr(v, k, 1) || substr(v, k + 2) as p from vp where k < length(v)) x
    join names on c = p where v <> c)
select vendor_id, distance, sum(n)::bigint as n_clients, min(first) as first_client_id, coalesce(sum(crc), 0)::bigint as clients_crc
from spelt join near using (v) join names using (c) group by vendor_id, distance
"""
