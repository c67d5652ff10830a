"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint has 64 bits, each set if over half of a text's word shingles (repeats included) have it set in their
XXH64. Documents of equal fingerprint are one *code*. Codes link when at most ``most`` of their bits differ.

The index. Upper nodes are masked bit patterns: of ``most + 1`` segments of the bits two linked codes agree in at least
one, so each code stands below one node for each segment, and nodes are dealt over the cluster. A node with more than
``node_rows`` codes is factored again: the bits outside its mask are cut into ``most + 1`` segments, of which linked
codes again agree in one, so finer masked patterns take its place (down to ``deepest`` levels; codes of a level are
counted to tell which nodes are large). Below an upper node codes are sorted by Gray rank, so codes of few differing
bits stand together, and eight at a time are grouped; a group's pattern holds the bits in which all its codes agree,
less those that the groups above have already. A code searches from the top: the differences to the patterns on the
way add up, and a group goes, with all its codes, once they exceed ``most`` (``linked_pairs``).

Nodes that are still larger at the deepest level are cut, in Gray order, into blocks; blocks of one node face each
other if their patterns differ in at most ``most`` bits, and of each pair of blocks the links are searched. Of the links
found in a piece of work only a forest is given on, which ties the same codes and is never longer than the codes.
Components come from joins and sums by code (``common.connected``).

Texts are lower-cased in A-Z; words are ``[^\\x20\\x09-\\x0D]+``; fewer than k words are one shingle; null texts and texts
without words have fingerprint zero and link like others. Repeated rows, also of one doc_id, each keep their row.
component_id is the smallest doc_id that is not null in the component, or null. Texts are worked off in pieces, so their
length is bounded by one value only. Other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, cut, keep_keys, table

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ALL = (1 << 64) - 1
#: Codes of one piece of work in a worker, and most pairs looked at together.
PIECE, PAIRS = 50_000, 2_000_000


def pieces(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` cut at white space, about ``size`` bytes each."""
    at = 0
    while at < len(data):
        gap = _SPACE.search(data, min(at + size, len(data)))
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def fingerprint(data: bytes | None, k: int = 4, seed: int = 42) -> int:
    counts, shingles, carried = np.zeros(64, np.int64), 0, []

    def add(hashes: list[int]) -> None:
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[:] += bits.sum(axis=0, dtype=np.int64)

    digest = xxhash.xxh64_intdigest
    for piece in pieces(data or b""):
        words = carried + piece.lower().split()
        carried = words[max(0, len(words) - k + 1) :]
        if len(words) < k:
            continue
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-k].tolist()]
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())]
        shingles += len(hashes)
        add(hashes)
    if not shingles and carried:
        shingles = 1
        add([digest(b" ".join(carried), seed)])
    return int(np.packbits(2 * counts > shingles, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id and code (the fingerprint as a signed long) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t.as_py(), k) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes.view(np.int64))], ["doc_id", "code"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, code long")


def segments(mask: int, parts: int) -> list[int]:
    """``mask`` with the bits of each of ``parts`` even segments of the others; all bits are in one of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Places of the codes in the reflected Gray order."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def linked_pairs(codes: np.ndarray, node: np.ndarray, most: int, fan: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of linked codes of one node, part by part; ``codes`` are sorted by node and in it by Gray rank."""
    n = len(codes)
    turns = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    size = np.diff(np.r_[turns, n])
    inside = np.arange(n) - np.repeat(turns, size)
    # Levels from the codes up; a group of level h holds fan ** h codes at most, the top one a whole node.
    step, levels = 1, []
    while True:
        starts = np.flatnonzero(inside % step == 0)
        both, any_ = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
        levels.append((starts, ~(both ^ any_), both))
        if step >= size.max():
            break
        step *= fan
    tops = np.repeat(np.arange(len(turns)), size)
    work = np.cumsum(np.repeat(size, size))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + PAIRS, "right")))
        code = np.arange(at, end)
        group, apart = tops[at:end], np.zeros(end - at, np.int64)
        for h in range(len(levels) - 1, 0, -1):
            starts, mask, _ = levels[h]
            below, mask_below, pattern = levels[h - 1]
            first = np.searchsorted(below, starts)
            last = np.r_[first[1:], len(below)]
            many = last[group] - first[group]
            up = np.repeat(np.arange(len(group)), many)
            child = first[group][up] + np.arange(len(up)) - np.repeat(np.cumsum(many) - many, many)
            # Only codes after the one that searches are wanted, so groups that end before it go too.
            wanted = np.r_[below[1:], n][child] > code[up] + 1
            up, child = up[wanted], child[wanted]
            own = mask_below[child] & ~mask[group[up]]
            told = apart[up] + np.bitwise_count((codes[code[up]] ^ pattern[child]) & own)
            near = told <= most
            code, group, apart = code[up[near]], child[near], told[near]
        later = group > code
        yield code[later], group[later]
        at = end


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest that ties places below n as the links (a, b) do: each place that isn't its component's first, and that."""
    top = np.arange(n)
    while len(a):
        x, y = top[a], top[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (jumped := top[top]).tobytes() != top.tobytes():
            top = jumped
    tied = np.flatnonzero(top != np.arange(n))
    return tied, top[tied]


def _searched(codes: np.ndarray, node: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    signed = codes.view(np.int64)
    for i, j in linked_pairs(codes, node, most):
        places, ends = np.unique(np.r_[i, j], return_inverse=True)
        a, b = forest(len(places), ends[: len(i)], ends[len(i) :])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(signed[places[a]]), pa.array(signed[places[b]])], ["a", "b"])


def _in_nodes(rows: DataFrame, most: int) -> DataFrame:
    """A forest over the links in each node of rows (mask, key, code), as far as one piece of work has it whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0

        def ready(parts: list[np.ndarray], whole: bool) -> tuple[np.ndarray, int]:
            rows = np.concatenate(parts, axis=1)
            new = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            ends = np.flatnonzero(new)
            return rows, rows.shape[1] if whole else int(ends[-1]) + 1 if len(ends) else 0

        def search(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            codes = rows[2].view(np.uint64)
            node = np.cumsum(np.r_[0, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
            order = np.lexsort((gray_rank(codes), node))
            yield from _searched(codes[order], node[order], most)

        for batch in batches:
            if batch.num_rows:
                kept.append(np.stack([batch.column(c).to_numpy() for c in ("mask", "key", "code")]))
                held += batch.num_rows
            if held >= PIECE:
                rows, upto = ready(kept, whole=False)
                if upto:
                    yield from search(rows[:, :upto].copy())
                kept, held = [rows[:, upto:].copy()], rows.shape[1] - upto
        if held:
            yield from search(ready(kept, whole=True)[0])

    return rows.repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "key", "code").mapInArrow(run, "a long, b long")


def _in_large_nodes(rows: DataFrame, most: int, block_rows: int) -> DataFrame:
    """The same for nodes of any size, cut into blocks in Gray order, which face each other two by two."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = gray_rank(batch.column("code").to_numpy().view(np.uint64)) >> np.uint64(1)
            yield batch.append_column("place", pa.array(place.view(np.int64)))

    rows = rows.select("mask", "key", "code").mapInArrow(ranked, "mask long, key long, code long, place long")
    rows = rows.repartitionByRange("mask", "key", "place", "code").sortWithinPartitions("mask", "key", "place", "code").withColumn("part", F.spark_partition_id())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, kept = 0, np.empty((3, 0), np.int64)

        def cutting(rows: np.ndarray, last: bool) -> Iterator[np.ndarray]:
            turns = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            edges = [0, *turns.tolist(), rows.shape[1]]
            for a, z in zip(edges, edges[1:]):
                full = z < rows.shape[1] or last
                for at in range(a, z if full else z - (z - a) % block_rows, block_rows):
                    yield rows[:, at : min(at + block_rows, z)]
            rest = 0 if last else (edges[-1] - edges[-2]) % block_rows
            yield rows[:, rows.shape[1] - rest :]  # what stays for the next batch

        def told(part: int, block: np.ndarray) -> pa.RecordBatch:
            codes = block[2].view(np.uint64)
            both, any_ = np.bitwise_and.reduce(codes), np.bitwise_or.reduce(codes)
            values = [block[0, 0], block[1, 0], part << 32 | made, int((~(both ^ any_)).view(np.int64)), int(both.view(np.int64))]
            return pa.RecordBatch.from_arrays([*[pa.array([int(v)], pa.int64()) for v in values], pa.array([codes.tobytes()], pa.binary())], ["mask", "key", "block", "same", "pattern", "codes"])

        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            rows = np.concatenate([kept, np.stack([batch.column(c).to_numpy() for c in ("mask", "key", "code")])], axis=1)
            *whole, kept = cutting(rows, last=False)
            for block in whole:
                yield told(part, block)
                made += 1
        if kept.shape[1]:
            for block in list(cutting(kept, last=True))[:-1]:
                yield told(part, block)
                made += 1

    cells = cut(rows.mapInArrow(blocks, "mask long, key long, block long, same long, pattern long, codes binary"))
    x, y = cells.alias("x"), cells.alias("y")
    apart = F.bit_count(F.col("x.pattern").bitwiseXOR(F.col("y.pattern")).bitwiseAND(F.col("x.same")).bitwiseAND(F.col("y.same")))
    facing = x.join(y, (F.col("x.mask") == F.col("y.mask")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.block") <= F.col("y.block")) & (apart <= most))
    facing = facing.select(F.col("x.codes").alias("left"), F.when(F.col("x.block") < F.col("y.block"), F.col("y.codes")).alias("right"))

    def face(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right")):
                codes = np.frombuffer(left.as_py() + (right.as_py() or b""), np.uint64)
                codes = codes[np.argsort(gray_rank(codes), kind="stable")]
                yield from _searched(codes, np.zeros(len(codes), np.int64), most)

    return facing.repartition(F.xxhash64("left", "right")).mapInArrow(face, "a long, b long")


def links(codes: DataFrame, most: int = 4, node_rows: int = 4096, deepest: int = 3) -> DataFrame:
    """Ties (a, b), each for a path of links, that tie the distinct codes (code) as all pairs of at most ``most``
    differing bits do."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    level = [signed(m) for m in segments(0, most + 1)]
    rows = codes.select("code", F.explode(F.array(*[F.lit(m).cast("long") for m in level])).alias("mask"))
    found = None
    for depth in range(1, deepest + 1):
        rows = rows.select("mask", F.col("code").bitwiseAND(F.col("mask")).alias("key"), "code")
        large = cut(rows.groupBy("mask", "key").count().where(F.col("count") > node_rows).select("mask", "key"))
        none = large.isEmpty()
        small = rows if none else keep_keys(rows, large, ["mask", "key"], "left_anti")
        here = _in_nodes(small, most)
        found = here if found is None else found.union(here)
        if none:
            return found
        rows = cut(keep_keys(rows, large, ["mask", "key"]))
        if depth < deepest:
            finer = {m: [signed(s) for s in segments(m & _ALL, most + 1)] for m in level}
            chosen = F.create_map(*[x for m, subs in finer.items() for x in (F.lit(m).cast("long"), F.array(*[F.lit(s).cast("long") for s in subs]))])
            rows = rows.select("code", F.explode(chosen[F.col("mask")]).alias("mask"))
            level = [s for subs in finer.values() for s in subs]
    return found.union(_in_large_nodes(rows, most, node_rows))


def near_duplicates(docs: DataFrame, k: int = 4, most: int = 4, node_rows: int = 4096, deepest: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of docs (doc_id, text)."""
    marked = cut(fingerprints(docs, k))
    codes = cut(marked.groupBy("code").agg(F.min("doc_id").alias("first")))
    tops = connected(links(codes.select("code"), most, node_rows, deepest))
    codes = codes.join(tops.withColumnsRenamed({"node": "code", "label": "top"}), "code", "left")
    codes = cut(codes.select("code", "first", F.coalesce("top", "code").alias("top")))
    least = codes.groupBy("top").agg(F.min("first").alias("component_id"))
    ids = codes.join(least, "top").select("code", "component_id")
    out = marked.join(ids, "code")
    return out.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
