"""Operator 11: SimHash near duplicates by a byte-position inverted index with count filtering.

A fingerprint is 8 bytes. Two that differ in at most ``MOST`` = 4 bits differ in at
most 4 bytes, so they share at least 4 positional bytes: that is the least count a
pair must reach. The index lists fingerprints by their positional bytes. As one
byte has only 256 values, its list is refined by two more: of any 7 positions a
pair shares 3 at least, so it meets in a list of three positional bytes, of which
each fingerprint is in ``LISTS`` = 35.

1. One scan of the texts gives each document its fingerprint; equal ones are one row from here on.
2. Each list's leader, its least fingerprint under a hash, is compared with all
   of the list, as a join; components of these links are made. A list of two
   rows is done with that.
3. A list whose rows are not all in one component is counted in full: the rows of
   its largest component are its members, all others its queries. Both are dealt in
   blocks of about ``BLOCK``, each block of queries against each of members and
   of other queries; a task tallies the positional bytes each pair shares, keeps
   pairs that reach 4, and verifies their bits. It gives back pairs of components only.

So a group of near copies, whatever its size, is compared with its leaders and
not among itself, and no list is in one task. No link is lost.

Null or empty texts and texts without words have the fingerprint zero and link
like any other. Rows with a null id link, too, but never name a component, which
is null if no row of it has an id. Rows that share an id are rows of their own,
whose components may differ. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import LOWER, map_rows, mix, tidied, utf8, word_spans, written
from refsieve.llm.graph import components

K, SEED = 4, 42
MOST, BYTES = 4, 8
#: Positional bytes that a pair shares at least, and of which a list's key is made.
SHARED, KEYED = BYTES - MOST, 3
#: Every pair shares KEYED of any so many positions; each choice of KEYED of these has its lists.
POSITIONS = BYTES - SHARED + KEYED
MASKS = [sum(0xFF << (8 * p) for p in chosen) for chosen in combinations(range(POSITIONS), KEYED)]
LISTS = len(MASKS)
#: Rows of a block of a list.
BLOCK = 2048


def fingerprint(text: str | None, k: int = K, step: int = 20_000) -> int:
    """64 bits, each set if more than half of the text's shingle hashes have it; 0 without words. Long texts are hashed in runs of ``step`` words."""
    words = utf8(text).translate(LOWER).split()
    if not words:
        return 0
    total, counts = 0, np.zeros(64, np.int64)
    for at in range(0, max(1, len(words) - k + 1), step):
        data, starts, ends = word_spans(words[at : at + step + k - 1])
        spans = zip(starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True) if len(starts) >= k else [(0, len(data))]
        hashes = np.array([xxhash.xxh64_intdigest(data[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, node) of every row of (doc_id, text). A node names a fingerprint and is as good as random, so that leaders are spread and number low."""

    def row(key: int | None, text: str | None) -> tuple:
        bits = fingerprint(text)
        return key, signed(bits), int(mix(np.array([bits], np.uint64)).view(np.int64)[0])

    return map_rows(docs, row, "doc_id bigint, fp bigint, node bigint")


def listed(rows: DataFrame) -> DataFrame:
    """``rows`` once for each of their lists: (key, fp, node, ...), key being which three positions, and their bytes."""
    keys = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("i"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bytes")) for i, m in enumerate(MASKS)])
    return rows.withColumn("key", F.explode(keys))


def lead_links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) of fingerprints with the leader of a list they share."""
    lists = listed(distinct)
    leads = lists.groupBy("key").agg(F.min("node").alias("lead"), F.min_by("fp", "node").alias("its"), F.count("*").alias("n")).where("n > 1").select("key", "lead", "its")
    met = lists.join(written(leads, "simhash-leads"), "key")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("its"))) <= MOST
    return met.where((F.col("node") != F.col("lead")) & close).select(F.col("node").alias("u"), F.col("lead").alias("v")).distinct()


def _blocks(n: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.lit(1).cast("bigint"))


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))


def split_lists(rooted: DataFrame) -> DataFrame:
    """(root, other): components linked across, from the lists that several components share. ``rooted`` has fp, node, root."""
    lists = listed(rooted)
    shares = lists.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("key").agg(F.max_by("root", "n").alias("top"), F.max("n").alias("most"), F.sum("n").alias("size")).where("size > 2 and most < size")
    mixed = written(mixed.select("key", "top", "size", (F.col("size") - F.col("most")).alias("others")), "simhash-mixed")
    rows = lists.join(mixed, "key").withColumns({"queries": _blocks(F.col("others")), "members": _blocks(F.col("size")), "salt": F.shiftrightunsigned("node", 1)})
    # A row is a member in its block against every block of queries, and, outside the largest component, a query in its block against every one of members.
    member = rows.select("key", F.pmod("salt", "members").alias("at"), _each(F.col("queries")).alias("against"), F.lit(0).alias("side"), "fp", "root")
    query = rows.where("root <> top").select("key", _each(F.col("members")).alias("at"), F.pmod("salt", "queries").alias("against"), F.lit(1).alias("side"), "fp", "root")
    dealt = member.union(query).select(F.xxhash64("key", "at", "against").alias("cell"), "key.i", "key.bytes", "at", "against", "side", "fp", "root")
    dealt = dealt.repartition("cell").sortWithinPartitions("cell", "i", "bytes", "at", "against", "side")
    schema = pa.schema([("root", pa.int64()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            # cell, i, bytes, at, against, side, fp, root: whole numbers all
            table = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            held.append(table)
            table = np.concatenate(held, axis=1)
            ends = np.flatnonzero((table[:5, 1:] != table[:5, :-1]).any(axis=0)) + 1
            if len(ends):
                yield pairs(table[:, : ends[-1]], ends)
            held = [table[:, ends[-1] if len(ends) else 0 :]]
        if held:
            yield pairs(held[0], np.array([held[0].shape[1]]))

    def pairs(table: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        found = [linked_roots(*table[5:, a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        both = np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)

    return dealt.mapInArrow(tidied(run), "root bigint, other bigint").distinct()


def linked_roots(side: np.ndarray, fp: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Pairs of components that a query and a member of a cell link: first the tally of shared positional bytes, then the bits."""
    members, theirs = fp[side == 0].view(np.uint64), root[side == 0]
    found = [np.empty((0, 2), np.int64)]
    queries, ours = fp[side == 1].view(np.uint64), root[side == 1]
    for at in range(0, len(queries), 256):
        apart = queries[at : at + 256, None] ^ members[None, :]
        tally = sum(((apart >> np.uint64(8 * p)) & np.uint64(0xFF) == 0).view(np.uint8) for p in range(BYTES))
        q, m = np.nonzero(tally >= SHARED)
        q, m = (x[np.bitwise_count(apart[q, m]) <= MOST] for x in (q, m))
        both = np.unique(np.stack([ours[at + q], theirs[m]], axis=1), axis=0)
        found.append(both[both[:, 0] != both[:, 1]])
    return np.concatenate(found)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    rows = written(fingerprints(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))), "simhash")
    distinct = written(rows.groupBy("fp", "node").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    stars = components(lead_links(distinct.select("fp", "node")))
    rooted = written(distinct.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node")), "simhash-rooted")
    joined = components(split_lists(rooted.select("fp", "node", "root")).toDF("u", "v"))
    rooted = written(rooted.join(joined.toDF("root", "its"), "root", "left").withColumn("root", F.coalesce("its", "root")).drop("its"), "simhash-joined")
    least = written(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "simhash-least")
    named = written(rooted.join(least, "root").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
