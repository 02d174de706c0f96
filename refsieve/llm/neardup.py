"""Operator 2: exact n-gram Jaccard join by a token-group matrix.

Documents are sets of hashed ``K``-word shingles; two link when
5 * |x & y| >= 4 * |x | y|. Every link's two ends get the same component.

1. One scan of the texts writes, for each document, its set's size, a 128-bit
   digest, 12 minhashes and the set's tokens. Equal sets are one class; only
   classes go on, and texts are not read again.
2. Classes that share a band of minhashes are checked against the band's few
   leaders. The links found make groups of similar classes, each connected.
3. The matrix: groups are cut into blocks of about ``BLOCK`` members, and each
   block's token union is written. A lone class is a block whose union is its set.
4. Prefix filtering bounds which groups a query can meet, and loses no link: under
   one global token order, linked sets share a token among their first
   n - ceil(0.8 n) + 1. Only tokens of two or more groups count, and the smaller
   group's members are the queries.
5. A query's overlap with the stored union of a block bounds its links there: the
   block opens for it only if the union holds 0.8 of the query. Members of opened
   blocks are read and compared until one link is found: a group is connected, so
   one link joins it whole. A query meets one block of a group first; the others
   are tried for those that are still apart.

The token order puts often repeated tokens last. They are counted in the scan,
within windows of the input; which of them are listed changes only the speed,
never the links. Sets are stored as 48 bits a token: two texts' tokens still
differ but for a chance of about 1e-9 a pair.

Null or empty texts, and texts without words, have an empty set and link with
nothing; so do rows with a null id, whose component is null. Repeated rows are
equal sets. Rows that share an id but not a text are separate sets under one
id. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from refsieve.llm.common import broadcast_if_small, rows_of, send, shingle_set, tidied, written
from refsieve.llm.graph import components

K = 5
BANDS, PER_BAND, LEADERS = 6, 2, 6
#: Minhashes of a pair that must agree before it is checked as a group link; a missed one is found in step 4.
AGREE = 6
BLOCK = 64
#: Queries that one task checks against one copy of a block.
QUERIES_PER_SALT = 128
#: Bytes of a row in a broadcast hash table: of a request for a set, of a lone token.
REQUEST_BYTES, TOKEN_BYTES = 320, 64
#: Tokens listed as often repeated: a fixed memory of 5 MB, and only an order.
FREQUENT = 300_000
WINDOW_TOKENS, WINDOW_COUNT = 500_000, 3
#: Classes whose set a task remembers to have written already; a forgotten one is written again.
REMEMBERED = 100_000

_LANES = np.random.default_rng(7).integers(1, 2**63, (BANDS * PER_BAND, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def digest(tokens: np.ndarray) -> bytes:
    """128 bits of a set, whatever its order: a sum and an xor of differently multiplied tokens."""
    one = (tokens * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(3)
    two = tokens * np.uint64(0xA0761D6478BD642F)
    return np.array([one.sum(dtype=np.uint64), np.bitwise_xor.reduce(two ^ (two >> np.uint64(29))) if len(two) else 0], np.uint64).tobytes()


def minhashes(tokens: np.ndarray) -> bytes:
    return ((tokens[None, :] * _LANES) >> np.uint64(32)).min(axis=1).astype("<u4").tobytes()


def short(tokens: np.ndarray) -> np.ndarray:
    """The upper 48 bits of each token, in order."""
    return tokens >> np.uint64(16)


def packed_set(tokens: np.ndarray) -> bytes:
    """Sorted 48-bit tokens as the bytes of their gaps, one significance after the other: the upper ones compress."""
    gaps = np.diff(tokens, prepend=np.uint64(0)).astype("<u8")
    return gaps.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def unpacked_set(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def required(n: int) -> int:
    """ceil(0.8 n): the overlap without which a set of n tokens has no link."""
    return (4 * n + 4) // 5


def prefix(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 tokens in the global order: unlisted ones by hash, then listed ones from rare to often."""
    level = np.zeros(len(tokens), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        listed = frequent[at] == tokens
        level[listed] = rank[at[listed]] + 1
    return tokens[np.lexsort((tokens, level))[: len(tokens) - required(len(tokens)) + 1]]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays of distinct values."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    total = len(a) + len(b)
    return 9 * min(len(a), len(b)) >= 4 * total and 9 * overlap(a, b) >= 4 * total


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.binary()), ("mh", pa.binary()), ("rid", pa.int64()), ("tokens", pa.binary()), ("tok", pa.list_(pa.int64())), ("cnt", pa.list_(pa.int64()))])
SKETCH_DDL = "doc_id bigint, n bigint, cid binary, mh binary, rid bigint, tokens binary, tok array<bigint>, cnt array<bigint>"


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document (doc_id, text); besides, rows with the tokens repeated within a window of the input, and how often.

    The first documents of a set in a task carry its tokens and a number of their own, ``rid``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, window, held, size = [], {}, 0, 0
        seen: set[bytes] = set()
        rid = int.from_bytes(os.urandom(8), "little", signed=True) >> 1
        for key, text in rows_of(batches):
            tokens = shingle_set(text, k)
            cid = digest(tokens)
            tokens, row = short(tokens), (key, len(tokens), cid)
            if len(tokens) and cid not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(cid)
                rid += 1
                rows.append((*row, minhashes(tokens), rid, packed_set(tokens), None, None))
                size += len(tokens)
            else:
                rows.append((*row, None, None, None, None, None))
            if cid not in window:
                window[cid] = tokens
                held += len(tokens)
            if held >= WINDOW_TOKENS or size >= WINDOW_TOKENS or len(rows) >= 4096:
                if held >= WINDOW_TOKENS:
                    rows.append(_repeated(window))
                    window, held = {}, 0
                yield _batch(rows, SKETCH)
                rows, size = [], 0
        if window:
            rows.append(_repeated(window))
        if rows:
            yield _batch(rows, SKETCH)

    return docs.mapInArrow(tidied(run), SKETCH_DDL)


def _repeated(window: dict[bytes, np.ndarray]) -> tuple:
    tokens, counts = np.unique(np.concatenate(list(window.values())), return_counts=True)
    often = counts >= WINDOW_COUNT
    return None, None, None, None, None, None, tokens[often].view(np.int64), counts[often]


def frequent_tokens(sketched: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT most repeated tokens, sorted, and each one's rank from rare to often."""
    counted = sketched.where("tok is not null").select(F.explode(F.arrays_zip("tok", "cnt")).alias("x")).groupBy(F.col("x.tok").alias("tok")).agg(F.sum("x.cnt").alias("n"))
    rows = counted.orderBy(F.desc("n"), "tok").limit(FREQUENT).select("tok").toArrow()
    tokens = rows.column("tok").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], (len(tokens) - 1 - order).astype(np.int64)


def sets_of(sketched: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests``, a written table with ``rid``, and the tokens that each asks for."""
    held = sketched.where("rid is not null").select("rid", "tokens")
    return held.join(broadcast_if_small(requests, REQUEST_BYTES), "rid")


CHECKED = "u binary, v binary, rid bigint, block bigint, linked boolean"


def checked(shipped: DataFrame) -> DataFrame:
    """(u, v, rid, block, linked): queries u that link with a block's member, or whose overlap with the union of a block of group v lets it open.

    ``shipped`` has grp, block, salt, side, cid, rid, tokens. Side 0 is a union, side 1 a member (its own union, if
    the only one), side 2 a query. Members are compared until one links; of a union alone, only the bound is told.
    """
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("rid", pa.int64()), ("block", pa.int64()), ("linked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, union, members, rows = None, None, [], []
        for grp, block, salt, side, cid, rid, data in rows_of(batches):
            if (grp, block, salt) != at:
                at, union, members = (grp, block, salt), None, []
            tokens = unpacked_set(data)
            if side == 0:
                union = tokens
            elif side == 1:
                members.append((cid, tokens))
            elif members:
                if any(other != cid and linked(theirs, tokens) for other, theirs in members):
                    rows.append((cid, grp, rid, block, True))
            elif union is not None and overlap(union, tokens) >= required(len(tokens)):
                rows.append((cid, grp, rid, block, False))
            if len(rows) >= 4096:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)

    dealt = shipped.select("grp", "block", "salt", "side", "cid", "rid", "tokens").repartition("grp", "block", "salt").sortWithinPartitions("grp", "block", "salt", "side")
    return dealt.mapInArrow(tidied(run), CHECKED)


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _salts(n: Column) -> Column:
    return F.explode(F.sequence(_long(0), n - 1)).alias("salt")


def node_of(cid: Column) -> Column:
    """A class as a graph vertex. The likely leaders of large bands come first, so that hubs are the smaller ends of edges."""
    low = F.least(*[_lead_order(cid, r) for r in range(LEADERS)])
    return F.concat(F.unhex(F.lpad(F.hex(low), 16, "0")), cid)


def _lead_order(cid: Column, r: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(cid, F.lit(r)), 1)


def group_links(sketched: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) of classes with up to LEADERS classes of each band of minhashes they share.

    A band's leaders are its least classes under as many hashes: in a family of
    which only some pairs link, a class that misses one leader meets others.
    """
    keys = [F.xxhash64(F.lit(i), F.substring("mh", 1 + 4 * PER_BAND * i, 4 * PER_BAND)) for i in range(BANDS)]
    banded = classes.select("rid", "cid", "n", "mh", F.explode(F.array(*keys)).alias("key"))
    least = [F.min(F.struct(_lead_order(F.col("cid"), r).alias("h"), "cid", "rid", "n", "mh")) for r in range(LEADERS)]
    leads = banded.groupBy("key").agg(F.array_distinct(F.transform(F.array(*least), lambda x: F.struct(x["cid"].alias("cid"), x["rid"].alias("rid"), x["n"].alias("n"), x["mh"].alias("mh")))).alias("leads"), F.count("*").alias("many"))
    leads = written(leads.where("many > 1").select("key", "leads", F.ceil(F.col("many") / QUERIES_PER_SALT).alias("salts")), "leads")
    met = banded.join(leads, "key").select("rid", "cid", "n", "mh", "salts", F.explode("leads").alias("lead"))
    agree = sum(F.when(F.substring("mh", 1 + 4 * i, 4) == F.substring("lead.mh", 1 + 4 * i, 4), 1).otherwise(0) for i in range(BANDS * PER_BAND))
    close = (F.col("cid") != F.col("lead.cid")) & (agree >= AGREE) & F.expr("9 * least(n, lead.n) >= 4 * (n + lead.n)")
    # A band's count bounds a leader's queries there. Its copies are as many as its largest band asks for; queries of others are dealt among the first.
    met = met.where(close).groupBy("cid", F.col("lead.cid").alias("grp")).agg(F.min("rid").alias("rid"), F.min("lead.rid").alias("its"), F.min("salts").alias("salts"))
    asked = written(met, "pairs")
    copies = asked.groupBy("grp", "its").agg(F.max("salts").alias("salts"))
    queries = asked.select("rid", "cid", "grp", F.pmod(F.xxhash64("cid"), "salts").alias("salt"), _long(2).alias("side"))
    own = copies.select(F.col("its").alias("rid"), F.col("grp").alias("cid"), "grp", _salts(F.col("salts")), _long(1).alias("side"))
    requests = written(queries.union(own).withColumn("block", _long(0)), "requests")
    return checked(sets_of(sketched, requests)).select("u", "v")


def unions(sketched: DataFrame, grouped: DataFrame) -> DataFrame:
    """The matrix: (grp, block, tokens) with the token union of each block of the groups of several members."""
    schema = pa.schema([("grp", pa.binary()), ("block", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, []

        def row() -> pa.RecordBatch:
            return _batch([(*at, packed_set(np.unique(np.concatenate(sets))))], schema)

        for grp, block, data in rows_of(batches):
            if (grp, block) != at:
                if sets:
                    yield row()
                at, sets = (grp, block), []
            sets.append(unpacked_set(data))
        if sets:
            yield row()

    asked = written(grouped.where("members > 1").select("rid", F.col("g").alias("grp"), "block"), "matrix-members")
    dealt = sets_of(sketched, asked).select("grp", "block", "tokens").repartition("grp", "block").sortWithinPartitions("grp", "block")
    return written(dealt.mapInArrow(tidied(run), "grp binary, block bigint, tokens binary"), "matrix")


def prefixes(sketched: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(rid, prefix) of every stored set."""
    sent = send(sketched.sparkSession, frequent)
    schema = pa.schema([("rid", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for rid, data in rows_of(batches):
            rows.append((rid, prefix(unpacked_set(data), *sent()).view(np.int64)))
            if len(rows) >= 1024:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)

    return sketched.where("rid is not null").select("rid", "tokens").mapInArrow(tidied(run), "rid bigint, prefix array<bigint>")


def candidates(first: DataFrame) -> DataFrame:
    """(rid, cid, grp, blocks): queries, and the other groups, of so many blocks, that share enough of their prefix tokens."""
    tokens = first.select(F.explode("prefix").alias("t"), F.xxhash64("g").alias("gl"))
    contested = written(tokens.groupBy("t").agg(F.min("gl").alias("lo"), F.max("gl").alias("hi")).where("lo <> hi").select("t"), "contested")
    rows = first.select("rid", "cid", "n", "g", "members", F.posexplode("prefix").alias("pos", "t")).join(broadcast_if_small(contested, TOKEN_BYTES), "t")
    rows = written(rows, "contested-rows")
    # The first token that linked sets of n and m tokens share has at least 4/9 (n + m) tokens from it on in either set, so
    # only such tokens bring a pair together. ``reach`` is the most that a group's members leave on that side of the bound.
    groups = rows.groupBy("t", F.col("g").alias("grp"), F.col("members").alias("theirs")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.expr("5 * n - 9 * pos")).alias("reach"))
    sized = "g <> grp and (members < theirs or (members = theirs and g < grp)) and 4 * n <= 5 * high and 4 * low <= 5 * n"
    pairs = rows.join(groups, "t").where(f"{sized} and reach >= 4 * n and 5 * n - 9 * pos >= 4 * greatest(low, (4 * n + 4) div 5)")
    met = written(pairs.groupBy("rid", "cid", "n", "g", "grp", "theirs").agg(F.max("high").alias("high")), "met")
    # A pair of lone classes is then counted over its whole prefixes. Tokens that both have up to where the first of the
    # prefixes ends are in both; what follows is at most the rest of that set. A group is bounded by its blocks' unions.
    held = written(rows.where("members = 1").groupBy("g").agg(F.collect_list("t").alias("held")), "held")
    lone = met.where("theirs = 1").join(held, "g").join(held.select(F.col("g").alias("grp"), F.col("held").alias("their")), "grp")
    lone = lone.where("9 * (size(array_intersect(held, their)) + greatest((4 * n + 4) div 5, (4 * high + 4) div 5) - 1) >= 4 * (n + high)")
    return lone.select(met.columns).union(met.where("theirs > 1")).select("rid", "cid", "g", "grp", F.ceil(F.col("theirs") / BLOCK).alias("blocks"))


def group_pairs(sketched: DataFrame, grouped: DataFrame, matrix: DataFrame, asked: DataFrame) -> DataFrame:
    """(u, v): groups joined by a link of a query of ``asked`` (rid, cid, g, grp, block) with a member of that block.

    Blocks with many queries are repeated, so that no task gets more than about QUERIES_PER_SALT for one.
    """

    def dealt(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        counts = written(asked.groupBy("grp", "block").agg(F.ceil(F.count("*") / QUERIES_PER_SALT).alias("salts")), "asked-blocks")
        busy = counts.where("salts > 1")
        queries = asked.join(busy, ["grp", "block"], "left").select("rid", "cid", "grp", "block", F.pmod(F.xxhash64("cid"), F.coalesce("salts", _long(1))).alias("salt"), _long(2).alias("side"))
        return queries, counts

    members = grouped.select("rid", "cid", F.col("g").alias("grp"), "block", "members")
    queries, counts = dealt(asked)
    lone = members.where("members = 1").join(counts, ["grp", "block"]).select("rid", "cid", "grp", "block", _salts(F.col("salts")), _long(1).alias("side"))
    columns = ["grp", "block", "salt", "side", "cid", "rid", "tokens"]
    bounds = matrix.join(counts, ["grp", "block"]).select("grp", "block", _salts(F.col("salts")), _long(0).alias("side"), F.lit(None).cast("binary").alias("cid"), F.lit(None).cast("bigint").alias("rid"), "tokens")
    found = written(checked(sets_of(sketched, written(queries.union(lone), "requests")).select(columns).union(bounds)), "bounded")
    queries, counts = dealt(found.where("not linked").select("rid", F.col("u").alias("cid"), F.col("v").alias("grp"), "block"))
    opened = members.join(counts, ["grp", "block"]).select("rid", "cid", "grp", "block", _salts(F.col("salts")), _long(1).alias("side"))
    links = found.where("linked").select("u", "v").union(checked(sets_of(sketched, written(queries.union(opened), "opened"))).select("u", "v"))
    return written(links.join(asked.select("cid", "g").distinct(), F.col("u") == F.col("cid")).select(F.col("g").alias("u"), "v").distinct(), "group-links")


def classes_of(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The sketch of every document, and (cid, root, component_id) of every class of equal sets: ids may repeat, roots name one component."""
    sketched = written(sketch(docs.where("doc_id is not null"), k), "sketch")
    named = sketched.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("rid").alias("rid"), F.min("mh").alias("mh"))
    classes = written(named, "classes")
    links = group_links(sketched, classes)
    stars = components(links.select(node_of(F.col("u")).alias("u"), node_of(F.col("v")).alias("v")))
    stars = stars.select(F.substring("node", 9, 16).alias("cid"), F.substring("root", 9, 16).alias("g"))

    placed = classes.join(stars, "cid", "left").select("rid", "cid", "n", "doc_id", F.coalesce("g", "cid").alias("g"))
    sizes = written(stars.groupBy("g").agg(F.count("*").alias("members")), "sizes")
    grouped = placed.join(sizes, "g", "left").withColumn("members", F.coalesce("members", _long(1)))
    grouped = written(grouped.withColumn("block", F.pmod(F.xxhash64("cid"), F.ceil(F.col("members") / BLOCK))), "groups")
    matrix = unions(sketched, grouped)
    first = written(prefixes(sketched, frequent_tokens(sketched)).join(grouped.select("rid", "cid", "n", "g", "members"), "rid"), "prefixes")
    met = written(candidates(first).withColumn("block", F.pmod(F.xxhash64("cid", "grp"), F.col("blocks"))), "candidates")

    links = group_pairs(sketched, grouped, matrix, met.select("rid", "cid", "g", "grp", "block"))
    joined = components(links)
    rest = met.where("blocks > 1")
    if rest.limit(1).count():
        root = joined.select(F.col("node").alias("grp"), F.col("root").alias("its"))
        apart = rest.join(joined.withColumnRenamed("node", "g"), "g", "left").join(root, "grp", "left").where("not coalesce(root, g) <=> coalesce(its, grp)")
        others = apart.select("rid", "cid", "g", "grp", "block", F.explode(F.sequence(_long(0), F.col("blocks") - 1)).alias("other")).where("other <> block")
        more = group_pairs(sketched, grouped, matrix, written(others.select("rid", "cid", "g", "grp", F.col("other").alias("block")), "others"))
        joined = components(joined.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))

    rooted = grouped.join(joined.withColumnRenamed("node", "g"), "g", "left").select("cid", "doc_id", F.coalesce("root", "g").alias("root"))
    rooted = written(rooted, "rooted")
    least = written(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return sketched, written(rooted.join(least, "root").select("cid", "root", "component_id"), "components")


def join(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched, named = classes_of(source, k)
    rows = sketched.where("tok is null").select("doc_id", "n", "cid")
    out = rows.join(named, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    nameless = sketch(source.where("doc_id is null"), k).where("tok is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"))
    return out.union(nameless)


def keep_one(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each group: that of the least id.

    Documents without shingles or id stay. Where rows of a group share its least
    id, the set of the least digest stays, and of equal sets the row that comes
    first as JSON; rows of that id in other groups are judged there.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched, named = classes_of(source, k)
    rows = sketched.where("tok is null").select("doc_id", "n", "cid").join(named, "cid", "left")
    ids = written(rows.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.max("n").alias("size"), F.count("*").alias("copies")), "ids")
    gone = written(ids.where("copies = 1 and size > 0 and least <> doc_id").select(F.col("doc_id").alias("__refsieve_gone")), "gone")
    kept = docs.join(broadcast_if_small(gone, TOKEN_BYTES), docs[id_col].cast("bigint") == F.col("__refsieve_gone"), "left_anti")
    repeated = written(ids.where("copies > 1").select(F.col("doc_id").alias("__refsieve_twice")), "twice")
    if not repeated.limit(1).count():
        return kept
    same = kept[id_col].cast("bigint") == F.col("__refsieve_twice")
    twice = with_digest(kept.join(repeated, same, "left_semi"), k, text_col)
    best = rows.where("n > 0").groupBy("root").agg(F.min(F.struct("doc_id", "cid")).alias("best")).select(F.col("best.doc_id").alias("__refsieve_id"), F.col("best.cid").alias("__refsieve_best"))
    picked = twice.join(best, (twice[id_col].cast("bigint") == F.col("__refsieve_id")) & (F.col("__refsieve_cid") == F.col("__refsieve_best")), "left_semi")
    whole = F.struct(*docs.columns)
    picked = picked.groupBy(F.col(id_col).alias("__refsieve_id"), "__refsieve_cid").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return kept.join(repeated, same, "left_anti").unionByName(picked).unionByName(twice.where("__refsieve_cid is null").drop("__refsieve_cid"))


def with_digest(docs: DataFrame, k: int, text_col: str) -> DataFrame:
    """``docs`` with the digest of each row's set as __refsieve_cid, null if the set is empty."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_set(None if (text := v.as_py()) is None else str(text), k) for v in batch.column(at))
            yield batch.append_column("__refsieve_cid", pa.array([digest(s) if len(s) else None for s in sets], pa.binary()))

    return docs.mapInArrow(tidied(run), StructType([*docs.schema.fields, StructField("__refsieve_cid", BinaryType())]))
