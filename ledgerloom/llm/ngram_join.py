"""N-gram Jaccard self-join with a token-group matrix: components of near-equal documents, exactly.

A document's set is its distinct 5-word shingles (64-bit hashes). Two documents link when 100 * |both|
>= 75 * |either|. Equal sets are one set from the start. The work then goes:

1. Every set lists its rarest shingles, as many as a partner can't all miss (the prefix filter), in one
   order for all sets: by a count sketch of fixed size over all shingles, then by hash. Listed shingles
   that no other set lists are counted and dropped.
2. That count bounds every pair. Of two sets, the one whose list ends first has all that they share up to
   there among its shared listed shingles, so from their first common one on they share at most those
   left plus what isn't listed. Pairs that can't reach the threshold so are never looked at.
3. Of the sets that share a listed shingle, the one with the fewest shingles of its own is the pivot. A set
   is compared with the PARTNERS pivots that most of its shingles name, first by mark, a bitmap of its
   shingles that bounds what two sets share, then by text. The components so found, and of sets without a
   link those with one pivot, are the groups, dealt into blocks of bounded size.
4. The token-group matrix, stored, holds each block's token union: a row per (listed shingle, block), with
   the best bound of its members. A set meets the blocks of other components through it. Of those whose bound
   qualifies the set's overlap with the union of the members' marks bounds once more, and then with that of
   their whole sets; only what qualifies is opened and compared with the members.

Two linked sets share a listed shingle, so they are in one component after 3, or one of them meets the
other's block in 4: no link between components is missed. A large group costs a comparison with its
pivot per member and not one per pair. A hot shingle is dealt over as many tasks as its level asks.

Defined results: null and blank texts have no shingles and are their own components; fewer than five
words are one shingle; repeated rows link; null doc_ids never become a component's name; an empty table
gives an empty result; other columns are ignored, and kept by keep_first().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_BATCH, broadcast_if_small, connected_components, discard, packed, stored
from .shingles import shingle_sets

PERCENT = 75
#: Counters of the sketch, how many of them a row carries, and tasks that first add up one such row's parts.
SKETCH, SKETCH_ROW, SKETCH_PARTS = 1 << 20, 1 << 12, 16
#: A counter's level is LEVELS times the binary logarithm of its count, rounded down.
LEVELS = 4
#: Sets of one listed shingle that a task takes, by the sketch; a hotter one is dealt over several.
HOT_LOG2 = 17
#: Sets and shingles in a block.
BLOCK, BLOCK_SHINGLES = 64, 1 << 19
#: Sets that one pivot or block is compared with in one stretch.
STRETCH = 512
#: Pivots a set is compared with.
PARTNERS = 2
MAX_BROADCAST = 200_000


def set_id(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that any partner of a set of n must share with it."""
    return -(-PERCENT * n // 100)


def linked(both: int, n: int, m: int) -> bool:
    return 100 * both >= PERCENT * (n + m - both)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def mark_of(shingles: np.ndarray) -> bytes:
    """A set's size and its shingles as bits of a bitmap of twice as many bits or more."""
    n = len(shingles)
    bits = np.zeros(max(64, 1 << (2 * n - 1).bit_length()), bool)
    bits[((shingles >> np.uint64(32)) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return n.to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes()


def may_link(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> bool:
    """Whether sets can link by their marks: shingles of one that share no bit with the other aren't common."""
    (n, x), (m, y) = a, b
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    if len(x) != len(y):  # the larger is folded to the smaller's bits
        size = min(len(x), len(y))
        x, y = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) if len(v) > size else v for v in (x, y))
    both = int(np.bitwise_count(x & y).sum())
    return linked(both + min(n - int(np.bitwise_count(x).sum()), m - int(np.bitwise_count(y).sum())), n, m)


def _marks(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for x in column.to_pylist():
        yield int.from_bytes(x[:8], "little"), np.frombuffer(x, np.uint8, offset=8)


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    return shingle_sets(column.cast(pa.binary()).to_pylist())


def are_linked(a: np.ndarray, b: np.ndarray) -> bool:
    return 100 * min(len(a), len(b)) >= PERCENT * max(len(a), len(b)) and linked(_overlap(a, b), len(a), len(b))


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts + 1.0) * LEVELS, 127).astype(np.uint8)


def sets_of(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text_hash, sid, n, mark) of every row, and the sketch: a level per counter, higher where more sets fall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            sids, sizes, marks = [], [], []
            for s in shingle_sets(_texts(batch, 1)):
                sids.append(set_id(s) if len(s) else None)
                sizes.append(len(s))
                marks.append(mark_of(s) if len(s) else None)
                np.add.at(sketch, (s & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            cols = [batch.column(0), batch.column(2), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.nulls(len(sids), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names)
        parts = [(i, x) for i, x in enumerate(sketch.reshape(-1, SKETCH_ROW)) if x.any()]
        if parts:
            none = [pa.nulls(len(parts), kind) for kind in (id_arrow, pa.int64(), pa.int64(), pa.int64())]
            packed = [shrunk(x).tobytes() for _, x in parts]
            yield pa.RecordBatch.from_arrays([*none, pa.array(packed, pa.binary()), pa.array([i for i, _ in parts], pa.int32())], names)

    def shrunk(counts: np.ndarray) -> np.ndarray:
        """A byte per counter, to within 5 %: the order of shingles needs no more."""
        return np.minimum(np.round(np.log2(counts + 1.0) * 6), 255).astype(np.uint8)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.exp2(np.frombuffer(part, np.uint8) / 6.0) - 1
                sums[at] = sums[at] + x if at in sums else x
        if sums:
            packed = [shrunk(x).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["at", "part"])

    names = ["doc_id", "text_hash", "sid", "n", "part", "at"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    id_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    out = stored(rows.mapInArrow(run, f"doc_id {id_type}, text_hash long, sid long, n long, part binary, at int"), "sets", TEXT_BATCH)
    parts = out.where("at is not null").select("at", "part")
    for key in (["at", F.pmod(F.xxhash64("part"), F.lit(SKETCH_PARTS))], ["at"]):
        parts = parts.repartition(*key).mapInArrow(add, "at int, part binary")
    levels = np.zeros(SKETCH, np.uint8)
    for r in parts.collect():  # SKETCH bytes, whatever the input's size
        levels[r["at"] * SKETCH_ROW : (r["at"] + 1) * SKETCH_ROW] = _level(np.exp2(np.frombuffer(r["part"], np.uint8) / 6.0) - 1)
    return out.where("at is null").select("doc_id", "text_hash", "sid", "n", F.col("part").alias("mark")), levels


def _tasks(token: Column) -> Column:
    """Tasks over which a token's sets are dealt: 1 unless its level shows more than 2**HOT_LOG2 of them."""
    log2 = F.shiftright(token, 56) / F.lit(float(LEVELS))
    return F.greatest(F.lit(1), F.ceil(F.pow(F.lit(2.0), log2 - HOT_LOG2)).cast("int"))


def lists_of(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(sid, n, r, rest, tokens): each set's listed shingles that another set lists too, in the common order.

    A token is a shingle's level and 56 bits of its hash, so tokens sort in the order that all sets share. ``r``:
    first 16 bits of the last listed token. ``rest``: shingles that aren't listed. Sets that share none are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # of fixed size

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = shared.value, set()
        for batch in batches:
            tokens, sids, sizes = [], [], []
            for s in shingle_sets(_texts(batch, 0)):
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()  # repeats that slip through are dropped after the sort
                seen.add(sid)
                k = len(s) - least_overlap(len(s)) + 1
                rank = level[(s & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64)
                t = np.partition((rank << np.uint64(56)) | (s >> np.uint64(8)), k - 1)[:k].view(np.int64)
                tokens.append(t)
                sids.append(np.full(k, sid, np.int64))
                sizes.append(np.full(k, len(s) << 16 | int(t[k - 1]) >> 48, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, sids, sizes)], ["token", "sid", "size"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a sorted partition whose token has another set; the last row waits for the next batch."""
        held, held_met = np.empty((3, 0), np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate((held, np.stack([batch.column(i).to_numpy() for i in range(3)])), axis=1)
            t, s = rows[:2]
            rows = rows[:, np.concatenate(([True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])))]
            t = rows[0]
            same = t[1:] == t[:-1]
            with_before = np.concatenate(([held_met], same))
            hot = (t >> 56) >= hot_level
            keep = (with_before | np.concatenate((same, [False])) | hot)[:-1]
            held, held_met = rows[:, -1:], bool(with_before[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in rows], ["token", "sid", "size"])
        if held.shape[1] and (held_met or held[0, 0] >> 56 >= hot_level):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["token", "sid", "size"])

    hot_level = HOT_LOG2 * LEVELS + 1  # such tokens may be in several tasks, so all their rows stay
    schema = "token long, sid long, size long"
    rows = docs.select("text").mapInArrow(listed, schema)
    rows = rows.repartition("token", F.pmod("sid", _tasks(F.col("token")))).sortWithinPartitions("token", "sid")
    lists = rows.mapInArrow(met, schema).groupBy("sid").agg(F.first("size").alias("size"), F.collect_list("token").alias("tokens"))
    n = F.shiftright("size", 16)
    return stored(
        lists.select(
            "sid",
            n.cast("int").alias("n"),
            F.col("size").bitwiseAND(0xFFFF).cast("int").alias("r"),
            (F.ceil(n * PERCENT / 100) - 1).cast("int").alias("rest"),
            F.array_sort("tokens").alias("tokens"),
        ),
        "lists",
        TEXT_BATCH,
    )


def shared_rows(lists: DataFrame) -> DataFrame:
    """(token, sid, n, r, rest), a row per listed token; ``rest``: what the set can share from that token on, if its list ends first."""
    rows = lists.select("sid", "n", "r", F.col("rest").alias("unlisted"), F.size("tokens").alias("k"), F.posexplode("tokens").alias("at", "token"))
    return rows.select("token", "sid", "n", "r", (F.col("unlisted") + F.col("k") - F.col("at")).cast("int").alias("rest"))


def pivots_of(lists: DataFrame) -> DataFrame:
    """(a, b, place): of each set a the pivots b that most of its tokens name, among those it may link with; place from 1."""
    rows = shared_rows(lists)
    own = F.floor(1000 * (F.col("n") - F.col("rest")) / F.col("n")).cast("int")  # at a set's first token: thousandths that nobody shares
    rows = rows.withColumn("own", own).repartition("token", F.pmod("sid", _tasks(F.col("token"))))
    rows = rows.sortWithinPartitions("token", "own", "n", "sid").select("token", "sid", "n", "r", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.empty((5, 0), np.int64)  # the open run's first row
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate((pivot, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)])), axis=1)
            begin = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))
            of = np.repeat(begin, np.diff(np.concatenate((begin, [rows.shape[1]]))))
            pivot = rows[:, begin[-1] : begin[-1] + 1]
            _, a, n, r, rest = rows
            _, b, m, q, left = rows[:, of]
            bound = np.where(r < q, rest, np.where(r > q, left, np.maximum(rest, left)))
            ok = (a != b) & ((100 + PERCENT) * bound >= PERCENT * (n + m))
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    votes = rows.mapInArrow(run, "a long, b long").groupBy("a", "b").agg(F.count("*").alias("votes"))
    order = Window.partitionBy("a").orderBy(F.desc("votes"), "b")
    return stored(votes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PARTNERS).select("a", "b", "place"), "pivots")


def compare(pairs: DataFrame, held: DataFrame, read: Callable, test: Callable) -> DataFrame:
    """The (a, b) of ``pairs`` that pass ``test``. held: (sid, x), of which ``read`` makes what ``test`` compares.

    Rows go to their pair's b, in stretches of bounded size, b's own first; a task holds one set and streams
    the others past it.
    """
    load = pairs.groupBy("b").agg(F.ceil(F.count("*") / STRETCH).cast("int").alias("parts"))
    many = broadcast_if_small(load.where("parts > 1").withColumnRenamed("b", "b_"), MAX_BROADCAST)
    at = pairs.join(many, F.col("b") == F.col("b_"), "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int"))
    at = at.select("a", "b", "part")
    others = held.join(broadcast_if_small(at, MAX_BROADCAST), F.col("sid") == F.col("a")).select("b", "part", F.lit(1).alias("side"), "a", "x")
    own = load.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("b", "part")
    own = held.join(broadcast_if_small(own, MAX_BROADCAST), F.col("sid") == F.col("b")).select("b", "part", F.lit(0).alias("side"), F.col("b").alias("a"), "x")
    rows = own.unionByName(others).repartition("b", "part").sortWithinPartitions("b", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_x = None
        for batch in batches:
            a_out, b_out = [], []
            ids = [batch.column(i).to_pylist() for i in (0, 2, 3)]
            for b, side, a, x in zip(*ids, read(batch.column(4)), strict=True):
                if side == 0:
                    own_x = x
                elif own_x is not None and test(x, own_x):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return stored(rows.mapInArrow(run, "a long, b long"), "links", TEXT_BATCH)


def texts_of(docs: DataFrame, sets: DataFrame, sids: DataFrame) -> DataFrame:
    """(sid, x): a text for each of ``sids`` (sid), once for each repeat of the chosen row. Only chosen rows' texts are moved."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    chosen = sets.where("sid is not null").join(broadcast_if_small(sids.distinct(), MAX_BROADCAST), "sid", "left_semi").groupBy("sid").agg(F.min(row).alias("r"))
    chosen = broadcast_if_small(stored(chosen.select("sid", "r.d", "r.h"), "chosen"), MAX_BROADCAST)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("h"))
    return stored(docs.select("doc_id", "text").join(chosen, same).select("sid", F.col("text").alias("x")), "chosen-texts")


def marks_of(sets: DataFrame, lists: DataFrame) -> DataFrame:
    """(sid, x): the mark of each set of ``lists``; copies are combined before the shuffle."""
    some = sets.where("sid is not null").join(broadcast_if_small(lists.select("sid"), MAX_BROADCAST), "sid", "left_semi")
    return stored(some.groupBy("sid").agg(F.min("mark").alias("x")), "marks")


def _labelled(labels: DataFrame, rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the component of ``column``, null where it has no link."""
    at = labels.select(F.col("node").alias("__n"), F.col("component").alias(name))
    return rows.join(broadcast_if_small(at, MAX_BROADCAST), F.col(column) == F.col("__n"), "left").drop("__n")


def _blocks(lists: DataFrame, labels: DataFrame, pivots: DataFrame) -> DataFrame:
    """``lists`` with comp (component, or the set alone), named (whether it has links) and its block: a bounded part of a group."""
    best = pivots.where("place = 1").select(F.col("a").alias("a_"), F.col("b").alias("b_"))
    at = _labelled(labels, lists, "sid", "comp").join(broadcast_if_small(best, MAX_BROADCAST), F.col("sid") == F.col("a_"), "left")
    at = at.withColumn("g", F.coalesce("comp", "b_", F.element_at("tokens", -1))).withColumn("named", F.col("comp").isNotNull())
    at = at.select("sid", "n", "r", "rest", "tokens", F.coalesce("comp", "sid").alias("comp"), "named", F.xxhash64("g", "named").alias("g"))
    parts = at.groupBy("g").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    parts = broadcast_if_small(parts.where("parts > 1").withColumnRenamed("g", "g_"), MAX_BROADCAST)
    at = at.join(parts, F.col("g") == F.col("g_"), "left")
    block = F.xxhash64("g", F.pmod(F.xxhash64("sid"), F.coalesce("parts", F.lit(1))))
    return stored(at.select("sid", "n", "r", "rest", "tokens", "comp", "named", block.alias("block")), "blocks")


def matrix_of(blocks: DataFrame) -> DataFrame:
    """The token-group matrix: per (token, block) the bounds of what its members can share. Parts are combined before the shuffle."""
    rows = blocks.select("block", F.struct("named", "comp").alias("rank"), "n", "r", F.col("rest").alias("unlisted"), F.size("tokens").alias("k"), F.posexplode("tokens").alias("at", "token"))
    left = F.max(F.col("unlisted") + F.col("k") - F.col("at"))
    bounds = [F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("r").alias("r_lo"), F.max("r").alias("r_hi"), left.alias("left"), F.max("rank").alias("top")]
    return stored(rows.groupBy("token", "block").agg(*bounds), "matrix")


def across(docs: DataFrame, sets: DataFrame, marks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Links (a, b) between different components, at least one for each set and component that link, over the token-group matrix."""
    matrix = matrix_of(blocks)
    asked = blocks.select("sid", F.struct("named", "comp").alias("rank"), "n", "r", F.col("rest").alias("unlisted"), F.size("tokens").alias("k"), F.posexplode("tokens").alias("at", "token"))
    asked = asked.select("token", "sid", "rank", "n", "r", (F.col("unlisted") + F.col("k") - F.col("at")).alias("rest"))
    # a set asks blocks of a higher rank only, so a pair is met from one side; the bound is as in pivots_of, for the likeliest member
    sizes = (100 * F.col("hi") >= PERCENT * F.col("n")) & (PERCENT * F.col("lo") <= 100 * F.col("n"))
    least = F.greatest(F.col("lo"), F.ceil(F.col("n") * PERCENT / 100).cast("int"))
    bound = F.greatest(F.when(F.col("r_hi") >= F.col("r"), F.col("rest")).otherwise(0), F.when(F.col("r_lo") <= F.col("r"), F.col("left")).otherwise(0))
    qualifies = (100 + PERCENT) * bound.cast("long") >= PERCENT * (F.col("n") + least).cast("long")
    met = asked.join(matrix, "token").where((F.col("rank") < F.col("top")) & sizes & qualifies)
    open_ = stored(met.select("sid", "block").distinct(), "met")
    discard(matrix)
    if open_.isEmpty():
        return open_.select(F.col("sid").alias("a"), F.col("block").alias("b"))
    rows = _meetings(open_, blocks)
    # marks first, so that texts move only for blocks that a set may link with
    rows = _opened(rows, marks, _marks, may_link, _union_of_marks).select(F.col("a").alias("sid"), F.col("block")).distinct()
    rows = stored(_meetings(stored(rows, "met"), blocks), "opened")
    texts = texts_of(docs, sets, rows.select("sid"))
    out = _opened(rows, texts, _sets, are_linked, _union_of_sets).select("a", "b")
    discard(texts, open_)
    return out


def _meetings(open_: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, part, side, sid, named, comp): of each opened block its members (side 0), then the sets that ask, in stretches."""
    member = blocks.select("sid", "block", "named", "comp")
    load = open_.groupBy("block").agg(F.ceil(F.count("*") / STRETCH).cast("int").alias("parts"))
    load = broadcast_if_small(load, MAX_BROADCAST)
    own = member.join(load, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    ask = open_.join(load, "block").withColumn("part", F.pmod(F.xxhash64("sid"), "parts").cast("int"))
    ask = ask.join(member.drop("block"), "sid")
    side = lambda df, k: df.select("block", "part", F.lit(k).alias("side"), "sid", "named", "comp")
    return side(own, 0).unionByName(side(ask, 1))


def _union_of_marks(held: list[tuple[int, np.ndarray]]) -> Callable:
    """Whether a mark's set may link with a member, by the union of their bits, folded to the smallest."""
    size = min(len(x) for _, x in held)
    union = np.bitwise_or.reduce([np.bitwise_or.reduce(x.reshape(-1, size), axis=0) for _, x in held])

    def qualifies(a: tuple[int, np.ndarray]) -> bool:
        n, x = a
        least = min(size, len(x))
        x, u = (np.bitwise_or.reduce(v.reshape(-1, least), axis=0) for v in (x, union))
        return int(np.bitwise_count(x & u).sum()) + n - int(np.bitwise_count(x).sum()) >= least_overlap(n)

    return qualifies


def _union_of_sets(held: list[np.ndarray]) -> Callable:
    """Whether a set shares enough with the members' token union."""
    union = np.unique(np.concatenate(held))
    return lambda s: _overlap(s, union) >= least_overlap(len(s))


def _opened(rows: DataFrame, held_rows: DataFrame, read: Callable, test: Callable, union_of: Callable) -> DataFrame:
    """(a, b, block): of each set that asks a block, a member of each other component that passes ``test`` with it.

    A set that doesn't reach the threshold with the members' union leaves the block closed.
    """
    at = held_rows.withColumnRenamed("sid", "s_").join(broadcast_if_small(rows, MAX_BROADCAST), F.col("s_") == F.col("sid"))
    at = at.select("block", "part", "side", "sid", "named", "comp", "x").repartition("block", "part").sortWithinPartitions("block", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, qualifies = None, [], None
        for batch in batches:
            found = []
            ids = [batch.column(i).to_pylist() for i in range(6)]
            for block, part, side, sid, named, comp, x in zip(*ids, read(batch.column(6)), strict=True):
                if (block, part) != here:
                    here, held, qualifies = (block, part), [], None
                if side == 0:
                    held.append((sid, (named, comp), x))
                    continue
                qualifies = qualifies or union_of([o for _, _, o in held])
                if not qualifies(x):
                    continue
                joined = set()
                for other, rank, o in held:
                    if rank > (named, comp) and rank not in joined and test(x, o):
                        found.append((sid, other, block))
                        joined.add(rank)  # one link joins the set to that whole component
            cols = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "block"])

    return stored(at.mapInArrow(run, "a long, b long, block long"), "links", TEXT_BATCH)


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of ``docs`` (doc_id, text)."""
    sets, levels = sets_of(docs)
    lists = lists_of(docs, levels)
    pivots = pivots_of(lists)
    marks = marks_of(sets, lists)
    pairs = compare(pivots.select("a", "b"), marks, _marks, may_link)
    texts = texts_of(docs, sets, pairs.select(F.col("a").alias("sid")).union(pairs.select("b")))
    near = compare(pairs, texts, _sets, are_linked)
    discard(texts, pairs)
    labels = connected_components(near)
    blocks = _blocks(lists, labels, pivots)
    discard(lists, pivots)
    far = across(docs, sets, marks, blocks)
    discard(blocks, marks)
    if not far.isEmpty():
        labels = connected_components(near.unionByName(far))
    return _named(sets, labels)


def _named(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Components of sets as components of documents. Only sets with a link or a copy are moved; names are made before documents meet them."""
    least = sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"))
    at = _labelled(labels, least, "sid", "comp").where("rows > 1 or comp is not null").select("sid", "low", F.coalesce("comp", "sid").alias("comp"))
    at = stored(at, "members")
    by_comp = at.groupBy("comp").agg(F.min("low").alias("component_id")).withColumnRenamed("comp", "c_")
    names = stored(at.join(broadcast_if_small(by_comp, MAX_BROADCAST), F.col("comp") == F.col("c_")).select(F.col("sid").alias("s_"), "component_id"), "names")
    discard(at)
    out = sets.join(broadcast_if_small(names, MAX_BROADCAST), F.col("sid") == F.col("s_"), "left")
    alone = F.when(F.col("s_").isNull(), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", alone).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest doc_id, with the columns of ``docs``.

    Of rows that share that doc_id the first is taken, and a row without a doc_id only where no row has one.
    Then rows are told apart by a number, which is stored with them; a table of distinct ids needs no such copy.
    """
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if repeated.isEmpty():
        found = stored(components(docs.select("doc_id", "text")), "components")
        gone = found.where("doc_id <> component_id").select("doc_id")
        return packed(docs, "doc_id").join(broadcast_if_small(gone, MAX_BROADCAST), "doc_id", "left_anti").select("doc.*")
    rows = stored(packed(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "rows")
    found = components(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    found = stored(rows.select("row", "doc_id").join(found, "row"), "components")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    first = found.groupBy("component_id").agg(F.min(order).alias("x")).select("x.row")
    gone = stored(found.select("row").join(first, "row", "left_anti"), "gone")
    return rows.select("row", "doc").join(broadcast_if_small(gone, MAX_BROADCAST), "row", "left_anti").select("doc.*")
