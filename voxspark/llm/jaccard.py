"""Size-aware heavy-light Jaccard join on five-word shingles, and its components.

Every text becomes the set of its distinct shingles; equal sets become one node. A set's bound is the number of its
shingles that some other set has too: no partner can share more, so of most corpora few sets can have any partner
at all, and only those go on. In one global order of shingles (frequent ones last), two sets of Jaccard 0.75
share a shingle among the first n - ceil(3n/4) + 1 of each, and two among one more. Light sets are joined by enumerating
the subsets of two of that longer prefix, heavy sets by scanning the inverted lists of their single shingles; the size
from which a set is heavy is the one of least cost for the sizes and list lengths at hand. All candidates
are checked on the whole sets.

Only components are wanted, so every list is first joined with one member, its hub, which then leaves it. Whoever may
still be linked to another component in a list stays there for the next round, where bounds are taken anew among those
alone. Rounds go on while each leaves far fewer pairs; what is left is joined in full as soon as that is about as much as there
are list entries, or when a round has hardly helped. A group of n near copies thus costs about n pairs, and no link between
components is passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import count_cutoff, raw_bytes, saved, shingle_sets_of, table, tidy, unused
from .components import connected_components

PERCENT = 75
HEAVY_TOKENS = 1 << 18
CHUNK = 500_000
CHUNK_SETS = 60_000
MANY = 0xFFFF
BUCKET_BYTES = 1 << 20
FIRST_SHARE = 0.375
BOUNDARIES = (2, 4, 8, 12, 16, 24, 32, 48, 64)
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 24 << 20
FEW_ROWS = 200_000
SET_BATCH = 100
SHRINKS = 0.7  #: hub rounds go on while the pairs left are at most this share of those of the round before
FULL_FACTOR = 4


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Shingles of which any partner shares at least one."""
    return n - -(-n * percent // 100) + 1


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _small(df: DataFrame) -> DataFrame:
    """For a broadcast where its counted rows are within the bound; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _gathered(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """In one partition where the counted rows are few, so that small tables are not dealt out again and again; otherwise as they are."""
    return df.coalesce(1) if df.count() <= most else df


def _set_bytes(sets: DataFrame) -> int:
    return sets.agg(F.coalesce(F.sum(F.octet_length("shingles") + 32), F.lit(0))).first()[0]


def _small_sets(sets: DataFrame) -> DataFrame:
    """The same for rows that hold whole sets: the bound is on their bytes."""
    return F.broadcast(sets) if _set_bytes(sets) <= BROADCAST_BYTES else sets


def _gathered_sets(sets: DataFrame) -> DataFrame:
    """In one partition where the sets' bytes are few; otherwise as they are."""
    return sets.coalesce(1) if _set_bytes(sets) <= BROADCAST_BYTES else sets


# --- bounds -------------------------------------------------------------------------------------

SETS = "doc_id long, n long, node long, most long"
MET = "bucket int, chunk long, prints binary, places binary, ids array<long>, sizes array<long>, nodes array<long>, most array<long>"
BACK = ["chunk", "places", "ids", "sizes", "nodes", "most"]
LONGS = pa.list_(pa.int64())


def _sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingles, of texts or of sets kept as bytes."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return (np.frombuffer(b, np.uint64) for b in column.to_pylist())
    return shingle_sets_of(raw_bytes(column))


def bounds(rows: DataFrame, share: float = 1.0) -> DataFrame:
    """doc_id, n, node and most of every row (an id, and a text or a set as bytes): `node` is a hash of the whole set, null if
    that is empty, and `most` a bound of the shingles that it has in common with any other set.

    Shingles in the first `share` of the hash space are looked at; those outside count as common. Tasks cut their rows
    into chunks and send 32 bits of each shingle to its bucket once a chunk; buckets tell chunks which ones they have met
    elsewhere. There are buckets in proportion to the bytes, so a bucket holds about BUCKET_BYTES of text and one
    entry a chunk of a shingle that is everywhere. Bounds may be too high (copies in another task, equal bits), never
    too low. Of equal sets in one task, one has a bound and the others null. Rows have to come in a repeatable
    order, as those of a written table do.
    """
    key, value = rows.columns
    size = rows.agg(F.sum(F.octet_length(value).cast("double"))).first()[0] or 0.0
    bits = min(30, max(6, int(np.ceil(np.log2(max(1.0, size / BUCKET_BYTES))))))
    limit = None if share >= 1 else np.uint64(int(share * 2**64))
    shift = np.uint64(64 - bits)
    used = int(np.ceil(share * (1 << bits)))
    cuts = np.arange(1, used, dtype=np.uint64) << shift
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("prints", pa.binary()), ("places", pa.binary()), *[(k, LONGS) for k in ("ids", "sizes", "nodes", "most")]])
    back = pa.schema([schema.field(k) for k in BACK])

    def packed(edges: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 30
        seen: set[int] = set()
        ids: list = []
        sizes: list[int] = []
        nodes: list = []
        parts: list[np.ndarray] = []
        held = 0

        def done() -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(x) for x in parts])
            tokens, at = np.concatenate(parts), np.repeat(np.arange(len(parts)), lengths)
            order = np.argsort(tokens, kind="stable")
            tokens, at = tokens[order], at[order]
            same, again = tokens[1:] == tokens[:-1], np.zeros(len(tokens), bool)
            again[1:] |= same
            again[:-1] |= same
            most = np.array(sizes) - lengths + np.bincount(at[again], minlength=len(parts))
            own = [m if new else None for m, new in zip(most.tolist(), fresh, strict=True)]
            first = np.append(True, ~same)[: len(tokens)]
            tokens, places = tokens[first], np.where(again, MANY, at)[first].astype(np.uint16)
            edges = np.concatenate([[0], np.searchsorted(tokens, cuts), [len(tokens)]])
            prints = (tokens >> (shift - np.uint64(32))).astype(np.uint32)
            full = pa.array(np.diff(edges) > 0)
            met = [pa.array(np.arange(used, dtype=np.int32)), pa.array(np.full(used, chunk)), packed(edges, prints), packed(edges, places), *[pa.nulls(used, LONGS)] * 4]
            yield pa.RecordBatch.from_arrays(met, schema=schema).filter(full)
            lists = [pa.array([x], LONGS) for x in (ids, sizes, nodes, own)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk % used], pa.int32()), pa.array([chunk], pa.int64()), *[pa.nulls(1, pa.binary())] * 2, *lists], schema=schema)

        fresh: list[bool] = []
        for b in batches:
            for doc, own in zip(b.column(0).cast(pa.int64()).to_pylist(), _sets_of(b.column(1)), strict=True):
                node = node_of(own) if len(own) else None
                new = node is not None and node not in seen
                if new:
                    if len(seen) > 1 << 20:
                        seen.clear()
                    seen.add(node)
                part = own[:0] if not new else own if limit is None else own[: np.searchsorted(own, limit)]
                ids.append(doc)
                sizes.append(len(own))
                nodes.append(node)
                fresh.append(new)
                parts.append(part)
                held += len(part)
                if held >= CHUNK or len(ids) >= CHUNK_SETS:
                    yield from done()
                    ids, sizes, nodes, fresh, parts, held, chunk = [], [], [], [], [], 0, chunk + 1
        if ids:
            yield from done()

    def meet(group: pa.Table) -> pa.Table:
        rows, docs = group.filter(pc.is_valid(group["prints"])), group.filter(pc.is_null(group["prints"]))
        out = [docs.select(BACK)]
        if rows.num_rows:
            lengths = [len(x) // 4 for x in rows["prints"].to_pylist()]
            prints = np.frombuffer(b"".join(rows["prints"].to_pylist()), np.uint32)
            places = np.frombuffer(b"".join(rows["places"].to_pylist()), np.uint16)
            order = np.argsort(prints, kind="stable")
            same, shared = prints[order][1:] == prints[order][:-1], np.zeros(len(prints), bool)
            shared[order[1:]] |= same
            shared[order[:-1]] |= same
            shared &= places != MANY
            edges = np.concatenate([[0], np.cumsum(lengths)])
            left = np.concatenate([[0], np.cumsum(shared)])[edges]
            found = packed(left, places[shared])
            out.append(pa.table([rows["chunk"], found, *[pa.nulls(rows.num_rows, LONGS)] * 4], schema=back).filter(pa.array(np.diff(left) > 0)))
        return pa.concat_tables([t.cast(back) for t in out])

    def total(group: pa.Table) -> pa.Table:
        docs = group.filter(pc.is_valid(group["sizes"]))
        ids, sizes, nodes, most = (docs[k].to_pylist()[0] for k in ("ids", "sizes", "nodes", "most"))
        places = np.frombuffer(b"".join(x for x in group["places"].to_pylist() if x), np.uint16)
        more = np.bincount(places, minlength=len(ids)).tolist()
        most = [None if m is None else m + k for m, k in zip(most, more, strict=True)]
        return pa.table([pa.array(x, pa.int64()) for x in (ids, sizes, nodes, most)], names=["doc_id", "n", "node", "most"])

    dealt = rows.mapInArrow(deal, MET)
    told = dealt.groupBy("bucket").applyInArrow(meet, ", ".join(f for f in MET.split(", ") if f.split()[0] in BACK))
    return told.groupBy("chunk").applyInArrow(total, SETS)


# --- candidates ---------------------------------------------------------------------------------


def frequent_shingles(sets: DataFrame) -> np.ndarray:
    """At most HEAVY_TOKENS shingles that are in the most sets, rarest first.

    Tasks count the shingles of all their sets and report those that repeat there. The order
    of shingles may be any; this one keeps common passages out of the prefixes, so errors
    in the counts cost time alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def counted() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(waiting), return_counts=True)
            often = times >= 3
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(times[often].astype(np.int64))], ["token", "n"])

        for b in batches:
            for own in _sets_of(b.column(0)):
                waiting.append(own)
                n += len(own)
                if n >= CHUNK:
                    yield counted()
                    waiting, n = [], 0
        if waiting:
            yield counted()

    counts = saved(sets.select("shingles").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "frequent", SET_BATCH)
    rows = counts.where(F.col("n") >= count_cutoff(counts, HEAVY_TOKENS)).toPandas().sort_values(["n", "token"])
    return rows["token"].to_numpy(np.int64).view(np.uint64).copy()


def prefixes(sets: DataFrame, frequent: np.ndarray) -> DataFrame:
    """node, n, most and the prefix of each set in the global order, of one more shingle than a partner must share one of."""
    order = np.argsort(frequent)
    shared = sets.sparkSession.sparkContext.broadcast((frequent[order], order.astype(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = shared.value
        for b in batches:
            out = []
            for own in _sets_of(b.column(3)):
                keys = own >> np.uint64(1)
                if len(tokens):
                    at = np.searchsorted(tokens, own)
                    at[at == len(tokens)] = 0
                    hit = tokens[at] == own
                    if hit.any():
                        keys[hit] = ranks[at[hit]] | np.uint64(1 << 63)
                        keys.sort()
                out.append(keys[: min(len(own), prefix_length(len(own)) + 1)].view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.list_(pa.int64()))], ["node", "n", "most", "prefix"])

    return sets.select("node", "n", "most", "shingles").mapInArrow(run, "node long, n long, most long, prefix array<long>")


def choose_boundary(sets: DataFrame) -> int:
    """The set size from which inverted lists are scanned.

    For each boundary: the subsets that smaller sets give, and the postings of sets that may meet a larger one, each
    times the length of its list as measured on every 64th shingle.
    """
    p1 = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    level = F.least(F.col("n"), F.lit(2 * BOUNDARIES[-1])).alias("level")
    sizes = sets.groupBy(level).agg(F.sum(p1).alias("lists"), F.sum((p1 + 1) * p1 / 2).alias("subsets")).collect()
    tokens = sets.select(F.explode(F.slice("prefix", 1, p1.cast("int"))).alias("token")).where("token % 64 = 0")
    lengths = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 1.0

    def cost(b: int) -> float:
        return sum(r.subsets for r in sizes if r.level < b) + sum(r.lists * lengths for r in sizes if r.level * 100 >= b * PERCENT)

    return min(BOUNDARIES, key=cost)


def postings(sets: DataFrame, boundary: int) -> DataFrame:
    """token, node, n, most, pos: the keys by which sets meet. Light sets give pairs of shingles; those near the boundary single ones too."""
    p1 = (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).cast("int")
    heavy = sets.where(F.col("n") * 100 >= boundary * PERCENT)
    lists = heavy.select("node", "n", "most", F.posexplode(F.slice("prefix", 1, p1)).alias("pos", "token")).select("token", "node", "n", "most", "pos")
    if boundary <= 2:
        return lists
    light = sets.where(F.col("n") < boundary)
    first = light.select("node", "n", "most", "prefix", F.posexplode("prefix").alias("i", "t"))
    rest = first.where(F.col("i") + 1 < F.size("prefix")).select("node", "n", "most", "t", F.explode(F.slice("prefix", F.col("i") + 2, F.size("prefix"))).alias("u"))
    return lists.unionByName(rest.select(F.xxhash64("t", "u").alias("token"), "node", "n", "most", F.lit(0).alias("pos")))


def reach(x: str = ""):
    """What a set may share at most with one that it meets first at this place of its prefix."""
    return F.least(F.col(f"{x}most"), F.col(f"{x}n") - F.col(f"{x}pos"))


def may_link(x: str, y: str):
    """Length, positional and bound filter of two sets that meet; `x` and `y` are column prefixes."""
    enough = F.least(reach(x), reach(y)) * (100 + PERCENT) >= (F.col(f"{x}n") + F.col(f"{y}n")) * PERCENT
    return enough & (F.least(f"{x}n", f"{y}n") * 100 >= F.greatest(f"{x}n", f"{y}n") * PERCENT)


def open_lists(members: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Of list entries (token, node, n, most, pos, comp) those that may still link two components, and by list its size, its pairs of
    different components and its hub.

    An entry stays if it can reach the smallest set of its list that its own size allows. The hub is the
    entry with the largest bound for its size, the one most like the others; in later rounds any one.
    """
    shared = members.groupBy("token").agg(F.min("n").alias("least"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token", "least")
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * PERCENT / 100))
    kept = members.join(shared, "token").where(reach() * (100 + PERCENT) >= (F.col("n") + smallest) * PERCENT)
    members = _gathered(saved(kept.select("token", "node", "n", "most", "pos", "comp"), "members"))
    score = F.col("most") / F.col("n") if turn == 0 else F.xxhash64("node", F.lit(turn)).cast("double")
    by = members.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct(score.alias("score"), "node", "n", "most", "pos", "comp")).alias("hub"))
    lists = by.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.sum("k").alias("size"), F.sum(F.col("k") * F.col("k")).alias("within"), F.max("hub").alias("hub"))
    pairs = (F.col("size").cast("double") * F.col("size") - F.col("within")) / 2
    return members, _gathered(saved(lists.where("comps > 1").select("token", "size", pairs.alias("pairs"), "hub"), "open"))


def hub_pairs(members: DataFrame, lists: DataFrame) -> DataFrame:
    """Each entry with its list's hub, where they are of different components."""
    hubs = lists.select("token", *[F.col(f"hub.{k}").alias(f"h_{k}") for k in ("node", "n", "most", "pos", "comp")])
    met = members.join(hubs, "token").where((F.col("comp") != F.col("h_comp")) & may_link("", "h_"))
    return met.select(F.col("node").alias("a"), F.col("h_node").alias("b")).distinct()


def all_pairs(members: DataFrame, lists: DataFrame) -> DataFrame:
    """Pairs of one list and different components. A component's sets of one size are met as a block first, so that no pair
    within a component and none of sizes or bounds that rule each other out is made.

    A pair is taken at the first list that both are in: where the lists before it are the same for both, it
    has been met there.
    """
    before = Window.partitionBy("node").orderBy("pos", "token")
    members = _gathered(saved(members.join(lists.select("token"), "token").withColumn("before", F.lag("token").over(before)), "members"))
    blocks = members.groupBy("token", "comp", "n").agg(F.max(reach()).alias("reach"))
    x, y = (blocks.select("token", F.col("comp").alias(f"{k}comp"), F.col("n").alias(f"{k}n"), F.col("reach").alias(f"{k}reach")) for k in "xy")
    hope = lambda a, b: (F.least(a, b) * (100 + PERCENT) >= (F.col("xn") + F.col("yn")) * PERCENT) & (F.least("xn", "yn") * 100 >= F.greatest("xn", "yn") * PERCENT)
    meets = x.join(y, "token").where((F.col("xcomp") < F.col("ycomp")) & hope("xreach", "yreach")).drop("xreach")
    left, right = (members.select("token", *[F.col(c).alias(f"{k}{c}") for c in ("comp", "node", "n", "most", "pos", "before")]) for k in "xy")
    rows = meets.join(left, ["token", "xcomp", "xn"]).where(hope(reach("x"), "yreach")).join(right, ["token", "ycomp", "yn"])
    rows = rows.where(may_link("x", "y") & ~F.coalesce(F.col("xbefore") == F.col("ybefore"), F.lit(False)))
    return rows.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard similarity of 0.75 or more.

    Sets are joined by node; `b`, which may be a hub, is joined last, by broadcast where the bytes of its sets are within the
    bound, so that its rows may be split among tasks.
    """
    pairs = _gathered(saved(pairs, "pairs"))
    hubs = sets.select("node", "shingles").join(_small(pairs.select(F.col("b").alias("node")).distinct()), "node", "left_semi")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.join(_small_sets(hubs).select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(_sets_of(b.column(2)), _sets_of(b.column(3)), strict=True):
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                common = int((large[at] == small).sum())
                good.append(100 * common >= PERCENT * (len(small) + len(large) - common))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, n and shingles (as bytes) of the wanted nodes (node, rep: the least doc_id that has it), written, each once.

    Texts are fetched by doc_id; another text under the same doc_id is told by its hash, and nodes that have null
    doc_ids alone are met among the rows of null doc_ids.
    """
    ids = wanted.select(F.col("rep").alias("_id")).distinct()
    found = docs.select("doc_id", "text").join(_small(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            rows = []
            for own in _sets_of(b.column(0)):
                if len(own) and (node := node_of(own)) not in seen:
                    if len(seen) > 1 << 20:
                        seen.clear()
                    seen.add(node)
                    rows.append((node, len(own), own.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["node", "n", "shingles"])

    made = found.select("text").mapInArrow(run, "node long, n long, shingles binary")
    sets = saved(made.join(_small(wanted.select("node")), "node", "left_semi"), "whole-sets", SET_BATCH)
    rows, nodes = sets.agg(F.count(F.lit(1)), F.count_distinct("node")).first()
    if rows > nodes:  # a doc_id on several rows
        sets = saved(sets.groupBy("node").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), "whole-sets")
    return _gathered_sets(sets)


def linkable(sets: DataFrame) -> DataFrame:
    """Those that could share enough with a partner of the least size."""
    return sets.where((F.col("n") > 1) & (F.col("most") * 100 >= F.col("n") * PERCENT))


def _bounded(sets: DataFrame) -> DataFrame:
    """node and most of those that may have a partner among these sets (node, n, shingles)."""
    return _gathered(saved(linkable(bounds(sets.select("node", "shingles"))).select("node", "most"), "bounds", SET_BATCH))


def similar_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets of all documents (SETS), and (node, comp) of every node that has a link."""
    spark = docs.sparkSession
    rows = saved(bounds(docs.select("doc_id", "text"), FIRST_SHARE), "sets")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("most").alias("most"))
    wanted = _gathered(saved(linkable(nodes).select("node", "rep"), "wanted"))
    sets = whole_sets(docs, wanted)
    sets = _gathered_sets(saved(sets.join(_small(_bounded(sets)), "node"), "linkable"))
    prefix = saved(prefixes(sets, frequent_shingles(sets)), "prefixes", SET_BATCH)
    members = _gathered(saved(postings(prefix, choose_boundary(prefix)).withColumn("comp", F.col("node")), "postings"))
    edges = comps = None
    turn, before, last = 0, float("inf"), False
    while not last:
        members, lists = open_lists(members, turn)
        entries, left = lists.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0.0))).first()
        if not left:
            break
        last = turn > 0 and (left <= FULL_FACTOR * entries or left > SHRINKS * before)
        turn, before = turn + 1, left
        found = verified(all_pairs(members, lists) if last else hub_pairs(members, lists), sets)
        edges = _gathered(saved(found if edges is None else edges.union(found), "edges", SET_BATCH))
        comps = connected_components(edges)
        if last:
            break
        stay = members.drop("comp", "most").join(lists.select("token", F.col("hub.node").alias("_hub")), "token").where("node <> _hub").drop("_hub")
        stay = _gathered(saved(stay, "members"))
        sets = sets.join(_small(stay.select("node").distinct()), "node", "left_semi")
        state = _bounded(sets).join(_small(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        members = stay.join(_small(_gathered(saved(state, "state"))), "node")
    return rows, spark.createDataFrame([], "node long, comp long") if comps is None else comps


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node, component_id and chosen of every row: the rows of the least doc_id in a component are chosen, null ids last, and of several texts under it one."""
    sets, comps = similar_components(docs)
    classes = saved(sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
    linked = saved(classes.join(_small(comps), "node"), "linked")
    least = linked.groupBy("comp").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("least"))
    final = linked.join(_small(saved(least, "least")), "comp").select("node", F.col("least.rep").alias("_to"), (F.col("node") == F.col("least.node")).alias("_first"))
    copied = classes.where("rows > 1").join(_small(comps.select("node")), "node", "left_anti").select("node", F.col("rep").alias("_to"), F.lit(True).alias("_first"))
    grouped = _small(saved(final.union(copied), "grouped"))  # any other row stands alone
    chosen = F.when(F.col("node").isNull(), False).when(F.col("_first").isNull(), True).otherwise(F.col("_first") & F.col("doc_id").eqNullSafe(F.col("_to")))
    return sets.join(grouped, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), "node", F.when(F.col("_first").isNull(), F.col("doc_id")).otherwise(F.col("_to")).alias("component_id"), chosen.alias("chosen"))


@tidy
def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links of Jaccard 0.75, itself included.

    Words are cut at white space, A-Z lowered; fewer than five words are one shingle; a null or
    empty text has no shingles and no link. Rows may repeat: equal texts are in one component, and a doc_id on
    several rows keeps one result for each. Null doc_ids take part and are not chosen as component_id unless
    there is no other. Sets are told apart by 64-bit hashes. An empty table gives no rows.
    """
    return _labelled(docs).select("doc_id", "n_shingles", "component_id")


@tidy
def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component stays, one with the smallest doc_id, a null one being the last; all columns as they were.

    Rows without words have no group and stay. Rows are told apart by doc_id and the hash of their set: where no doc_id is on
    several rows its id tells whether it goes; the rows of those whose ids do not tell are looked at again, and
    of equal ones the one whose text has the least hash stays.
    """
    rows = saved(_labelled(docs), "copies")
    ids = rows.groupBy("doc_id").agg(F.count("node").alias("grouped"), F.count(F.lit(1)).alias("all"), F.count_if("chosen").alias("chosen"))
    ids = saved(ids.where("grouped > 0 and not (grouped = 1 and chosen = 1)").select(F.col("doc_id").alias("_id"), (F.expr("chosen > 0 or all > grouped")).alias("_again")), "ids")
    own = unused(docs.columns, "_id")
    kept = docs.join(_small(ids.select(F.col("_id").alias(own))), F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")
    again = ids.where("_again").select("_id")
    if not again.head(1):
        return kept
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    whole = _with_nodes(whole.join(_small(again), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"))
    best = rows.where("chosen").join(_small(again), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(F.col("doc_id").alias("_id"), F.col("node").alias("_best")).distinct()
    met = whole.join(_small(saved(best, "best")), (F.col("node") == F.col("_best")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    one = met.groupBy("doc_id", "node").agg(F.min_by("_doc", F.xxhash64("text")).alias("_doc"))
    return kept.union(whole.where("node is null").select("_doc.*")).union(one.select("_doc.*"))


def _with_nodes(rows: DataFrame) -> DataFrame:
    """Adds node to rows of doc_id, text and more; null where there are no words."""
    from pyspark.sql.types import LongType, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = [node_of(own) if len(own) else None for own in shingle_sets_of(raw_bytes(b.column(1)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes, pa.int64())], [*b.schema.names, "node"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("node", LongType()))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM t UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.c = l.x)
SELECT t.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM t JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY t.doc_id
"""
