"""Merkle manifest of a dataset, with a witness for every row.

A row's leaf hashes its fields. The leaves of a group, in order, are the first nodes of a tree: while there are several nodes,
every FANOUT in a row (the last run may be shorter) become one, their hash. The roots of all groups, in order, make a
further tree in the same way, whose root stands for the dataset.

Trees are grown by appending. A task gets an aligned block of FANOUT^LEVELS nodes and appends them one by one: an open
subtree keeps the partial witnesses of its leaves, and when a run is complete each of its subtrees is a sibling by which the
witnesses of the others are extended. What is left of a block is its root, and block roots are appended to the next tree up as
leaves were, until a group has one. A witness is then the parts that the rounds have attached to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table, tidy, unused

FANOUT = 3
LEVELS = 8
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BROADCAST_ROWS = 100_000


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """Hash of the fields, each its bytes' number, a colon and itself, or `-` for null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


class Appender:
    """A tree that grows by one node at a time, and the witnesses of what was appended.

    `open[k]` holds the subtrees of height k that have no complete run yet, each with the rows below it. A witness is a list
    of (place in the run, size of the run, siblings), from the lowest level up.
    """

    def __init__(self, fanout: int = FANOUT):
        self.fanout, self.open, self.witnesses = fanout, [], []

    def append(self, node: str) -> None:
        self.witnesses.append([])
        self._add(0, node, [len(self.witnesses) - 1])

    def _add(self, level: int, node: str, rows: list[int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((node, rows))
        if len(self.open[level]) == self.fanout:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run = self.open[level]
        self.open[level] = []
        for i, (_, rows) in enumerate(run):
            step = (i, len(run), "".join(node for j, (node, _) in enumerate(run) if j != i))
            for r in rows:
                self.witnesses[r].append(step)
        self._add(level + 1, digest("".join(node for node, _ in run)), [r for _, rows in run for r in rows])

    def close(self, levels: int | None = None) -> str:
        """The root: of `levels` levels, or of as many as leave one node. Open runs are completed from the lowest level up."""
        level = 0
        while level < len(self.open):
            more = any(self.open[level + 1 :])
            if self.open[level] and (level < levels if levels is not None else more or len(self.open[level]) > 1):
                self._complete(level)
            level += 1
        return self.open[-1][0][0]


def fold(node: str, places: str, siblings: str) -> str:
    """The root that a witness gives for a node. `places` has two characters a level: place in the run and size of the run."""
    at = 0
    for k in range(0, len(places), 2):
        i, others = int(places[k]), int(places[k + 1]) - 1
        run = [siblings[at + DIGEST * j : at + DIGEST * (j + 1)] for j in range(others)]
        node = digest("".join([*run[:i], node, *run[i:]]))
        at += DIGEST * others
    return node


# --- in Spark -------------------------------------------------------------------------------------


def _small(df: DataFrame) -> DataFrame:
    """For a broadcast where its counted rows are within the bound; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds pos (from 0, without gaps, within the group in that order) and size (rows of the group); written.

    Rows are sorted in ranges over (group, order), so a group may lie in many tasks. Positions are a row's place in its task and
    a running sum of the counts by task and group, of which there are as many as tasks and groups together.
    """
    ids = saved(rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    ordered = ids.repartitionByRange(group, *order, "_at").sortWithinPartitions(group, *order, "_at").drop("_at")
    placed = saved(ordered.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)), "ordered")
    parts = placed.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"), F.sum("_n").over(Window.partitionBy(group)).alias("size"))
    return placed.join(_small(saved(starts, "starts")), [group, "_part"]).withColumn("pos", F.col("_row") + F.col("_start")).drop("_row", "_part", "_start")


def _appended(kept: Sequence[str], schema, levels: int, fanout: int):
    """Appends the nodes of each block, which come in order; rows of leaves with their partial witnesses, and one of the block's root."""
    width = len(kept)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        last, tree, held = None, Appender(fanout), []

        def done() -> Iterator[pa.RecordBatch]:
            root = tree.close(levels if last[2] > fanout**levels else None)
            rows = [(*own, last[0], last[1], last[2], None, "".join(f"{i}{n}" for i, n, _ in w), "".join(s for *_, s in w)) for own, w in zip(held, tree.witnesses, strict=True)]
            rows.append((*[None] * width, last[0], last[1], last[2], root, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types, strict=True)], names)

        for b in batches:
            types = types or [*[f.type for f in list(b.schema)[4:]], pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            own = [b.column(4 + i).to_pylist() for i in range(width)]
            for k, (group, block, size, node) in enumerate(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)):
                if (group, block, size) != last:
                    if last is not None:
                        yield from done()
                    last, tree, held = (group, block, size), Appender(fanout), []
                tree.append(node)
                held.append(tuple(c[k] for c in own))
        if last is not None:
            yield from done()

    return run


def witnesses(nodes: DataFrame, kept: Sequence[str], levels: int = LEVELS, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """(grp, kept, places and siblings of every node; grp and root of every group), from grp (not null), pos, size, node and `kept`.

    A round goes over all blocks at once, and there are fanout^levels times as few nodes in the next. A block's rows are one
    task's at a time; the join that hands a block's further witness to its rows has a key a block.
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    span = fanout**levels
    block = F.floor(F.col("pos") / span).alias("block")
    fields = [nodes.schema[c] for c in kept]
    schema = StructType([*fields, StructField("grp", StringType()), StructField("block", LongType()), StructField("size", LongType()), *[StructField(c, StringType()) for c in ("root", "places", "siblings")]])
    dealt = nodes.select("grp", block, "size", "node", *kept, "pos").repartition("grp", "block").sortWithinPartitions("grp", "block", "pos").drop("pos")
    made = saved(dealt.mapInArrow(_appended(kept, schema, levels, fanout), schema), "witnesses")
    leaves = made.where("root IS NULL").select("grp", "block", *kept, "places", "siblings")
    roots = made.where("root IS NOT NULL")
    whole = roots.where(F.col("size") <= span).select("grp", "root")
    parts = roots.where(F.col("size") > span)
    if parts.isEmpty():
        return leaves.drop("block"), whole
    above = parts.select("grp", F.col("block").alias("pos"), F.ceil(F.col("size") / span).alias("size"), F.col("root").alias("node"), F.col("block").alias("below"))
    further, tops = witnesses(above, ["below"], levels, fanout)
    further = saved(further.withColumnsRenamed({"below": "block", "places": "_places", "siblings": "_siblings"}), "further")
    longer = leaves.join(_small(further), ["grp", "block"], "left")
    return longer.select("grp", *kept, *[F.concat(c, F.coalesce(f"_{c}", F.lit(""))).alias(c) for c in ("places", "siblings")]), whole.union(tops)


@tidy
def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", key: str = "doc_id", altered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """key, group, leaf, altered (leaf of the fields with text `altered`), subroot, root, places and siblings of every row.

    Rows of a group are ordered by the key, null first, and rows of one key by their leaves; groups by their names, the null group
    first. Repeated rows each have their place. Columns beside the fields are left out. An empty table gives no row.
    """
    changed = [altered if altered is not None and c == "text" else F.col(f"`{c}`") for c in fields]
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp")  # "" for null sorts first
    own = docs.select(F.col(key), F.col(group), name, leaf(*[F.col(f"`{c}`") for c in fields]).alias("node"), leaf(*changed).alias("altered"))
    place = unused(own.columns, "leaf")
    rows = ranked(own, "grp", [key, "node"]).withColumn(place, F.col("node"))
    members, subroots = witnesses(rows, [key, group, place, "altered"], levels)
    subroots = saved(subroots, "subroots")
    over = ranked(subroots.select(F.lit("").alias("all"), "grp", F.col("root").alias("node")), "all", ["grp"])
    paths, top = witnesses(over.select(F.col("all").alias("grp"), "pos", "size", "node", F.col("grp").alias("sub")), ["sub"], levels)
    top = top.first()
    # the root is one value, and groups' paths are as many as groups
    upper = paths.select(F.col("sub").alias("grp"), F.col("places").alias("_places"), F.col("siblings").alias("_siblings")).join(subroots.withColumnRenamed("root", "subroot"), "grp")
    joined = saved(members, "members").join(_small(saved(upper, "upper")), "grp")
    return joined.select(
        key, group, place, "altered", "subroot", F.lit(top.root if top else None).cast("string").alias("root"),
        F.concat("places", "_places").alias("places"), F.concat("siblings", "_siblings").alias("siblings"),
    )


def folded(rows: DataFrame, node: str) -> DataFrame:
    """Adds folded_root: the root that the row's witness gives for the leaf in column `node`."""
    schema = rows.select("*", F.lit("").alias("folded_root")).schema
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fold(*x) for x in zip(*(b.column(names.index(c)).to_pylist() for c in (node, "places", "siblings")), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*names, "folded_root"])

    return rows.mapInArrow(run, schema)


def op12_merkle_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's witness, and whether it still holds: rows whose crc32 of doc_id is even have lost the line breaks of their text."""
    docs = table(spark, sf_dir, "documents")
    lost = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = folded(manifest(docs, altered=lost), "altered")
    proof = F.sha2("siblings", 256).alias("proof_sha256")
    return rows.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(depth: int = 12) -> str:
    """Trees of up to 3^depth nodes, level by level; depth bounds this text alone."""
    f = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(f(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    byte = "list_reduce(list_prepend(xor(a, x), [0, 1, 2, 3, 4, 5, 6, 7]), lambda b, i: xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda a, x: {byte}), 4294967295)"

    def tree(name: str, source: str) -> str:
        out = [f"{name}0 AS (SELECT * FROM {source})"]
        for k in range(depth):
            # one row for each node: grp, pos, size, node; then the same of the level above
            out.append(f"""{name}{k + 1} AS (SELECT grp, pos // 3 AS pos, CAST(any_value(size + 2) // 3 AS BIGINT) AS size, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM {name}{k} WHERE size > 1 GROUP BY grp, pos // 3
  UNION ALL SELECT grp, pos, size, node FROM {name}{k} WHERE size = 1)""")
        return ",\n".join(out)

    def path(name: str, rows: str, node: str) -> str:
        """Per row of `rows` (grp, pos, size): siblings `sib` and the node folded from column `node`."""
        out = [f"{rows}_{name}0 AS (SELECT *, pos AS p, size AS n, '' AS own_sib, {node} AS fold FROM {rows})"]
        for k in range(depth):
            run = f"""{rows}_{name}r{k} AS (SELECT grp, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM {name}{k} GROUP BY grp, pos // 3)"""
            step = f"""{rows}_{name}{k + 1} AS (SELECT a.* EXCLUDE (p, n, own_sib, fold), CASE WHEN n > 1 THEN p // 3 ELSE p END AS p, CASE WHEN n > 1 THEN (n + 2) // 3 ELSE n END AS n,
  CASE WHEN n > 1 THEN own_sib || array_to_string(list_filter(r.nodes, lambda x, i: i <> p % 3 + 1), '') ELSE own_sib END AS own_sib,
  CASE WHEN n > 1 THEN sha256(array_to_string([CASE WHEN i = p % 3 + 1 THEN fold ELSE r.nodes[i] END FOR i IN range(1, len(r.nodes) + 1)], '')) ELSE fold END AS fold
  FROM {rows}_{name}{k} a JOIN {rows}_{name}r{k} r ON r.grp = a.grp AND r.run = a.p // 3)"""
            out += [run, step]
        return ",\n".join(out)

    return f"""WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS grp, {leaf('text')} AS leaf,
  CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS altered FROM documents),
m AS (SELECT *, row_number() OVER (PARTITION BY encode(grp) ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS size FROM d),
{tree('t', '(SELECT grp, pos, size, leaf AS node FROM m)')},
sub AS (SELECT grp AS name, node AS subroot, '' AS grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS size FROM t{depth}),
{tree('u', '(SELECT grp, pos, size, subroot AS node FROM sub)')},
{path('t', 'm', 'altered')},
j AS (SELECT m.doc_id, m.leaf, m.own_sib AS low, m.fold AS start, s.subroot, s.grp, s.pos, s.size FROM m_t{depth} m JOIN sub s ON s.name = m.grp),
{path('u', 'j', 'start')}
SELECT doc_id, leaf, subroot, u.node AS root, sha256(low || own_sib) AS proof_sha256, fold AS folded_root, fold = u.node AS verified FROM j_u{depth}, u{depth} u"""


ORACLE = _sql()
