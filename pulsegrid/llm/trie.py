"""Prefix trie of conversations from padded turn-id matrices.

Conversations become rows of turn ids, ranges of equal or neighbouring rows are dealt to shards, and
each shard sorts its padded matrix with numpy: a column that changes, or any column before it, marks
where a node starts, and ``reduceat`` sums every depth. Nodes that hold the first or the last row of
a shard may go on in the next one; only these leave it as parts and are put together by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.common import cut, union_all
from pulsegrid.operators.ordered import add_ordinals

#: Turns in a row of a matrix; a longer conversation has several rows, one per depth block.
WIDTH = 32
#: Cells of a shard's matrix aimed at (32 MB).
_CELLS = 1 << 22
_PAD = -(1 << 63)
_NONE = hashlib.sha256(b"").hexdigest()
_OUT = (
    "kind int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, cont long, sig long, parent_sig long, len long, above array<long>, ids string"
)
_ARROW = pa.schema(
    [("kind", pa.int32())]
    + [(c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string())]
    + [(c, pa.int64()) for c in ("cont", "sig", "parent_sig", "len")]
    + [("above", pa.list_(pa.int64())), ("ids", pa.string())]
)
#: Rows that leave a shard: whole nodes, parts of nodes, and ids of a part's ended conversations.
_WHOLE, _PART, _ENDS = 0, 1, 2


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rn, id, len): the turns of each conversation numbered from 0 in the order of ``turn``
    (null first; equal ones by id). ``id`` names role and text, null as empty; ``len`` is the text's
    code points. Rows without conv_id belong to no conversation and are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.greatest(F.xxhash64(role, text), F.lit(_PAD + 1)).alias("id"),
        F.length(text).cast("long").alias("len"),
    )
    part = F.coalesce(F.shiftright("turn", 12), F.lit(-(1 << 52)))
    order = [F.asc_nulls_first("turn"), F.asc("id"), F.asc("len")]
    return add_ordinals(rows.withColumn("part", part), ["conv_id"], order, "part").select("conv_id", "rn", "id", "len")


def rebuilt(numbered: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with turns of the first of their ``group`` ids: (conv_id, pos, id,
    len), and all their conv_ids, those left without turns too.

    Conversation c takes the first h = crc32(c) modulo ``most`` turns of conversation c - c % group
    (all if it has fewer, none if it is absent) and goes on with its own turns after its first h."""
    start = F.col("conv_id") - F.col("conv_id") % F.lit(group)
    heads = (
        numbered.where((F.col("conv_id") % F.lit(group) == 0) & (F.col("rn") < most - 1))
        .groupBy(F.col("conv_id").alias("start"))
        .agg(F.array_sort(F.collect_list(F.struct("rn", "id", "len"))).alias("head"))
    )
    size = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    convs = (
        numbered.select("conv_id").distinct()
        .withColumns({"h": size, "start": start})
        .join(heads, "start", "left")
        .selectExpr("conv_id", "h", "case when head is null then slice(array(), 1, 0) else slice(head, 1, h) end as head")
    )
    convs = cut(convs, "trie-heads")
    own = numbered.join(convs.selectExpr("conv_id", "h", "size(head) - h as shift"), "conv_id").where("rn >= h")
    taken = convs.selectExpr("conv_id", "posexplode(head) as (pos, item)")
    paths = own.selectExpr("conv_id", "rn + shift as pos", "id", "len").unionByName(
        taken.selectExpr("conv_id", "cast(pos as long) as pos", "item.id as id", "item.len as len")
    )
    return paths, convs.select("conv_id")


def _blocks(paths: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """(conv_id, k, ids, lens): the turns of depth block k of a conversation; block 0 always exists."""
    item = F.struct("pos", "id", "len").alias("item")
    rows = paths.select("conv_id", F.floor(F.col("pos") / width).cast("long").alias("k"), item)
    rows = rows.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("k"), F.lit(None).cast(rows.schema["item"].dataType).alias("item")))
    items = rows.groupBy("conv_id", "k").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return items.selectExpr("conv_id", "k", "transform(items, x -> x.id) as ids", "transform(items, x -> x.len) as lens")


def _chained(blocks: DataFrame, width: int) -> DataFrame:
    """Blocks of conversations that fill their first one: with ``ga``, ``gb`` (they name what lies
    before the block) and ``more`` (another block follows)."""
    long = blocks.where(f"k > 0 or size(ids) = {width}").withColumns(
        {"part": F.shiftright("k", 10), "x": F.xxhash64("k", "ids")}
    )
    low, high = (F.col("x").bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned("x", 33))
    marks = {"a": low.cast("int"), "b": high.cast("int")}
    rows = add_ordinals(long, ["conv_id"], ["k"], "part", marks)
    return rows.select(
        "conv_id", "k", "ids", "lens", (F.col("a") - low).alias("ga"), (F.col("b") - high).alias("gb"),
        (F.col("rn") < F.col("n") - 1).alias("more"),
    )


class _Shard:
    """The sorted matrix of one range of conversations, and the nodes read off it."""

    def __init__(self, table: pa.Table, k: int, width: int):
        self.k, self.width, self.n = k, width, table.num_rows
        whole = {c: table.column(c).combine_chunks() for c in table.column_names}
        column = {c: whole[c].to_numpy(zero_copy_only=False) for c in table.column_names if c not in ("ids", "lens")}
        sizes = whole["ids"].value_lengths().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(self.n), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = np.full((self.n, width + 1), _PAD, np.int64)
        ids[row, at] = whole["ids"].flatten().to_numpy()
        ids[column["more"], width] = 0  # a conversation that goes on stands after those that end
        lens = np.zeros((self.n, width), np.int64)
        lens[row, at] = whole["lens"].flatten().to_numpy()
        order = np.lexsort((column["conv_id"], *ids.T[::-1], column["gb"], column["ga"]))
        self.ids, self.lens, self.sizes = ids[order], lens[order], sizes[order]
        self.column = {c: v[order] for c, v in column.items()}
        self.sigs = [self._chain(0), self._chain(self.n - 1)]

    def _chain(self, r: int) -> list[int]:
        """Names of the nodes on the way to row ``r``."""
        group = self.column["ga"][r].tobytes() + self.column["gb"][r].tobytes()
        row = self.ids[r, : self.sizes[r]]
        return [
            xxhash.xxh64_intdigest(group + row[:j].tobytes()) - (1 << 63) for j in range(self.sizes[r] + 1)
        ]

    def starts(self) -> np.ndarray:
        """Where a node of each depth (0 to width) starts: changes of columns, carried to the right."""
        change = np.ones((self.n, self.width + 1), bool)
        ga, gb = self.column["ga"], self.column["gb"]
        change[1:, 0] = (ga[1:] != ga[:-1]) | (gb[1:] != gb[:-1])
        np.not_equal(self.ids[1:, :-1], self.ids[:-1, :-1], out=change[1:, 1:])
        return np.logical_or.accumulate(change, axis=1)

    def nodes(self) -> Iterator[pa.RecordBatch]:
        conv, more = self.column["conv_id"], self.column["more"]
        starts = self.starts()
        saved, leaves = self.column["ext_saved"].copy(), self.column["ext_leaves"].copy()
        below = self.column["ext_children"]
        cont = np.where(more, conv, np.iinfo(np.int64).max)
        found = []
        for j in range(self.width, -1, -1):
            s = np.flatnonzero(starts[:, j])
            n = np.diff(np.append(s, self.n))
            valid = self.sizes[s] >= j
            split = np.zeros(len(s), bool)
            split[[0, -1]] = True
            kids = np.add.reduceat(below, s)
            real = valid & ~split & ((j > 0) | (self.k == 0))
            texts = self.lens[s, j - 1] if j else np.zeros(len(s), np.int64)
            saved[s[real]] += ((n - 1) * texts)[real]
            leaves[s[real & (kids == 0)]] += 1
            below = np.zeros(self.n, np.int64)
            below[s[valid & ~split]] = 1
            found.append(
                {
                    "s": s, "n": n, "valid": valid, "split": split, "conv": np.minimum.reduceat(conv, s), "kids": kids,
                    "saved": np.add.reduceat(saved, s), "leaves": np.add.reduceat(leaves, s), "texts": texts,
                    "ended": np.add.reduceat(((self.sizes == j) & ~more).astype(np.int64), s),
                    "cont": np.minimum.reduceat(cont, s) if j == self.width else np.full(len(s), cont.max(initial=0)),
                }
            )
        found.reverse()
        for j, level in enumerate(found):
            yield from self._rows(j, level, found[j - 1] if j else None)

    def _rows(self, j: int, level: dict, upper: dict | None) -> Iterator[pa.RecordBatch]:
        depth, conv = self.k * self.width + j, self.column["conv_id"]
        last = len(level["s"]) - 1
        parent = np.searchsorted(upper["s"], level["s"], "right") - 1 if j else np.zeros(last + 1, np.int64)
        rows = []
        for i in np.flatnonzero(level["valid"]).tolist():
            s, e = int(level["s"][i]), int(level["ended"][i])
            split, cont = bool(level["split"][i]), int(level["cont"][i]) if j == self.width else None
            if cont == np.iinfo(np.int64).max:
                cont = None
            up_conv, up_sig = None, None
            if j:
                p = int(parent[i])
                if upper["split"][p]:
                    up_sig = self.sigs[0 if p == 0 else 1][j - 1]
                else:
                    up_conv = int(upper["conv"][p])
            facts = [level[c][i] for c in ("n", "kids", "leaves", "saved")]
            if not split:
                ends = hashlib.sha256(",".join(map(str, conv[s : s + e].tolist())).encode()).hexdigest() if e else _NONE
                rows.append((_WHOLE, depth, level["conv"][i], up_conv, *facts, ends, cont, None, up_sig, None, None, None))
            else:
                chain = self.sigs[0 if i == 0 else 1]
                rows.append((_PART, depth, level["conv"][i], None, *facts, None, cont, chain[j], up_sig, level["texts"][i], chain[:j], None))
                for a in range(0, e, 1 << 14):
                    some = conv[s + a : min(s + e, s + a + (1 << 14))].tolist()
                    text = ",".join(map(str, some))
                    rows.append((_ENDS, depth, some[0], None, 0, 0, 0, 0, None, None, chain[j], None, None, None, text))
            if len(rows) >= 1 << 14:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _level(rows: DataFrame, k: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of depth block ``k``, and for k > 0 the totals of each group of its rows (they lie below
    one node of the block before): (conv_id, leaves, children, saved)."""
    spark = rows.sparkSession
    cells = rows.count() * (width + 1)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cells // _CELLS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _Shard(pa.Table.from_batches(held), k, width).nodes()

    dealt = rows.repartitionByRange(shards, "ga", "gb", "ids", "more", "conv_id")
    out = cut(dealt.mapInArrow(run, _OUT), "trie-nodes")
    whole, part, ends = (out.where(F.col("kind") == v) for v in (_WHOLE, _PART, _ENDS))

    parts = cut(
        part.groupBy("depth", "sig").agg(
            F.min("conv_id").alias("conv_id"), F.min("cont").alias("cont"), F.first("parent_sig").alias("parent_sig"),
            F.first("len").alias("len"), F.first("above").alias("above"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        ),
        "trie-parts",
    )
    kids = parts.where("parent_sig is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_sig").alias("sig")).agg(F.count(F.lit(1)).alias("kids"))
    own = parts.join(kids, ["depth", "sig"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    # every split node counts for itself and for all above it, which are split too
    each = own.select(
        F.posexplode(F.concat("above", F.array("sig"))).alias("j", "sig"),
        ((F.col("n_convs") - 1) * F.col("len")).alias("s"), (F.col("n_children") == 0).cast("long").alias("l"),
    )
    sums = each.groupBy((F.col("j") + k * width).cast("long").alias("depth"), "sig").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    hashed = _digests(ends)
    joined = cut(
        own.join(sums, ["depth", "sig"]).join(hashed, ["depth", "sig"], "left").select(
            "depth", "sig", "conv_id", "cont", "parent_sig", "n_convs", "n_children",
            (F.col("n_leaves") + F.col("l")).alias("n_leaves"), (F.col("saved_tokens") + F.col("s")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"),
        ),
        "trie-joined",
    )
    upper = joined.select((F.col("depth") + 1).alias("depth"), F.col("sig").alias("parent_sig"), F.col("conv_id").alias("above_id"))
    columns = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "cont"]
    known = whole.where("parent_sig is null")
    below = whole.where("parent_sig is not null").select(*[c for c in columns if c != "parent_conv_id"], "parent_sig")
    below = below.unionByName(joined.drop("sig")).join(upper, ["depth", "parent_sig"], "left")
    nodes = known.select(*columns).unionByName(below.withColumn("parent_conv_id", F.col("above_id")).select(*columns))
    if k == 0:
        return nodes, None
    groups = nodes.where(F.col("depth") == k * width)
    totals = groups.selectExpr("conv_id", "n_leaves as leaves", "n_children as children", "saved_tokens as saved")
    return nodes.where(F.col("depth") > k * width), totals


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids of each split node, from its pieces in order, one piece held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []
        for batch in batches:
            for depth, sig, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "sig", "ids"))):
                if (depth, sig) != key:
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (depth, sig), hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if key:
            done.append((*key, digest.hexdigest()))
        for a in range(0, len(done), 1 << 14):
            d, g, x = zip(*done[a : a + (1 << 14)])
            yield pa.record_batch({"depth": pa.array(d, pa.int64()), "sig": pa.array(g, pa.int64()), "ends_sha256": pa.array(x, pa.string())})

    dealt = ends.select("depth", "sig", "conv_id", "ids").repartition("depth", "sig").sortWithinPartitions("depth", "sig", "conv_id")
    return dealt.mapInArrow(run, "depth long, sig long, ends_sha256 string")


def prefix_trie(paths: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Nodes of the trie of ``paths`` (conv_id, pos from 0 without gaps, id, len) of the conversations
    ``convs`` (conv_id; those without turns end at the root).

    One row per distinct sequence of first turns: conv_id (smallest conversation that starts with
    it), depth, parent_conv_id (the parent's conv_id; null at the root), n_convs, n_children,
    n_leaves (childless nodes below it, itself included), saved_tokens (over its subtree, each node's
    (n_convs - 1) times the ``len`` of its last turn), ends_sha256 (of the ascending comma-joined
    ids of the conversations that end here). No conversations: no rows.

    Conversations longer than ``width`` go on in further depth blocks. From the depth where nobody
    else shares a conversation's block, its nodes are read off its own turns; shared blocks are
    matrices again, deepest first, one job each. Turns are told apart by 64-bit hashes among the
    children of a node. All ids are hashed once per node they end at; a node in which very many end
    gathers text pieces of 16,384 ids in one task and holds one at a time.
    """
    blocks = cut(_blocks(paths, convs, width), "trie-blocks")
    deepest = blocks.agg(F.max("k")).first()[0]
    if deepest is None:
        deepest = 0
    zero = {c: F.lit(0).cast("long") for c in ("ext_leaves", "ext_children", "ext_saved")}
    if deepest == 0:
        first = blocks.withColumns({"ga": F.lit(0).cast("long"), "gb": F.lit(0).cast("long"), "more": F.lit(False), **zero})
        nodes, _ = _level(first.drop("k"), 0, width)
        return nodes.drop("cont")

    chained = cut(_chained(blocks, width), "trie-chained")
    short = blocks.where(f"k = 0 and size(ids) < {width}").withColumns(
        {"ga": F.lit(0).cast("long"), "gb": F.lit(0).cast("long"), "more": F.lit(False)}
    )
    later = chained.where("k > 0")
    lone = later.groupBy("k", "ga", "gb").count().where("count = 1").drop("count")
    shared = cut(later.join(lone, ["k", "ga", "gb"], "left_anti"), "trie-shared")
    alone = cut(later.join(lone, ["k", "ga", "gb"], "left_semi"), "trie-alone")

    at = F.posexplode(F.arrays_zip("ids", "lens")).alias("j", "item")
    tails = alone.select("conv_id", "k", "more", F.size("ids").alias("size"), at).select(
        (F.col("k") * width + F.col("j") + 1).alias("depth"), "conv_id", F.col("conv_id").alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        (F.col("more") | (F.col("j") < F.col("size") - 1)).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("more") | (F.col("j") < F.col("size") - 1), F.lit(_NONE))
        .otherwise(F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends_sha256"),
    )
    levels, below = [], None
    most = shared.agg(F.max("k")).first()[0] or 0
    for k in range(most, -1, -1):
        here = short.unionByName(chained.where("k = 0")) if k == 0 else shared.where(F.col("k") == k)
        ext = alone.where(F.col("k") == k + 1).selectExpr("conv_id", "1L as leaves", "1L as children", "0L as saved")
        if below is not None:
            ext = ext.unionByName(below)
        here = here.drop("k").join(ext, "conv_id", "left").select(
            "conv_id", "ids", "lens", "ga", "gb", "more",
            *[F.coalesce(c, F.lit(0).cast("long")).alias(f"ext_{c}") for c in ("leaves", "children", "saved")],
        )
        nodes, totals = _level(cut(here, "trie-rows"), k, width)
        levels.append(nodes)
        below = None if totals is None else cut(totals, "trie-totals")
    joints = union_all([n.where(F.col("cont").isNotNull()) for n in levels]).selectExpr(
        "depth + 1 as depth", "cont as parent_conv_id", "conv_id as joint"
    )
    nodes = union_all([n.drop("cont") for n in levels] + [tails])
    # below a block border the parent's name is that of the node in the block before
    border = (F.col("depth") > 1) & (F.col("depth") % width == (1 % width))
    crossing = nodes.where(border).join(joints, ["depth", "parent_conv_id"], "left").withColumn(
        "parent_conv_id", F.coalesce("joint", "parent_conv_id")
    )
    return nodes.where(~border).unionByName(crossing.select(*nodes.columns))


def conversation_trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """:func:`prefix_trie` of rebuilt ``conversations`` (conv_id, turn, role, text); see :func:`turns`
    and :func:`rebuilt`. Repeated rows are turns of their own. Other columns are ignored."""
    numbered = cut(turns(conversations), "trie-turns")
    return prefix_trie(*rebuilt(numbered), width)
