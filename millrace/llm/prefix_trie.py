"""The trie of conversation prefixes, measured by an Euler tour ranked as a distributed list.

Every distinct sequence of the first ``d`` turns of some conversation is a node of depth ``d``; the root is the
empty sequence. A node is named by depth and four sums of 31-bit turn hashes, so that its name follows from the
running sums along each conversation and no path is ever stored. Nodes are numbered with their siblings in a
row (ordered by smallest member), which gives each node its first child and next sibling by joins. Each node has
an *enter* and an *exit* arc; the successor of an arc is known locally (enter: first child's enter, else own
exit; exit: next sibling's enter, else parent's exit), and the positions of all arcs in the tour follow from
pointer doubling: ``log2(arcs)`` rounds of one self-join each, written between rounds. Values put on enter
arcs are then summed in tour order without one window over all arcs (:func:`millrace.plans.running.running`);
the sum over a node's subtree is the difference of the running sums at its exit and enter arcs.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import numbered
from millrace.plans.running import running
from millrace.session import new_dir, ship, written

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
# Fixed by the query's definition: conversations are rebuilt from the first h turns of conversation c - c % 5.
GROUP, HEAD_MOD = 5, 9

NODE = ["depth", "s1", "s2", "s3", "s4"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1)``, role, text``: turns in order of ``turn`` (nulls first), then role and text.

    Null roles and texts become empty strings; rows without ``conv_id`` are dropped; repeated rows are turns of
    their own. A conversation is one window group, as a conversation is one example elsewhere too; groups of
    equal conversations are spread like any others.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.select("conv_id", F.row_number().over(order).cast("bigint").alias("pos"), "role", "text")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations of the query: ``(turns, lengths)``.

    Conversation ``c`` takes the first ``h = crc32(decimal c) % 9`` turns of conversation ``c - c % 5`` (all if it
    has fewer, none if it is absent), then its own turns after its first ``h``. ``turns`` has ``conv_id, pos,
    role, text``; ``lengths`` has ``conv_id, n_turns`` for every conversation, 0 included.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    heads = sizes.select(
        "conv_id",
        "own",
        (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % HEAD_MOD).alias("h"),
    )
    base_sizes = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    heads = heads.join(base_sizes, "base", "left").select(
        "conv_id", "own", "base", "h", F.least(F.col("h"), F.coalesce("base_own", F.lit(0))).alias("kept")
    )
    lengths = heads.select(
        "conv_id", (F.col("kept") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns")
    )
    borrowed = (
        turns.where(F.col("pos") <= HEAD_MOD - 1)
        .withColumnRenamed("conv_id", "base")
        .join(heads.select("conv_id", "base", "h"), "base")
        .where(F.col("pos") <= F.col("h"))
        .select("conv_id", "pos", "role", "text")
    )
    own = turns.join(heads.select("conv_id", "h", "kept"), "conv_id").where(F.col("pos") > F.col("h"))
    own = own.select("conv_id", (F.col("kept") + F.col("pos") - F.col("h")).alias("pos"), "role", "text")
    return borrowed.unionByName(own), lengths


def _term(seed: int, pos: Column, role: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(seed), pos, role, text)


def node_members(turns: DataFrame) -> DataFrame:
    """One row per (conversation, depth >= 1): the node's name, its parent's, and the last turn's UTF-8 bytes."""
    low, high = (F.lit(0x7FFFFFFF),) * 2
    a, b = _term(1, F.col("pos"), F.col("role"), F.col("text")), _term(2, F.col("pos"), F.col("role"), F.col("text"))
    terms = turns.select(
        "conv_id",
        "pos",
        F.octet_length("text").cast("bigint").alias("bytes"),
        (a.bitwiseAND(low)).alias("t1"),
        (F.shiftrightunsigned(a, 33)).alias("t2"),
        (b.bitwiseAND(high)).alias("t3"),
        (F.shiftrightunsigned(b, 33)).alias("t4"),
    )
    along = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(f"t{i}").over(along).alias(f"s{i}") for i in range(1, 5)]
    members = terms.select("conv_id", F.col("pos").alias("depth"), "bytes", *[f"t{i}" for i in range(1, 5)], *sums)
    parent = F.struct(
        (F.col("depth") - 1).alias("depth"), *[(F.col(f"s{i}") - F.col(f"t{i}")).alias(f"s{i}") for i in range(1, 5)]
    )
    return members.select("conv_id", F.struct(*NODE).alias("node"), parent.alias("parent"), "bytes")


def _ends_digest(ids_by_node: DataFrame) -> DataFrame:
    """``nid, ends_sha256`` from ``nid, conv_id`` rows: SHA-256 of the node's ids, ascending, comma-joined.

    A digest of a sorted list is one sequential pass, so each node's ids are streamed in order through one task
    (a sort that spills, constant memory), never gathered into an array.
    """

    def run(batches):
        node, digest, first = None, None, True
        for batch in batches:
            for nid, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if nid != node:
                    if node is not None:
                        yield pa.RecordBatch.from_pylist([{"nid": node, "ends_sha256": digest.hexdigest()}], schema=SCHEMA)
                    node, digest, first = nid, hashlib.sha256(), True
                digest.update((("" if first else ",") + str(conv)).encode())
                first = False
        if node is not None:
            yield pa.RecordBatch.from_pylist([{"nid": node, "ends_sha256": digest.hexdigest()}], schema=SCHEMA)

    SCHEMA = pa.schema([("nid", pa.int64()), ("ends_sha256", pa.string())])
    ship(ids_by_node.sparkSession)
    ordered = ids_by_node.repartition("nid").sortWithinPartitions("nid", "conv_id").select("nid", "conv_id")
    return ordered.mapInArrow(run, "nid long, ends_sha256 string")


def rank_list(arcs: DataFrame) -> DataFrame:
    """``arc, rank``: the number of arcs after each one, from ``arc, next`` (null at the end) by pointer doubling.

    Each round joins the table with itself on ``next = arc`` and is written to the shared folder; the round two
    back is deleted then, so the disk holds at most two rounds. Every ``next`` is unique, so no key is hot.
    """
    spark = arcs.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    step = arcs.select("arc", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint").alias("rank"))
    paths: list[str] = []
    while True:
        path = new_dir(spark, "trie-tour")
        step.write.parquet(path)
        paths.append(path)
        if len(paths) > 2:
            old = fs_path(paths.pop(0))
            old.getFileSystem(conf).delete(old, True)
        step = spark.read.parquet(path)
        if step.where(F.col("next").isNotNull()).limit(1).count() == 0:
            return step.select("arc", "rank")
        other = step.select(F.col("arc").alias("o_arc"), F.col("next").alias("o_next"), F.col("rank").alias("o_rank"))
        step = step.join(other, F.col("next") == F.col("o_arc"), "left").select(
            "arc", F.col("o_next").alias("next"), (F.col("rank") + F.coalesce("o_rank", F.lit(0))).alias("rank")
        )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations, with counts and subtree sums.

    Takes ``conv_id, turn, role, text`` (other columns are ignored). Returns per node, as longs: ``conv_id``
    (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs`` (members: conversations that
    start with the node's turns), ``n_children``, ``n_leaves`` (childless nodes of its subtree, itself included),
    ``saved_tokens`` (over its subtree, each node's ``(n_convs - 1)`` times the UTF-8 bytes of its last text),
    and ``ends_sha256`` (SHA-256 of the ids of members with exactly ``depth`` turns, ascending, comma-joined;
    of the empty string if none). Turnless rebuilt conversations are members of the root alone. An empty
    table gives no rows (there is no conversation, so no root).
    """
    spark = conversations.sparkSession
    turns, lengths = rebuilt(ordered_turns(conversations))
    lengths = written(lengths, "trie-lengths")
    members = written(node_members(turns), "trie-members")
    root = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in NODE])
    everyone = lengths.select("conv_id", root.alias("node"), F.lit(None).cast(members.schema["parent"].dataType).alias("parent"), F.lit(0).cast("bigint").alias("bytes"))
    members = members.unionByName(everyone)
    nodes = members.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.first("parent", ignorenulls=True).alias("parent"),
        F.max("bytes").alias("bytes"),
    )
    nodes = written(nodes.select("node", "conv_id", "n_convs", "parent", "bytes", F.col("node.depth").alias("depth")), "trie-nodes")
    named = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(named, "parent", "left")
    # Siblings in a row, by smallest member; the root comes first (null parent).
    nodes = numbered(
        nodes.select("node", "conv_id", "n_convs", "depth", "parent_conv_id", "bytes"),
        [F.col("depth") - 1, F.col("parent_conv_id").asc_nulls_first(), "conv_id"],
        "nid",
        "trie-numbered",
    )
    nodes = written(nodes, "trie-numbered-nodes")
    by_name = nodes.select(F.col("depth").alias("p_depth"), F.col("conv_id").alias("p_conv"), F.col("nid").alias("parent_nid"))
    linked = nodes.join(by_name, (F.col("depth") - 1 == F.col("p_depth")) & (F.col("parent_conv_id") == F.col("p_conv")), "left")
    linked = written(linked.drop("p_depth", "p_conv"), "trie-linked")
    children = linked.groupBy(F.col("parent_nid").alias("nid")).agg(
        F.min("nid").alias("first_child"), F.count(F.lit(1)).alias("n_children")
    )
    after = linked.select((F.col("nid") - 1).alias("nid"), F.col("nid").alias("sib"), F.col("parent_nid").alias("sib_parent"))
    full = (
        linked.join(children.where(F.col("nid").isNotNull()), "nid", "left")
        .join(after, "nid", "left")
        .select(
            "*",
            F.when(F.col("sib_parent") == F.col("parent_nid"), F.col("sib")).alias("next_sibling"),
        )
    )
    full = written(full.drop("sib", "sib_parent"), "trie-full")
    enter = full.select(
        (2 * F.col("nid")).alias("arc"),
        F.when(F.col("first_child").isNotNull(), 2 * F.col("first_child")).otherwise(2 * F.col("nid") + 1).alias("next"),
    )
    leave = full.select(
        (2 * F.col("nid") + 1).alias("arc"),
        F.when(F.col("next_sibling").isNotNull(), 2 * F.col("next_sibling"))
        .when(F.col("parent_nid").isNotNull(), 2 * F.col("parent_nid") + 1)
        .alias("next"),
    )
    ranked = rank_list(enter.unionByName(leave))
    n_arcs = 2 * full.count()
    placed = ranked.select("arc", (F.lit(n_arcs - 1) - F.col("rank")).alias("at"))
    values = full.select(
        (2 * F.col("nid")).alias("arc"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).cast("bigint").alias("saved"),
    )
    tour = placed.join(values, "arc", "left").select(
        "arc", "at", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("saved", F.lit(0)).alias("saved")
    )
    summed = running(tour, "at", {"run_leaf": ("sum", "leaf"), "run_saved": ("sum", "saved")})
    per_node = summed.groupBy(F.shiftright("arc", 1).alias("nid")).agg(
        F.max(F.when(F.col("arc") % 2 == 1, F.col("run_leaf"))).alias("leaf_out"),
        F.max(F.when(F.col("arc") % 2 == 0, F.col("run_leaf") - F.col("leaf"))).alias("leaf_in"),
        F.max(F.when(F.col("arc") % 2 == 1, F.col("run_saved"))).alias("saved_out"),
        F.max(F.when(F.col("arc") % 2 == 0, F.col("run_saved") - F.col("saved"))).alias("saved_in"),
    )
    ends = members.join(lengths, "conv_id").where(F.col("node.depth") == F.col("n_turns"))
    ends = ends.join(nodes.select("node", "nid"), "node").select("nid", "conv_id")
    digests = _ends_digest(ends)
    out = full.join(per_node, "nid").join(digests, "nid", "left")
    return out.select(
        F.col("conv_id").cast("bigint"),
        F.col("depth").cast("bigint"),
        F.col("parent_conv_id").cast("bigint"),
        F.col("n_convs").cast("bigint"),
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        (F.col("leaf_out") - F.col("leaf_in")).cast("bigint").alias("n_leaves"),
        (F.col("saved_out") - F.col("saved_in")).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
