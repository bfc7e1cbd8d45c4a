"""A prefix trie over conversations, with smallest-member ownership.

1. Turns get their places in their conversation by one sort over all tasks; conversations are rebuilt with
   the first turns of the one they branch from.
2. A prefix is known by two 64-bit exclusive-or sums over its turns' hashes, taken with their depth: running
   windows over blocks of turns of a conversation, then over its blocks.
3. Every node belongs to its smallest member, so that a conversation owns a suffix of its path; a window over
   an owner's nodes finds where that begins. For a member and a node, the tokens from the node on less those
   of nodes that the member owns are what sharing saves, and the member that owns the leaf at its own end
   counts it. One group-by of prefixes sums both.

The smallest member is found by an aggregation and not by a window over the prefix, which would bring
everybody's first turn into one task. The root and common turns are summed in the tasks before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered

#: Turns of a conversation in one window, and turns whose conversations' ids make one piece of a node's ends.
BLOCK, PIECE = 4096, 16_384
GROUP, HEADS = 20, 4
NODE = ["depth", "x1", "x2"]


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, at, c1 .. c4, tokens): a row for each turn, `at` its place in the table sorted by conversation and turn."""
    col = lambda c: F.col(f"`{c}`")
    clean = conversations.select(col(conv).cast("long").alias("conv_id"), col(turn).cast("long").alias("turn"), *[F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    sha = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    told = clean.where("conv_id is not null").select("conv_id", "turn", sha.alias("sha"), words.alias("tokens"))
    placed = numbered(told, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("sha")], "at", "turns")
    return placed.select("conv_id", "at", *[F.conv(F.substring("sha", 1 + 15 * k, 15), 16, 10).cast("long").alias(f"c{k + 1}") for k in range(4)], "tokens")


def _running(rows: DataFrame) -> DataFrame:
    """Adds x1, x2 (sums of z1, z2 up to this turn) and upto (tokens up to this turn), a conversation's blocks at a time."""
    sums = {"x1": F.bit_xor("z1"), "x2": F.bit_xor("z2"), "upto": F.sum("tokens")}
    blocks = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    inner = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    within = blocks.select("*", *[f.over(inner).alias(k) for k, f in sums.items()])
    totals = blocks.groupBy("conv_id", "block").agg(*[f.alias(k) for k, f in sums.items()])
    outer = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    before = totals.select("conv_id", "block", *[F.coalesce(f(k).over(outer), zero).alias(f"b_{k}") for k, f in (("x1", F.bit_xor), ("x2", F.bit_xor), ("upto", F.sum))])
    out = within.join(before, ["conv_id", "block"])
    return out.withColumns({"x1": F.col("x1").bitwiseXOR(F.col("b_x1")), "x2": F.col("x2").bitwiseXOR(F.col("b_x2")), "upto": F.col("upto") + F.col("b_upto")}).drop("block", "b_x1", "b_x2", "b_upto")


def occurrences(conversations: DataFrame, heads: int = HEADS, group: int = GROUP, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A written table with a row for each rebuilt conversation and depth of its path, the root's 0 included.

    Columns: conv_id, depth, x1, x2 (the prefix), p1, p2 (the prefix one turn shorter), after (tokens of this
    turn and all later ones), length (turns of the conversation), start (its first turn's place in the table).
    """
    turns = materialize(_turns(conversations, conv, turn, role, text), "placed")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("at").alias("start"))
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    convs = materialize(convs, "conversations")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("start").alias("base_start"))
    convs = convs.join(bases, "base", "left").withColumn("shared", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = convs.withColumn("length", F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = turns.join(convs.select("conv_id", "start", "h", "shared", "length"), "conv_id").withColumn("pos", F.col("at") - F.col("start"))
    own = own.where("pos >= h").withColumn("depth", F.col("shared") + F.col("pos") - F.col("h") + 1)
    first = turns.where(F.col("conv_id") % group == 0).join(bases, F.col("conv_id") == F.col("base")).withColumn("pos", F.col("at") - F.col("base_start")).where(F.col("pos") < heads - 1)
    branched = convs.where("shared > 0").select("conv_id", "start", "base", "shared", "length").join(first.drop("conv_id"), "base").where("pos < shared").withColumn("depth", F.col("pos") + 1)
    columns = ["conv_id", "start", "length", "depth", "tokens"]
    z = [F.xxhash64(F.lit(k), "depth", "c1", "c2", "c3", "c4").alias(f"z{k}") for k in (1, 2)]
    nothing = F.lit(0).cast("long")
    root = convs.select("conv_id", "start", "length", nothing.alias("depth"), nothing.alias("tokens"), nothing.alias("z1"), nothing.alias("z2"))
    rows = root.unionByName(own.select(*columns, *z)).unionByName(branched.select(*columns, *z))
    path = materialize(_running(rows), "paths")
    total = path.groupBy("conv_id").agg(F.sum("tokens").alias("total"))
    after = F.col("total") - F.col("upto") + F.col("tokens")
    return materialize(path.join(total, "conv_id").select("conv_id", "depth", "x1", "x2", F.col("x1").bitwiseXOR(F.col("z1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("z2")).alias("p2"), after.alias("after"), "length", "start"), "occurrences")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, joined by commas; a node is read piece after piece and never held."""
    key, state = None, None
    for batch in batches:
        done: list = []
        for *k, piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if k == key:
                state.update(b",")
            else:
                done += [(*key, state.hexdigest())] if key else []
                key, state = k, hashlib.sha256()
            state.update(piece.encode())
        yield _told(done)
    if key:
        yield _told([(*key, state.hexdigest())])


def _told(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[*NODE, "ends_sha256"])


def ends_digests(paths: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of the nodes at which conversations end: ids become text in pieces, pieces become digests in order."""
    ends = paths.where("depth = length").withColumn("piece", F.floor(F.col("start") / PIECE))
    pieces = ends.groupBy(*NODE, "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    return dealt.select(*NODE, "ids").mapInArrow(_digests, "depth long, x1 long, x2 long, ends_sha256 string")


def nodes(paths: DataFrame) -> DataFrame:
    """The trie of `occurrences`: a row for each node."""
    found = paths.groupBy(*NODE).agg(
        F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min_by("after", "conv_id").alias("owned"), (F.max("length") == F.col("depth")).alias("leaf"), F.first("p1").alias("p1"), F.first("p2").alias("p2")
    )
    found = materialize(found, "nodes")
    along = Window.partitionBy("owner").orderBy("depth")  # an owner has one node at a depth, and no gap from its first to its last
    first = found.withColumn("k", F.row_number().over(along)).withColumn("ends", F.max("leaf").over(Window.partitionBy("owner"))).where("k = 1")
    first = materialize(first.select(F.col("owner").alias("conv_id"), F.col("depth").alias("since"), F.col("owned").alias("owned_after"), F.col("ends").cast("long").alias("leaf"), "p1", "p2"), "owners")

    marked = paths.select("conv_id", *NODE, "after").join(first.drop("p1", "p2"), "conv_id", "left")
    saved = F.when(F.col("depth") < F.coalesce("since", F.col("depth") + 1), F.col("after") - F.coalesce("owned_after", F.lit(0))).otherwise(0)
    sums = marked.groupBy(*NODE).agg(F.sum(saved).alias("saved_tokens"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"))

    up = found.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
    children = up.groupBy(*NODE).agg(F.count("*").alias("n_children"))
    above = first.where("since > 0").select("conv_id", (F.col("since") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
    above = above.join(found.select(*NODE, F.col("owner").alias("above")), NODE).select("conv_id", "above")

    out = found.join(sums, NODE).join(children, NODE, "left").join(ends_digests(paths), NODE, "left")
    out = out.withColumnRenamed("owner", "conv_id").join(first.select("conv_id", "since"), "conv_id").join(above, "conv_id", "left")
    parent = F.when(F.col("depth") > F.col("since"), F.col("conv_id")).otherwise(F.col("above"))
    return out.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, heads: int = HEADS, group: int = GROUP, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node.

    Conversation c is rebuilt as the first h turns of conversation c - c % group (a remainder has c's sign; h = crc32 of c's digits, modulo
    heads; fewer if it has fewer), then c's own turns after its first h. Defined cases: null roles and texts are
    empty; turns are ordered by number, null first, and turns of one number by the digest of role and text, so
    that any row order gives one result; repeated rows are turns of their own; rows without conv_id count as
    absent; a rebuilt conversation without turns is a member of the root only; no rows give no nodes, not even
    a root; other columns are ignored.
    """
    return nodes(occurrences(conversations, heads, group, conv, turn, role, text))
