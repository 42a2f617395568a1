"""A compacted trie of conversations (a z-fast trie), built and searched by joins.

A conversation is a string of turns. Its prefixes are told apart by 128-bit fingerprints, sums of hashes of (place,
turn), so that a prefix's fingerprint comes from running sums. The trie keeps only nodes where strings end or part
(explicit nodes); the turns between a node and its explicit parent are its edge. Each explicit node is found under its
handle: the prefix whose length is the number in (parent's depth, own depth] that most powers of two divide. A string
finds the place where it leaves the trie by fat binary search, one lookup of a handle a round. Strings come in batches:
each finds its exit, edges are split where strings leave them, and what is left of the batch's strings grows new nodes.
In the end edges are expanded to nodes of single turns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, hot_join, numbered, tidy

#: Turns whose running sums one window takes; what comes before is added from the sums of the blocks before.
BLOCK = 4_096
#: Ids that are hashed as one text; longer lists are hashed chunk after chunk.
CHUNK = 4_096
#: Up to which share of all strings a batch goes. Growing batches: the trie that a batch is searched in is a part of its own size.
BATCHES = (1 / 8, 1.0)


def turns_of(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (conv, depth from 1, total, k, chars): the turns of every conversation, in order of turn (null first, ties by content), null role and text empty.

    Rows without conv_id belong to no conversation and are left out. ``k`` stands for role and text (128 bits).
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    k = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", k.alias("k"), F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    found = numbered(scratch, scratch.save(rows), ["conv"], ["turn", "k", "row"])
    return scratch.save(found.select("conv", (F.col("pos") + 1).alias("depth"), "total", "k", "chars"))


def with_shared_starts(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The turns of conversations that begin as another one does: the first h turns of conversation c - c % 100 (all if it has fewer, none if there is none), then c's own from h + 1 on; h is the CRC-32 of c as decimal text, modulo 6.

    Rows (conv, depth, total, k, chars); one with depth 0 for a conversation that has no turn.
    """
    heads = turns.where("depth = 1").select("conv", "total")
    own = heads.withColumn("h", F.crc32(F.col("conv").cast("string")) % 6).withColumn("base", F.col("conv") - F.col("conv") % 100)
    own = own.join(heads.select(F.col("conv").alias("base"), F.col("total").alias("there")), "base", "left")
    own = own.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    plan = scratch.save(own.select("conv", "h", "base", "taken", (F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("size")))
    rest = hot_join(turns.drop("total"), plan, ["conv"]).where("depth > h").select("conv", (F.col("taken") + F.col("depth") - F.col("h")).alias("depth"), F.col("size").alias("total"), "k", "chars")
    first = plan.where("taken > 0").select("conv", F.col("size").alias("total"), "base", F.explode(F.sequence(F.lit(1), "taken")).alias("depth"))
    first = first.join(turns.where("depth <= 5").select(F.col("conv").alias("base"), "depth", "k", "chars"), ["base", "depth"])
    none = plan.where("size = 0").select("conv", F.lit(0).alias("depth"), "size", F.lit(""), F.lit(0))
    return rest.unionByName(first.select(*rest.columns)).union(none)


def prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (conv, d, total, k1, k2, q1, q2, c, chars): of each prefix its fingerprint, that of the prefix one turn shorter, and code points up to it."""
    a, b = F.xxhash64("k", "depth"), F.xxhash64("depth", "k", F.lit(1))
    low = F.lit(0xFFFFFFFF)
    parts = {"s1": a.bitwiseAND(low), "s2": F.shiftrightunsigned(a, 32), "s3": b.bitwiseAND(low), "s4": F.shiftrightunsigned(b, 32), "c": F.col("chars")}
    rows = turns.where("depth > 0").select("conv", "depth", "total", "chars", F.floor((F.col("depth") - 1) / BLOCK).alias("block"), *(v.alias(f"x{k}") for k, v in parts.items()))
    w = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = scratch.save(rows.select("conv", "depth", "total", "chars", "block", *(f"x{k}" for k in parts), *(F.sum(f"x{k}").over(w).alias(k) for k in parts)))
    sums = local.where(f"total > {BLOCK}").groupBy("conv", "block").agg(*(F.sum(f"x{k}").alias(k) for k in parts))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv", "block", *(F.sum(k).over(before).alias(f"b{k}") for k in parts))
    far = local.where("block > 0").join(sums, ["conv", "block"]).select(*(c for c in local.columns if c not in parts), *((F.col(k) + F.col(f"b{k}")).alias(k) for k in parts))
    whole = local.where("block = 0").unionByName(far)
    less = {k: F.col(k) - F.col(f"x{k}") for k in parts}
    start = F.col("depth") == 1
    q1, q2 = (F.when(start, 0).otherwise(F.xxhash64(less[x], less[y])) for x, y in (("s1", "s2"), ("s3", "s4")))
    return scratch.save(whole.select("conv", F.col("depth").alias("d"), "total", F.xxhash64("s1", "s2").alias("k1"), F.xxhash64("s3", "s4").alias("k2"), q1.alias("q1"), q2.alias("q2"), "c", "chars"))


def fattest(low: str, high: str) -> Column:
    """Of the numbers in (low, high] the one that most powers of two divide."""
    return F.expr(f"shiftleft(-1L, length(bin({low} ^ {high})) - 1) & {high}")


#: An explicit node: fingerprint, depth, code points; the same of its explicit parent; a string through it; its handle; the first prefix on its edge.
NODE = "k1 long, k2 long, e long, c long, p1 long, p2 long, p long, pc long, rep long, f1 long, f2 long, c1 long, c2 long"


def with_handles(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """``nodes`` (up to rep) with their handles and the first prefixes on their edges."""
    at = lambda d, x: paths.select(F.col("sid").alias("rep"), F.col("d").alias(d), F.col("k1").alias(f"{x}1"), F.col("k2").alias(f"{x}2"))
    n = nodes.withColumn("f", fattest("p", "e")).withColumn("g", F.col("p") + 1)
    return n.join(at("f", "f"), ["rep", "f"]).join(at("g", "c"), ["rep", "g"]).selectExpr(*(x.split()[0] for x in NODE.split(", ")))


def locate(strings: DataFrame, nodes: DataFrame, paths: DataFrame, all_paths: DataFrame, scratch: Scratch) -> DataFrame:
    """Where each of ``strings`` (sid, size) leaves the trie: base node on its path (p, p1, p2, pc), depth m up to which it follows the trie, and the node (x1, x2, xe) in whose edge it leaves (null: at the base).

    Rounds of fat binary search: the handle of the fattest length between what has been found and what can't be is
    looked up; if it is there, the search goes on below that node, else above the handle. ``paths``: prefixes of
    ``strings``; ``all_paths``: also those of the strings that are in the trie.
    """
    none = F.lit(None).cast("long")
    state = scratch.save(strings.select("sid", "size", F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"), none.alias("n1"), none.alias("n2")))
    handles = nodes.select("f1", "f2", "e", F.col("k1").alias("h1"), F.col("k2").alias("h2"))
    at = paths.select("sid", F.col("d").alias("f"), F.col("k1").alias("f1"), F.col("k2").alias("f2"))
    n = nodes.count()
    while not (open_ := state.where("lo < hi")).isEmpty():
        asked = open_.withColumn("f", fattest("lo", "hi")).join(at, ["sid", "f"])
        met = F.col("e").isNotNull()
        found = hot_join(asked, handles, ["f1", "f2"], "left", scratch, n).select("sid", "size", F.when(met, F.col("e")).otherwise(F.col("lo")).alias("lo"), F.when(met, F.col("hi")).otherwise(F.col("f") - 1).alias("hi"), F.when(met, F.col("h1")).otherwise(F.col("n1")).alias("n1"), F.when(met, F.col("h2")).otherwise(F.col("n2")).alias("n2"))
        new = scratch.save(found.unionByName(state.where("lo >= hi")))
        scratch.drop(state)
        state = new
    # the last node found is on the string's path, or the string leaves in its edge
    known = nodes.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), "e", "c", "p", "p1", "p2", "pc", "rep")
    last = hot_join(state.where("n1 is not null").drop("lo", "hi"), known, ["n1", "n2"], rows=n)
    last = last.join(paths.select("sid", F.col("d").alias("e"), F.col("k1").alias("o1"), F.col("k2").alias("o2")), ["sid", "e"], "left")
    last = scratch.save(last.withColumn("full", F.coalesce((F.col("o1") == F.col("n1")) & (F.col("o2") == F.col("n2")), F.lit(False))))
    inside = last.where("not full").select("sid", "size", "p", "p1", "p2", "pc", F.col("n1").alias("x1"), F.col("n2").alias("x2"), F.col("e").alias("xe"), "rep")
    zero = F.lit(0).cast("long")
    base = last.where("full").select("sid", "size", F.col("e").alias("p"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("c").alias("pc"))
    base = base.unionByName(state.where("n1 is null").select("sid", "size", zero.alias("p"), zero.alias("p1"), zero.alias("p2"), zero.alias("pc")))
    # below a node on the path: the child whose edge begins as the string goes on
    child = nodes.select("c1", "c2", F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.col("e").alias("xe"), "rep")
    following = base.where("p < size").withColumn("g", F.col("p") + 1).join(paths.select("sid", F.col("d").alias("g"), F.col("k1").alias("c1"), F.col("k2").alias("c2")), ["sid", "g"]).drop("g")
    below = hot_join(following, child, ["c1", "c2"], "left", scratch, n).drop("c1", "c2")
    exits = scratch.save(inside.unionByName(below).unionByName(base.where("p = size").select("*", *(F.lit(None).cast("long").alias(c) for c in ("x1", "x2", "xe", "rep")))))
    # how far the string follows the edge: prefixes of the string and of the edge's own string, side by side
    edges = scratch.save(exits.where("x1 is not null").select("sid", "p", "xe", "rep"))
    mine = hot_join(paths.select("sid", "d", "k1", "k2"), edges, ["sid"]).where("d > p and d <= xe").select("sid", F.struct("rep", "d").alias("at"), "k1", "k2")
    theirs = all_paths.select(F.col("sid").alias("rep"), "d", F.col("k1").alias("o1"), F.col("k2").alias("o2"))
    theirs = scratch.save(theirs.join(edges.select("rep").distinct(), "rep", "left_semi").select(F.struct("rep", "d").alias("at"), "o1", "o2"))
    same = hot_join(mine, theirs, ["at"], scratch=scratch).where("k1 = o1 and k2 = o2").groupBy("sid").agg(F.max("at.d").alias("m"))
    return scratch.save(exits.drop("rep").join(same, "sid", "left").withColumn("m", F.coalesce("m", "p")))


def insert(strings: DataFrame, nodes: DataFrame | None, paths: DataFrame, all_paths: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the trie after ``strings`` (sid, size), all different and none in it yet, have gone in. ``paths``: their prefixes."""
    if nodes is None:
        zero = F.lit(0).cast("long")
        found = scratch.save(strings.select("sid", "size", *(zero.alias(c) for c in ("p", "p1", "p2", "pc", "m")), *(F.lit(None).cast("long").alias(c) for c in ("x1", "x2", "xe"))))
    else:
        found = locate(strings, nodes, paths, all_paths, scratch)
    tails = scratch.save(hot_join(paths, found, ["sid"]).where("d > p"))
    key = ["k1", "k2"]
    ends = tails.where("d = size").select(*key)
    splits = tails.where("x1 is not null and d = m").select(*key)
    partings = tails.where("d > m + 1").groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(*(f(c).alias(f"{n}{c}") for c in key for n, f in (("a", F.min), ("b", F.max)))).where("ak1 <> bk1 or ak2 <> bk2").select(*key)
    new = scratch.save(ends.unionByName(splits).unionByName(partings).distinct())
    marked = hot_join(tails.select("sid", "d", *key, "c", "p", "p1", "p2", "pc"), new, key)
    w = Window.partitionBy("sid").orderBy("d")
    parent = F.coalesce(F.lag(F.struct("d", "k1", "k2", "c")).over(w), F.struct(F.col("p").alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("pc").alias("c")))
    grown = marked.withColumn("up", parent).groupBy(*key).agg(F.first("d").alias("e"), F.first("c").alias("c"), F.first("up").alias("up"), F.min("sid").alias("rep"))
    grown = grown.select(*key, "e", "c", F.col("up.k1").alias("p1"), F.col("up.k2").alias("p2"), F.col("up.d").alias("p"), F.col("up.c").alias("pc"), "rep")
    if nodes is None:
        return scratch.save(with_handles(scratch.save(grown), all_paths))
    # a split edge's lower end hangs from the lowest split
    cut = tails.where("x1 is not null and d = m and m < xe").groupBy(F.col("x1").alias("k1"), F.col("x2").alias("k2")).agg(F.max(F.struct("d", "k1", "k2", "c")).alias("up"))
    cut = scratch.save(cut)
    moved = nodes.join(cut, key).select(*key, "e", "c", F.col("up.k1").alias("p1"), F.col("up.k2").alias("p2"), F.col("up.d").alias("p"), F.col("up.c").alias("pc"), "rep")
    changed = with_handles(scratch.save(grown.unionByName(moved)), all_paths)
    return scratch.save(nodes.join(cut, key, "left_anti").unionByName(changed))


def hashed_ids(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Of each (k1, k2) of ``members`` (k1, k2, conv) the SHA-256 of its ids: decimal, ascending, joined by commas.

    Ids are numbered without bringing a group together and joined in chunks; a group of several chunks is hashed as a
    stream, chunk after chunk, so a task holds one batch of chunks however large the group is.
    """
    placed = numbered(scratch, members.select("k1", "k2", "conv"), ["k1", "k2"], ["conv"])
    chunks = placed.groupBy("k1", "k2", F.floor(F.col("pos") / CHUNK).alias("chunk")).agg(F.first("total").alias("total"), F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    chunks = scratch.save(chunks)

    @tidy
    def stream(batches):
        key, running = None, None
        for b in batches:
            done = []
            for k1, k2, ids in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if (k1, k2) != key:
                    if running:
                        done.append((*key, running.hexdigest()))
                    key, running = (k1, k2), hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.encode())
            yield rows_of(done)
        if running:
            yield rows_of([(*key, running.hexdigest())])

    many = chunks.where(f"total > {CHUNK}").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "chunk").select("k1", "k2", "ids")
    return scratch.save(chunks.where(f"total <= {CHUNK}").select("k1", "k2", F.sha2("ids", 256).alias("ends_sha256")).unionByName(many.mapInArrow(stream, "k1 long, k2 long, ends_sha256 string")))


def rows_of(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in done], t) for i, (n, t) in enumerate((("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())))})


def subtrees(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes`` (k1, k2, p1, p2, p and sums n, lo, leaves, total, own) with the sums taken over their subtrees.

    Each node hands what it has to the node 2^r above it in round r and then looks twice as far: as many rounds as the
    logarithm of the trie's height in explicit nodes.
    """
    key = ["k1", "k2"]
    state = scratch.save(nodes.select(*key, F.when(F.col("p") > 0, F.col("p1")).alias("j1"), F.when(F.col("p") > 0, F.col("p2")).alias("j2"), "n", "lo", "leaves", "total", "own"))
    while not (going := state.where("j1 is not null")).isEmpty():
        given = going.groupBy(F.col("j1").alias("k1"), F.col("j2").alias("k2")).agg(*(F.sum(c).alias(f"g_{c}") for c in ("n", "leaves", "total", "own")), F.min("lo").alias("g_lo"))
        jumps = hot_join(going.select(*key, "j1", "j2"), state.select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.col("j1").alias("i1"), F.col("j2").alias("i2")), ["j1", "j2"]).select(*key, "i1", "i2")
        both = state.drop("j1", "j2").join(given, key, "left").join(jumps, key, "left")
        new = scratch.save(both.select(*key, F.col("i1").alias("j1"), F.col("i2").alias("j2"), *((F.col(c) + F.coalesce(f"g_{c}", F.lit(0))).alias(c) for c in ("n", "leaves", "total", "own")), F.least("lo", "g_lo").alias("lo")))
        scratch.drop(state)
        state = new
    return state


def prefix_trie(turns: DataFrame, scratch: Scratch, batches: tuple[float, ...] = BATCHES) -> DataFrame:
    """The trie of the conversations in ``turns`` (conv, depth from 1, total, k, chars; depth 0: no turn), a row for each node, the root too.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes
    of the subtree), saved_tokens (of all nodes of the subtree, members but one times the code points of the last turn),
    ends_sha256 (of the ids of the members that end here). Equal conversations are one string, however many they are.
    No conversations give no rows.
    """
    every = prefixes(turns, scratch)
    zero = F.lit(0).cast("long")
    none = turns.where("depth = 0").select("conv", zero.alias("d"), zero.alias("k1"), zero.alias("k2"), zero.alias("c"))
    members = scratch.save(every.where("d = total").select("conv", "d", "k1", "k2", "c").unionByName(none))
    strings = scratch.save(members.groupBy("k1", "k2").agg(F.min("conv").alias("sid"), F.count("*").alias("w"), F.max("d").alias("size"), F.max("c").alias("c")))
    of = lambda df, s: hot_join(df, s, ["sid"])
    paths = scratch.save(of(every.drop("total").withColumnRenamed("conv", "sid"), scratch.save(strings.where("size > 0").select("sid"))))
    scratch.drop(every)

    share = F.pmod(F.xxhash64("sid"), F.lit(1 << 16)) / (1 << 16)
    nodes, low = None, 0.0
    for high in batches:
        batch = scratch.save(strings.where((F.col("size") > 0) & (share >= low) & (share < high)).select("sid", "size"))
        low = high
        if not batch.isEmpty():
            own = scratch.save(of(paths, batch.select("sid"))) if len(batches) > 1 else paths
            nodes = insert(batch, nodes, own, paths, scratch)
    if nodes is None:
        nodes = turns.sparkSession.createDataFrame([], NODE)

    key = ["k1", "k2"]
    kids = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("kids"))
    full = scratch.save(nodes.select(*key, "e", "c", "p1", "p2", "p", "pc", "rep").join(kids, key, "left").join(strings.select(*key, "sid", "w"), key, "left").withColumn("kids", F.coalesce("kids", zero)).withColumn("w", F.coalesce("w", zero)))
    leaves = F.when(F.col("kids") == 0, 1).otherwise(0).cast("long")
    start = full.select(*key, "p1", "p2", "p", F.col("w").alias("n"), F.col("sid").alias("lo"), leaves.alias("leaves"), (F.col("w") * F.col("c")).alias("total"), (F.col("c") - F.col("pc")).alias("own"))
    sums = subtrees(start, scratch)
    ends = hashed_ids(members, scratch)

    # edges become nodes of single turns again; blocks keep the lists of depths short
    first = members.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    tops = sums.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("lo").alias("above")).union(first.select(zero, zero, "conv_id"))
    u = scratch.save(full.join(sums, key).join(ends, key, "left"))
    u = scratch.save(hot_join(u, scratch.save(tops), ["p1", "p2"]))
    edge = u.select("*", F.explode(F.sequence(F.floor(F.col("p") / BLOCK), F.floor((F.col("e") - 1) / BLOCK))).alias("block"))
    edge = edge.select("*", F.explode(F.sequence(F.greatest(F.col("block") * BLOCK, F.col("p")) + 1, F.least((F.col("block") + 1) * BLOCK, F.col("e")))).alias("d"))
    rows = edge.withColumnRenamed("c", "ce").join(paths.select(F.col("sid").alias("rep"), "d", (F.col("c") - F.col("chars")).alias("before")), ["rep", "d"])
    at_end, nobody = F.col("d") == F.col("e"), F.lit(hashlib.sha256(b"").hexdigest())
    saved = F.col("total") - F.col("n") * F.col("before") - (F.col("own") - (F.col("ce") - F.col("pc"))) - (F.col("ce") - F.col("before"))
    parent = F.when(F.col("d") > F.col("p") + 1, F.col("lo")).otherwise(F.col("above"))
    inner = rows.select(
        F.col("lo").alias("conv_id"), F.col("d").alias("depth"), parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(at_end, F.col("kids")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.when(at_end, F.coalesce("ends_sha256", nobody)).otherwise(nobody).alias("ends_sha256"),
    )
    # the root: sums over all nodes, each a row
    below = full.agg(F.count_if(F.col("p") == 0).alias("n_children"), F.sum(leaves).alias("n_leaves"), F.sum(F.col("w") * F.col("c") - (F.col("c") - F.col("pc"))).alias("saved"))
    here = ends.where("k1 = 0 and k2 = 0").select("ends_sha256")
    parts = first.unionByName(below, True).unionByName(here, True)
    root = parts.agg(*(F.max(c).alias(c) for c in parts.columns)).where("n_convs is not null").select(
        "conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"), F.coalesce("ends_sha256", nobody).alias("ends_sha256"),
    )
    return inner.unionByName(root)


def conversation_trie(conversations: DataFrame, shared_starts: bool = True, batches: tuple[float, ...] = BATCHES) -> DataFrame:
    """``prefix_trie`` of ``conversations`` (conv_id, turn, role, text), as they are or rebuilt by ``with_shared_starts``.

    Null role or text is empty, turns without number come first, turns alike in number are ordered by content, repeated
    rows are turns of their own, rows without conv_id are left out, an empty table gives no rows; other columns are
    ignored. No conversation, string, node or id list has to fit in a task.
    """
    scratch = Scratch(conversations.sparkSession)
    turns = turns_of(conversations, scratch)
    return prefix_trie(scratch.save(with_shared_starts(turns, scratch)) if shared_starts else turns, scratch, batches)
