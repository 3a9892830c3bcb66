"""Prefix trie of conversations: every distinct beginning with its members, leaves and shared words.

1. Turns are dictionary-encoded: the code of a turn is a 64-bit hash of role and text.  The dictionary (one entry
   a distinct turn, by SHA-256) shows whether a code stands for two turns; then another seed is taken, so codes are exact.
2. Conversations become rows of codes, sorted by (codes, id) into range shards.  Equal conversations, however many,
   lie in a row of shards.
3. A shard builds a ternary search tree over its distinct code sequences, the median first, so that the branches
   at each turn are balanced.  An iterative traversal visits the prefixes in order and adds up members, leaves and
   savings.  No recursion: a conversation may have any number of turns.
4. A prefix can go on in another shard only if it begins the shard's first or last sequence.  These boundary
   nodes are given out unfinished, with what their finished descendants add up to, and merged in groups of
   neighbouring shards, ``GROUP`` at a time, level by level, until none is left.  A finished node below a boundary node gets its
   parent's id by a join on (shard, boundary node).

The ids that end at a boundary node are hashed in a stream over pieces of ``PIECE`` ids; no list of members is collected.
A conversation is one row of 16 bytes a turn, and a task holds the code sequences of one shard.

Null roles and texts count as empty, and null turns come first.  Turns with an equal number go by role, then by
code.  Rows without a conversation id belong to no conversation and are left out; an id only ever used as ``c - c % 20``
without rows of its own is no conversation.  Repeated rows are turns of their own.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import map_arrow, written

#: Neighbouring shards merged at a time, and ids of members in one piece of an unfinished list.
GROUP, PIECE = 64, 4096
#: Words are what is between white space.
WORD = r"[^\x20\x09-\x0D]+"
NOTHING = hashlib.sha256(b"").hexdigest()


def coded_turns(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, code, words`` of every turn that has a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(id_col).isNotNull())
    seed = 0
    while True:
        code = F.xxhash64(F.lit(seed), role, text)
        # the length keeps "a" + "bc" apart from "ab" + "c"
        entry = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
        twice = rows.groupBy(code.alias("code")).agg(F.min(entry).alias("a"), F.max(entry).alias("b")).where("a <> b")
        if twice.isEmpty():
            return rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), code.alias("code"), F.regexp_count(text, F.lit(WORD)).alias("words"))
        seed += 1


def rebuilt(turns: DataFrame, *, family: int = 20, most: int = 4, head: Callable[[Column], Column] | None = None) -> DataFrame:
    """``conv_id, codes, words``: the first h turns of conversation c - c % family, then the own turns after the first h.

    ``head(id)`` is h, below ``most``; by default the crc32 of the id in decimal modulo ``most``.  One exchange: a
    family's conversations come to one task, since they share the conversation that their heads are taken from.
    """
    chief = F.col("conv_id") - F.col("conv_id") % family
    h = head(F.col("conv_id")) if head else F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = F.sort_array(F.collect_list(F.struct("turn", "role", "code", "words")))
    rows = turns.withColumn("family", chief).repartition("family").groupBy("family", "conv_id").agg(own.alias("own"))
    rows = rows.withColumn("own", F.transform("own", lambda t: F.struct(t.code, t.words)))
    first = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("own", 1, most - 1))).over(W.partitionBy("family"))
    rows = rows.withColumn("first", first).withColumn("h", h.cast("int"))
    taken = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.array().cast(rows.schema["own"].dataType))
    kept = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    rows = rows.select("conv_id", F.concat(taken, kept).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda t: t.code).alias("codes"), F.transform("t", lambda t: t.words).alias("words"))


class SearchTree:
    """Ternary search tree: each node has a code, lower and higher siblings, and the node of the next turn."""

    def __init__(self):
        self.code: list[int] = []
        self.words: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.next: list[int] = []
        self.ends: list[int] = []  # number of the sequence that ends here, or -1
        self.root = -1

    def insert(self, codes: list[int], words: list[int], number: int) -> None:
        links, key = None, 0  # where the place being looked at is linked from
        at, last = self.root, -1
        for code, w in zip(codes, words):
            while at >= 0 and self.code[at] != code:
                links, key = (self.low if code < self.code[at] else self.high), at
                at = links[at]
            if at < 0:
                at = len(self.code)
                for column, value in ((self.code, code), (self.words, w), (self.low, -1), (self.high, -1), (self.next, -1), (self.ends, -1)):
                    column.append(value)
                if links is None:
                    self.root = at
                else:
                    links[key] = at
            last, links, key = at, self.next, at
            at = self.next[at]
        self.ends[last] = number

    def walk(self):
        """(depth, code, words, number of the sequence that ends there or -1) of all nodes in code order, parents first."""
        todo = [(self.root, 1, False)] if self.root >= 0 else []
        while todo:
            at, depth, lower_done = todo.pop()
            if not lower_done:
                todo.append((at, depth, True))
                if self.low[at] >= 0:
                    todo.append((self.low[at], depth, False))
                continue
            yield depth, self.code[at], self.words[at], self.ends[at]
            if self.high[at] >= 0:
                todo.append((self.high[at], depth, False))
            if self.next[at] >= 0:
                todo.append((self.next[at], depth + 1, False))


def median_first(n: int):
    """0 to n - 1, the middle of each range before its halves."""
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            todo += [(mid + 1, hi), (lo, mid)]


class Node:
    """A prefix and what is known of its subtree.  ``leaves`` and ``saved`` leave out the node itself until it is finished."""

    __slots__ = ("depth", "code", "words", "n", "conv", "children", "leaves", "saved", "ends", "path", "edge", "known", "parent")

    def __init__(self, depth, code, words, path=b""):
        self.depth, self.code, self.words, self.path = depth, code, words, path
        self.n = self.children = self.leaves = self.saved = 0
        self.conv, self.ends, self.edge, self.known, self.parent = None, None, False, [], None

    def absorb(self, n: int, conv: int | None) -> None:
        self.n += n
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv

    def finish(self) -> None:
        self.saved += (self.n - 1) * self.words
        self.leaves += self.children == 0


def _close(node: Node, parent: Node | None, out: list[Node]) -> None:
    """``node`` and its subtree are whole: give it out, unless it lies on the edge, and tell its parent."""
    if parent is not None:
        node.parent = parent
        if not node.edge:
            parent.absorb(node.n, node.conv)
    if not node.edge:
        node.finish()
        if parent is not None:
            parent.children += 1
            parent.leaves += node.leaves
            parent.saved += node.saved
    out.append(node)


NODE = "kind string, shard int, place int, depth int, code long, words int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, path binary, parent_conv_id long, parent_path binary"
_NAMES = [c.split()[0] for c in NODE.split(", ")]
_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def _step(path: bytes, code: int) -> bytes:
    """Name of the prefix one turn longer."""
    return hashlib.sha256(path + code.to_bytes(8, "little", signed=True)).digest()


ROOT = hashlib.sha256(b"root").digest()


def _shard(batches):
    """One shard's rows (codes, words, conv_id), sorted: its finished nodes, boundary nodes and pieces of their members."""
    shard = TaskContext.get().partitionId()
    sequences: list[tuple] = []  # codes, words
    members: list[list] = []  # number, smallest, hash of the ids (of the first and the last sequence: the ids)
    ids: list[int] = []  # of the sequence that is being read

    def ended():
        if members:
            members[-1][0] += len(ids)
            if members[-1][2] is None:
                members[-1][2] = hashlib.sha256()
                members[-1][1] = ids[0]
            else:
                members[-1][2].update(b",")
            members[-1][2].update(",".join(map(str, ids)).encode())
            members[-1][3].append(np.array(ids, dtype="<i8"))
            ids.clear()

    for batch in batches:
        codes, words, convs = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for c, w, conv in zip(codes.to_pylist(), words, convs):
            if not sequences or c != sequences[-1][0]:
                if ids:
                    ended()
                if len(members) > 1:
                    members[-1][3] = None  # neither the first nor, as it turns out, the last one
                sequences.append((c, w))
                members.append([0, None, None, []])
            ids.append(conv)
            if len(ids) >= PIECE:
                ended()
    if not sequences:
        return
    if ids:
        ended()

    tree = SearchTree()
    first, last = sequences[0][0], sequences[-1][0]
    at_root = 0 if not first else -1
    for i in median_first(len(sequences)):
        if sequences[i][0]:
            tree.insert(*sequences[i], i)

    out: list[Node] = []
    edges: list[Node] = []
    root = Node(0, 0, 0, ROOT)
    root.edge = True
    stack, on_first, on_last = [root], True, True
    edges.append(root)
    own: dict[int, int] = {}  # place of an edge node -> sequence that ends there
    if at_root == 0:
        root.absorb(members[0][0], members[0][1])
        own[0] = 0
    # how far the path walked so far follows the first and the last sequence
    follow_first, follow_last = [True], [True]
    for depth, code, words, number in tree.walk():
        while len(stack) > depth:
            _close(stack.pop(), stack[-1], out)
            follow_first.pop()
            follow_last.pop()
        on_first = follow_first[-1] and depth <= len(first) and first[depth - 1] == code
        on_last = follow_last[-1] and depth <= len(last) and last[depth - 1] == code
        follow_first.append(on_first)
        follow_last.append(on_last)
        node = Node(depth, code, words)
        node.edge = on_first or on_last
        if node.edge:
            node.path = _step(stack[-1].path, code)
            if number >= 0:
                own[len(edges)] = number
            edges.append(node)
        if number >= 0:
            node.absorb(members[number][0], members[number][1])
            if not node.edge:
                node.ends = members[number][2].hexdigest()
        stack.append(node)
    while len(stack) > 1:
        _close(stack.pop(), stack[-1], out)

    done = [v for v in out if not v.edge]
    for at in range(0, len(done), 10_000):
        yield _rows(
            [
                ("done", shard, None, v.depth, v.code, v.words, v.conv, v.n, v.children, v.leaves, v.saved, v.ends or NOTHING, None, None if v.parent.edge else v.parent.conv, v.parent.path if v.parent.edge else None)
                for v in done[at : at + 10_000]
            ]
        )
    yield _rows([("edge", shard, i, v.depth, v.code, v.words, v.conv, v.n, v.children, v.leaves, v.saved, None, v.path, None, None) for i, v in enumerate(edges)])
    for place, number in own.items():
        if members[number][3] is None:  # ends at the edge, but all its members are here
            yield _rows([("whole", shard, place, None, None, None, None, None, None, None, None, members[number][2].hexdigest(), edges[place].path, None, None)])
            continue
        for piece in members[number][3]:
            yield _rows([("ends", shard, place, None, None, None, int(piece[0]), len(piece), None, None, None, ",".join(map(str, piece.tolist())), edges[place].path, None, None)])


def _merge_all(rows: pd.DataFrame) -> pd.DataFrame:
    return _merged(rows, last=True)


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    return _merged(rows, last=False)


def _merged(rows: pd.DataFrame, last: bool) -> pd.DataFrame:
    """The boundary nodes of neighbouring shards, each shard's in trie order, as those of one shard.

    ``n_convs`` and the others of a boundary node count what ends at it and its finished descendants, not other boundary
    nodes.  Nodes that do not lie on the edge of the whole group are finished; in the ``last`` merge all are.
    """
    rows = rows.sort_values(["shard", "place"])
    root, order = None, []
    stack: list[Node] = []
    kids: dict[int, list[Node]] = {}
    for shard, part in rows.groupby("shard", sort=True):
        depth_at: list[Node] = []
        for r in part.itertuples(index=False):
            del depth_at[r.depth :]
            if r.depth == 0:
                root = node = root or Node(0, 0, 0, ROOT)
                if not order:
                    order.append(root)
                    kids[id(root)] = []
            else:
                siblings = kids[id(depth_at[-1])]
                # shards are in code order, so an equal node is the last one so far
                if siblings and siblings[-1].code == r.code:
                    node = siblings[-1]
                else:
                    node = Node(r.depth, r.code, r.words, r.path)
                    node.parent = depth_at[-1]
                    siblings.append(node)
                    kids[id(node)] = []
                    order.append(node)
            depth_at.append(node)
            node.absorb(int(r.n_convs), None if pd.isna(r.conv_id) else int(r.conv_id))
            node.children += int(r.n_children)
            node.leaves += int(r.n_leaves)
            node.saved += int(r.saved_tokens)
    group = int(rows["group"].iloc[0])
    if not last:
        for pick in (0, -1):
            node = root
            while node is not None:
                node.edge = True
                node = kids[id(node)][pick] if kids[id(node)] else None
    stack.append(root)
    visited = []
    while stack:  # parents first, children in code order
        node = stack.pop()
        visited.append(node)
        stack += reversed(kids[id(node)])
    for node in reversed(visited):
        if node.edge:
            continue
        node.finish()
        if node.parent is not None:
            node.parent.children += 1
            node.parent.leaves += node.leaves
            node.parent.saved += node.saved
            node.parent.absorb(node.n, node.conv)
    found, place = [], 0
    for node in visited:
        kind, at = ("edge", place) if node.edge else ("done", None)
        place += node.edge
        found.append((kind, group, at, node.depth, node.code, node.words, node.conv, node.n, node.children, node.leaves, node.saved, None, node.path, None, node.parent.path if node.parent is not None else None))
    return pd.DataFrame(found, columns=_NAMES)


def _hash_pieces(batches):
    """Rows (path, first id, ids as text) in order of both: SHA-256 of the joined ids of each path."""
    path, state = None, None
    for batch in batches:
        out = []
        for p, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if p != path:
                if path is not None:
                    out.append((path, state.hexdigest()))
                path, state = p, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string()))], ["path", "ends"])
    if path is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([state.hexdigest()])], ["path", "ends"])


def trie(sequences: DataFrame) -> DataFrame:
    """Nodes of the trie over ``sequences`` (conv_id, codes, words).

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    rows = sequences.select("codes", "words", "conv_id").repartitionByRange("codes", "conv_id").sortWithinPartitions("codes", "conv_id")
    found = written(map_arrow(rows, _shard, NODE), "trie")
    nodes = found.where("kind = 'done'")
    edges = first_edges = found.where("kind = 'edge'")
    merged = None
    top = edges.agg(F.max("shard")).first()[0]
    while top is not None:
        last = top < GROUP
        groups = edges.withColumn("group", F.floor(F.col("shard") / GROUP).cast("int")).groupBy("group")
        step = written(groups.applyInPandas(_merge if not last else _merge_all, NODE), "trie-merge")
        own = step.where("kind = 'done'")
        merged = own if merged is None else merged.unionByName(own)
        edges, top = step.where("kind = 'edge'"), None if last else top // GROUP
    if merged is None:
        return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

    pieces = found.where("kind = 'ends'").select("path", F.col("conv_id").alias("first"), F.col("ends_sha256").alias("text"))
    ends = map_arrow(pieces.repartition("path").sortWithinPartitions("path", "first"), _hash_pieces, "path binary, ends string")
    ends = ends.unionByName(found.where("kind = 'whole'").select("path", F.col("ends_sha256").alias("ends")))
    named = merged.select(F.col("path").alias("of"), F.col("conv_id").alias("named"))
    whole = merged.drop("ends_sha256", "parent_conv_id").join(ends, "path", "left").join(named, F.col("parent_path") == F.col("of"), "left")
    whole = whole.withColumn("ends_sha256", F.coalesce("ends", F.lit(NOTHING))).withColumn("parent_conv_id", F.col("named"))
    # a shard asks for the ids of its own boundary nodes, so that no node with many children is a hot key
    asked = first_edges.select("shard", "path").join(named, F.col("path") == F.col("of")).select(F.col("shard").alias("s"), F.col("path").alias("p"), "named")
    below = nodes.where(F.col("parent_path").isNotNull()).join(asked, (F.col("shard") == F.col("s")) & (F.col("parent_path") == F.col("p"))).withColumn("parent_conv_id", F.col("named"))
    columns = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return nodes.where(F.col("parent_path").isNull()).select(columns).unionByName(below.select(columns)).unionByName(whole.select(columns))


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The trie over the rebuilt ``conversations`` (see the module's first lines)."""
    return trie(written(rebuilt(coded_turns(conversations, **columns)), "rebuilt"))
