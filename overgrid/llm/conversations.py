"""The prefix trie of conversations, by union-find over the sorted neighbours' common prefixes.

Conversations are rebuilt first: the first h turns of conversation c - c % 20, then c's own turns after its first h,
where h is the unsigned CRC-32 of c's decimal form modulo 4.  A node is a distinct sequence of turns (role, text).

1. A turn becomes a digest of 128 bits and a number of words; a conversation the digests one after the other.  Equal
   conversations are one *item* with a count.
2. Items are sorted by ranges of their digests.  Within a part, neighbours are tied by an edge as deep as their common
   prefix is long.  Edges are taken in descending depth: each union of two components is a branching node over their
   tops, or widens the one that is there.  Nodes between two branching nodes are told apart by depth alone.
3. Nodes on the path of a part's first or last item may go on in the next part.  What hangs on them is contracted to
   sums by depth.  The contracted parts, two items each, are merged by the same union-find, and the nodes below are told
   their parents by a join.

The members that end at a node are hashed as streams of sorted ids: parts of the ids are joined by ranges, and the
parts of a node follow each other through the hash.  No step holds the members of a node.

Turns are ordered by turn number, null first; turns of one number by their digests.  Null roles and texts are empty.
Rows with a null ``conv_id`` are passed over.  Rows that repeat count as further turns.  An empty table has no
conversations, so no root and an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overgrid.llm.common import partitions, plain, shared_folder, stored, text_of

BLOCK, HEADS = 20, 4
#: Hex digits of a turn's digest, and characters of ids that are joined before they are sent on.
DIGEST = 32
IDS_HELD = 1 << 20
WORDS_BETWEEN = r"[\x20\x09-\x0D]+"
FAR = (1 << 63) - 1


def turns(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turns)``: each conversation's turns ``(d, w)`` in order, digest and number of words."""
    rows = plain(table, conv_id=conv_id, turn=turn, role=role, text=text).filter("conv_id IS NOT NULL")
    r, t = text_of("role"), text_of("text")
    digest = F.substring(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256), 1, DIGEST)
    words = F.size(F.array_remove(F.split(t, WORDS_BETWEEN), ""))
    key = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), digest.alias("d"), words.alias("w"))
    grouped = rows.select(F.col("conv_id").cast("long").alias("conv_id"), key.alias("k")).groupBy("conv_id").agg(F.array_sort(F.collect_list("k")).alias("k"))
    return grouped.select("conv_id", F.expr("transform(k, x -> named_struct('d', x.d, 'w', x.w))").alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """``(conv_id, key, words)``: digests of the rebuilt turns as one string, and their numbers of words."""
    heads = convs.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, HEADS - 1).alias("_head"))
    own = convs.withColumn("_h", (F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % HEADS).cast("int")).withColumn("_base", F.col("conv_id") - F.col("conv_id") % BLOCK)
    joined = own.join(heads, "_base", "left")
    made = F.expr("concat(coalesce(slice(_head, 1, _h), slice(turns, 1, 0)), slice(turns, _h + 1, size(turns)))")
    return joined.select("conv_id", made.alias("t")).select("conv_id", F.array_join("t.d", "").alias("key"), F.col("t.w").alias("words"))


def ends_of(members: DataFrame, folder: str) -> DataFrame:
    """``(id, n, first, ends)`` of ``(id, conv_id)``: how many, the smallest, and the hash of the sorted ids joined by commas."""

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by id and conversation; a stretch of bounded length is held."""
        at, held, size = None, [], 0
        for part in parts:
            for name, conv in zip(part["id"], part["conv_id"], strict=True):
                if held and (name != at or size > IDS_HELD):
                    yield chunk(at, held)
                    held, size = [], 0
                at = name
                held.append(conv)
                size += 20
        if held:
            yield chunk(at, held)

    def chunk(name: bytes, held: list[int]) -> pd.DataFrame:
        return pd.DataFrame([[name, held[0], len(held), ",".join(map(str, held))]], columns=["id", "first", "n", "ids"])

    def digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, first, total, running = None, 0, 0, None
        for part in parts:
            rows = []
            for name, least, n, ids in part[["id", "first", "n", "ids"]].itertuples(index=False):
                if name != at:
                    if running:
                        rows.append([at, total, first, running.hexdigest()])
                    at, first, total, running = name, least, 0, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.encode())
                total += n
            yield pd.DataFrame(rows, columns=["id", "n", "first", "ends"])
        if running:
            yield pd.DataFrame([[at, total, first, running.hexdigest()]], columns=["id", "n", "first", "ends"])

    n = partitions(members.sparkSession)
    ranged = members.repartitionByRange(n, "id", "conv_id").sortWithinPartitions("id", "conv_id")
    joined = stored(ranged.mapInPandas(join, "id binary, first long, n long, ids string"), "joined-ids", folder)
    return joined.repartition(n, "id").sortWithinPartitions("id", "first").mapInPandas(digest, "id binary, n long, first long, ends string")


@dataclass
class Hang:
    """Sums of what hangs on one node: complete subtrees, and the item that ends there, with its ``ends``."""

    n: int = 0
    conv: int = FAR
    kids: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None

    def add(self, other: Hang) -> None:
        self.n += other.n
        self.conv = min(self.conv, other.conv)
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends


@dataclass
class Item:
    """A distinct conversation: its key, words, how many share it and the smallest of them; ``n`` 0: it only marks a path."""

    key: str
    words: np.ndarray
    n: int
    conv: int
    ends: str
    hangs: dict[int, Hang] = field(default_factory=dict)

    @property
    def depth(self) -> int:
        return len(self.key) // DIGEST


def common(a: str, b: str) -> int:
    """Turns that two keys begin with alike."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * DIGEST] == b[: mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


@dataclass
class Node:
    """A node over the items ``lo .. hi``: an end of an item, or where its kids part."""

    depth: int
    lo: int
    hi: int
    kids: list[int] = field(default_factory=list)


def branching(items: list[Item]) -> list[Node]:
    """The contracted trie of sorted items by union-find over neighbours, deepest edges first; the last is the root."""
    nodes = [Node(x.depth, i, i) for i, x in enumerate(items)]
    depths = np.array([common(a.key, b.key) for a, b in zip(items[:-1], items[1:], strict=True)], dtype=np.int64)
    up = list(range(len(items)))  # union-find over items
    top = list(range(len(items)))  # of each component, by its representative

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for edge in np.argsort(-depths, kind="stable").tolist():
        depth, a, b = int(depths[edge]), find(edge), find(edge + 1)
        left, right = top[a], top[b]
        if nodes[left].depth == depth:  # the branching node, or the item that the others go on from, is there
            if nodes[right].depth == depth:
                nodes[left].kids += nodes[right].kids
            else:
                nodes[left].kids.append(right)
            nodes[left].hi = nodes[right].hi
            made = left
        elif nodes[right].depth == depth:
            nodes[right].kids.append(left)
            nodes[right].lo = nodes[left].lo
            made = right
        else:
            made = len(nodes)
            nodes.append(Node(depth, nodes[left].lo, nodes[right].hi, [left, right]))
        up[b] = a
        top[a] = made
    last = top[find(0)]
    if nodes[last].depth > 0:
        nodes.append(Node(0, 0, len(items) - 1, [last]))
        last = len(nodes) - 1
    order = [last]  # parents before their kids
    for at in order:
        order.extend(nodes[at].kids)
    place = {x: len(order) - 1 - i for i, x in enumerate(order)}
    return [Node(nodes[x].depth, nodes[x].lo, nodes[x].hi, [place[k] for k in nodes[x].kids]) for x in reversed(order)]


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


@dataclass
class Grown:
    """The contracted nodes of a trie, kids before parents, with what stands at each depth above and down to the parent."""

    nodes: list[Node]
    parent: list[int]
    #: Rows ``NODE`` of each node from its depth upwards; of a top row whose parent is another node, the parent's conversation.
    rows: list[list[list]]
    #: What each node brings its parent.
    sums: list[Hang]


def grow(items: list[Item]) -> Grown:
    nodes = branching(items)
    parent = [-1] * len(nodes)
    for at, node in enumerate(nodes):
        for k in node.kids:
            parent[k] = at
    hangs = _placed(items, nodes, parent)
    grown = Grown(nodes, parent, [], [])
    for at, node in enumerate(nodes):
        held, ends = Hang(), NO_ENDS
        for k in node.kids:
            held.add(grown.sums[k])
        first = items[node.lo]  # an item sorts before those that go on from it
        if first.depth == node.depth:
            held.n, held.conv, ends = held.n + first.n, min(held.conv, first.conv), first.ends
        own: list[list] = []
        for depth in range(node.depth, nodes[parent[at]].depth if parent[at] >= 0 else -1, -1):
            if depth in hangs[at]:
                held.add(hangs[at][depth])
                ends = hangs[at][depth].ends or ends
            leaves = held.leaves if held.kids else 1
            saved = held.saved + ((held.n - 1) * int(first.words[depth - 1]) if depth else 0)
            if own:
                own[-1][2] = held.conv
            own.append([held.conv, depth, None, held.n, held.kids, leaves, saved, ends])
            held, ends = Hang(held.n, held.conv, 1, leaves, saved), NO_ENDS
        grown.rows.append(own)
        grown.sums.append(held)
    for at, above in enumerate(parent):
        if above >= 0:
            grown.rows[at][-1][2] = grown.rows[above][0][0]
    return grown


def _placed(items: list[Item], nodes: list[Node], parent: list[int]) -> list[dict[int, Hang]]:
    """What hangs on the items' paths, by contracted node and depth."""
    found: list[dict[int, Hang]] = [{} for _ in nodes]
    if not any(x.hangs for x in items):
        return found
    end = {node.lo: at for at, node in reversed(list(enumerate(nodes)))}  # the deepest node that begins with the item
    for i, item in enumerate(items):
        at = end[i]
        for depth in sorted(item.hangs, reverse=True):
            while parent[at] >= 0 and nodes[parent[at]].depth >= depth:
                at = parent[at]
            found[at].setdefault(depth, Hang()).add(item.hangs[depth])
    return found


PART = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string,"
    " part int, last boolean, attach long, key string, forest binary"
)


def contracted(part: int, items: list[Item]) -> Iterator[pd.DataFrame]:
    """``PART`` of one part: its complete nodes, and one row with its two paths and the sums that hang on them.

    A complete node whose parent is on a path tells where it hangs: ``part``, ``last`` (on the last item's path, and
    not on the first's) and ``attach`` (the depth).
    """
    grown = grow(items)
    end = len(items) - 1
    first, last = items[0], items[end]
    complete = [node.lo > 0 and node.hi < end for node in grown.nodes]
    rows: list[list] = []
    for at, own in enumerate(grown.rows):
        node = grown.nodes[at]
        if not complete[at]:
            ending = items[node.lo]
            if ending.depth == node.depth and 0 < node.lo < end:
                last.hangs.setdefault(node.depth, Hang()).add(Hang(ending.n, ending.conv, ends=ending.ends))
            continue
        above = grown.parent[at]
        rows += [[*row, None, None, None, None, None] for row in own]
        if not complete[above]:
            path = grown.nodes[above]
            item = first if path.lo == 0 else last
            item.hangs.setdefault(path.depth, Hang()).add(grown.sums[at])
            rows[-1][2] = None
            rows[-1][8:11] = [part, path.lo > 0, path.depth]
        if len(rows) > 20_000:
            yield pd.DataFrame(rows, columns=[*NODE, "part", "last", "attach", "key", "forest"])
            rows = []
    ends = [first] if end == 0 else [first, last]
    rows.append([None] * 8 + [part, None, None, first.key, pickle.dumps([(x.key, x.words.tobytes(), x.n, x.conv, x.ends, x.hangs) for x in ends])])
    yield pd.DataFrame(rows, columns=[*NODE, "part", "last", "attach", "key", "forest"])


def forests(items: DataFrame) -> DataFrame:
    """``PART`` of items ``(key, words, n, first, ends)``, dealt by ranges of the key."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [
            Item(key, np.asarray(words, dtype=np.int64), n, first, ends)
            for part in parts
            for key, words, n, first, ends in part[["key", "words", "n", "first", "ends"]].itertuples(index=False)
        ]
        if held:
            for out in contracted(TaskContext.get().partitionId(), held):
                yield _typed(out)

    ranged = items.repartitionByRange(partitions(items.sparkSession), "key").sortWithinPartitions("key")
    return ranged.mapInPandas(run, PART)


def _typed(out: pd.DataFrame) -> pd.DataFrame:
    whole = [c for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "attach", "part") if c in out]
    return out.astype({c: "Int64" for c in whole} | ({"last": "boolean"} if "last" in out else {}))


def merged(parts: DataFrame) -> DataFrame:
    """``PART`` again: the nodes on the parts' paths, and for each place where nodes hang the conversation of its node.

    There are two items for each part, however many conversations: one task merges them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: list[Item] = []
        places: list[tuple[int, bool]] = []
        for batch in batches:
            for part, forest in zip(batch["part"], batch["forest"], strict=True):
                for i, (key, words, n, conv, ends, hangs) in enumerate(pickle.loads(forest)):
                    items.append(Item(key, np.frombuffer(words, dtype=np.int64), n, conv, ends, hangs))
                    places.append((part, i == 1))
        if not items:
            return
        grown = grow(items)
        rows = [[*row, None, None, None, None, None] for own in grown.rows for row in own]
        end = {node.lo: at for at, node in reversed(list(enumerate(grown.nodes)))}
        for i, (part, last) in enumerate(places):
            at = end[i]
            for depth in sorted(items[i].hangs, reverse=True):
                while grown.parent[at] >= 0 and grown.nodes[grown.parent[at]].depth >= depth:
                    at = grown.parent[at]
                conv = grown.rows[at][grown.nodes[at].depth - depth][0]
                rows.append([conv] + [None] * 7 + [part, last, depth, None, None])
        yield _typed(pd.DataFrame(rows, columns=[*NODE, "part", "last", "attach", "key", "forest"]))

    return parts.select("key", "part", "forest").repartition(1).sortWithinPartitions("key").mapInPandas(run, PART)


def prefix_trie(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``NODE`` of every node of the trie of the rebuilt conversations."""
    folder = shared_folder(table.sparkSession)
    convs = stored(turns(table, conv_id, turn, role, text), "turns", folder)
    made = rebuilt(convs).withColumn("id", F.unhex(F.md5("key")))
    made = stored(made, "rebuilt", folder)
    ends = ends_of(made.select("id", "conv_id"), folder)
    told = stored(ends.withColumnRenamed("id", "_id"), "ends", folder)
    # The smallest member of each sequence stands for it: one row of each group of equal conversations goes on.
    items = made.join(told, (made["id"] == told["_id"]) & (made["conv_id"] == told["first"])).select("key", "words", "n", "first", "ends")
    parts = stored(forests(items), "forests", folder)
    paths = stored(merged(parts.filter("forest IS NOT NULL")), "paths", folder)
    whole = parts.filter("forest IS NULL")
    on = ["part", "last", "attach"]
    parents = paths.filter("attach IS NOT NULL").select(*on, F.col("conv_id").alias("_parent"))
    below = whole.filter("attach IS NOT NULL").join(parents, on).withColumn("parent_conv_id", F.col("_parent"))
    out = whole.filter("attach IS NULL").select(*NODE).unionByName(below.select(*NODE))
    return out.unionByName(paths.filter("attach IS NULL").select(*NODE))


def op13_conversations(spark, sf: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf}/conversations.parquet"))


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({'k': sha256(length(role) || ':' || role || text)[1:32], 'w': len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))}
    ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)[1:32]) AS s FROM t GROUP BY conv_id),
h AS (
  -- CRC-32 of the decimal id, bit by bit.
  WITH RECURSIVE crc AS (
    SELECT conv_id, encode(conv_id::VARCHAR) AS b, 0 AS i, 4294967295::BIGINT AS v FROM c
    UNION ALL
    SELECT conv_id, b, i + 1, (SELECT list_reduce(list_concat([xor(v, CASE WHEN i % 8 = 0 THEN ord(substr(conv_id::VARCHAR, (i // 8 + 1)::INT, 1)) ELSE 0 END)], [1]),
      lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) FROM crc WHERE i < 8 * length(conv_id::VARCHAR))
  SELECT conv_id, xor(v, 4294967295) % 4 AS h FROM crc WHERE i = 8 * length(conv_id::VARCHAR)),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.s, [])[1:h], c.s[h + 1:len(c.s)]) AS s
  FROM c JOIN h USING (conv_id) LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (
  SELECT conv_id, len(s) AS size, d::BIGINT AS depth, list_transform(s[1:d], lambda x: x.k) AS path,
    CASE WHEN d = 0 THEN 0 ELSE s[d].w END AS w FROM r, unnest(range(0, len(s) + 1)) u(d)),
n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM p GROUP BY path, depth),
k AS (SELECT path[1:len(path) - 1] AS path, count(*) AS kids FROM n WHERE depth > 0 GROUP BY 1),
nk AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (path)),
under AS (
  SELECT a.path, count(*) FILTER (b.kids = 0) AS n_leaves, sum((b.n_convs - 1) * b.w) AS saved
  FROM nk a JOIN nk b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY a.path)
SELECT a.conv_id, a.depth, CASE WHEN a.depth > 0 THEN q.conv_id END AS parent_conv_id, a.n_convs, a.kids AS n_children,
  under.n_leaves, under.saved::BIGINT AS saved_tokens, a.ends_sha256
FROM nk a JOIN under USING (path) LEFT JOIN n q ON a.depth > 0 AND q.path = a.path[1:a.depth - 1]
"""
