"""Merkle manifest of a table, with octopus multiproofs.

Every row is a leaf.  The leaves of a source, ordered by id, form a tree whose
nodes hash runs of ``FANOUT`` nodes; the sources' roots, ordered by source, form
the top tree.  A node is named by its coordinate (top, source, level, pos).

Positions need no task that owns a source: leaves are range-sorted by (source,
id, hash), counted per range partition and source, and the counts' running sums
give each partition's first position.  A level's nodes are grouped by (source,
pos div 16), so a hot source is many groups of at most 16.

Proofs: a leaf partition (a stretch of the sorted leaves, or any subset of it)
walks its leaves' paths up both trees and lists the coordinates that it cannot
derive itself, each once; one join fetches them; the partition then derives the
interior nodes that its leaves share and writes out each leaf's own proof.  For
a whole stretch of leaves these are at most 30 nodes a level, whatever its
length, against 15 a level and leaf for separate proofs.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerdesk.llm.common import drop_used_shuffles
from sellerdesk.session import stage

FANOUT = 16
PART_LEAVES = 16_384  # leaves of a partition, about
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hash_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------ leaves


def leaf_hash(values: list[Column]) -> Column:
    """H of the values: ``-`` for null, else byte count, ``:`` and the value."""
    parts = []
    for v in values:
        v = v.cast("string")
        sized = F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)
        parts.append(F.coalesce(sized, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def leaves(docs: DataFrame, tampered_every: int = 5) -> DataFrame:
    """doc_id, source, leaf and, for the rows that an attack touches, the tampered leaf.

    The attack lower-cases A to Z in the text of rows whose id's CRC-32 is divisible by
    ``tampered_every``; a null id is never touched, and a null text stays null.
    """
    own = {f: F.col(f) for f in FIELDS}
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % tampered_every == 0
    changed = {**own, "text": lower_ascii(F.col("text"))}
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        leaf_hash(list(own.values())).alias("leaf"),
        F.when(touched, leaf_hash(list(changed.values()))).alias("tampered"),
    )


# --------------------------------------------------------------- positions


def numbered(rows: DataFrame, tree: list[str], order: list[str], name: str) -> DataFrame:
    """Staged ``rows`` with part, pos (from 0, within the tree) and n (the tree's rows).

    Rows equal in ``tree`` and ``order`` are told apart by their place in the staged
    files, so any number of them can be dealt to several partitions.
    """
    spark = rows.sparkSession
    staged = stage(rows, name)
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), -(-staged.count() // PART_LEAVES)
    )
    place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    keys = [F.col(c).asc_nulls_first() for c in [*tree, *order]]
    dealt = staged.withColumn("tie", place).repartitionByRange(parts, *keys, "tie")
    dealt = dealt.sortWithinPartitions(*keys, "tie").drop("tie")
    dealt = stage(
        dealt.select(
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("place"),
            *rows.columns,
        ),
        f"{name}-sorted",
    )
    runs = dealt.groupBy("part", *tree).agg(F.min("place").alias("first"), F.count("*").alias("run"))
    keyed = ", ".join(tree) or "NULL"
    runs = runs.select(  # a window holds one row per partition that the tree touches
        F.col("part").alias("r_part"),
        *(F.col(c).alias(f"r_{c}") for c in tree),
        "first",
        F.expr(f"sum(run) OVER (PARTITION BY {keyed} ORDER BY part) - run").alias("start"),
        F.expr(f"sum(run) OVER (PARTITION BY {keyed})").alias("n"),
    )
    same = F.col("part") == F.col("r_part")
    for c in tree:
        same &= F.col(c).eqNullSafe(F.col(f"r_{c}"))
    placed = dealt.join(stage(runs, f"{name}-runs"), same)
    pos = F.col("place") - F.col("first") + F.col("start")
    return stage(placed.select("part", *rows.columns, pos.alias("pos"), "n"), f"{name}-placed")


# -------------------------------------------------------------------- trees


def parents(nodes: DataFrame) -> DataFrame:
    """The level above ``nodes`` (source, pos, n, hash), for trees of several nodes."""
    run = F.array_sort(F.collect_list(F.struct("pos", "hash")))
    up = F.expr(f"pos div {FANOUT}")
    grouped = nodes.where("n > 1").groupBy("source", up.alias("up"), "n").agg(run.alias("run"))
    return grouped.select(
        "source",
        F.col("up").alias("pos"),
        F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"),
        F.sha2(F.concat_ws("", F.col("run.hash")), 256).alias("hash"),
    )


def tree_levels(first: DataFrame, top: bool) -> DataFrame:
    """All nodes of the trees over ``first`` (source, pos, n, hash): top, source, level, pos, n, hash."""

    def level(nodes: DataFrame, k: int) -> DataFrame:
        return nodes.select(F.lit(top).alias("top"), "source", F.lit(k).alias("level"), "pos", "n", "hash")

    nodes = level(first, 0)
    widest = first.agg(F.max("n")).first()[0] or 0
    current, k = first, 0
    while widest > 1:
        k, widest = k + 1, -(-widest // FANOUT)
        current = stage(parents(current), f"merkle-level-{k}")
        nodes = nodes.unionByName(level(current, k))
    return nodes


@dataclass(frozen=True)
class Manifest:
    """``leaves``: part, doc_id, source, leaf, tampered, pos, n; ``nodes``: coordinates and hashes;
    ``sources``: source, its place in the top tree and its root."""

    leaves: DataFrame
    nodes: DataFrame
    sources: DataFrame
    n_sources: int
    root: str | None  # of no rows: none


def build_manifest(rows: DataFrame) -> Manifest:
    """The manifest of ``rows`` (see :func:`leaves`)."""
    drop_used_shuffles(rows.sparkSession)
    placed = numbered(rows, ["source"], ["doc_id", "leaf"], "merkle-leaves")
    first = placed.select("source", "pos", "n", F.col("leaf").alias("hash"))
    nodes = tree_levels(first, top=False)
    subroots = nodes.where("n = 1").select("source", F.col("hash").alias("subroot"))
    sources = numbered(subroots, [], ["source"], "merkle-sources")
    first = sources.select(F.lit(None).cast("string").alias("source"), "pos", "n", F.col("subroot").alias("hash"))
    upper = tree_levels(first, top=True)
    root = upper.where("n = 1").select("hash").first()
    n_sources = sources.agg(F.max("n")).first()[0] or 0
    return Manifest(placed, nodes.unionByName(upper), sources, n_sources, root and root[0])


# ------------------------------------------------------------------- proofs


def missing_coordinates(known: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """(level, pos) of the nodes that a tree of ``n`` leaves needs beside the ``known`` leaves.

    The least set: siblings, level by level, of known or derived nodes that are
    themselves neither.
    """
    level = 0
    known = np.unique(known)
    while n > 1:
        groups = np.unique(known // FANOUT)
        members = (groups[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        for pos in np.setdiff1d(members[members < n], known, assume_unique=True):
            yield level, int(pos)
        known, n, level = groups, -(-n // FANOUT), level + 1


REQUEST = "part int, top boolean, source string, level int, pos long"
MARK = -1  # the level of a row that carries the source's place in the top tree


def _by_source(table: pa.Table) -> Iterator[tuple[str | None, np.ndarray]]:
    """The row numbers of each source."""
    rows = defaultdict(list)
    for i, s in enumerate(table.column("source").to_pylist()):
        rows[s].append(i)
    for s, own in rows.items():
        yield s, np.array(own)


def _requests(n_sources: int):
    def run(wanted: pa.Table, sources: pa.Table) -> pa.Table:
        """The union of the coordinates that the partition's leaves miss in both trees."""
        out = []
        if wanted.num_rows:
            part = wanted.column("part")[0].as_py()
            pos, n = wanted.column("pos").to_numpy(), wanted.column("n").to_numpy()
            place = dict(zip(sources.column("source").to_pylist(), sources.column("pos").to_pylist(), strict=True))
            for source, own in _by_source(wanted):
                out.append((part, False, source, MARK, place[source]))
                out += [(part, False, source, *c) for c in missing_coordinates(pos[own], int(n[own[0]]))]
            tops = np.array(list(place.values()))
            out += [(part, True, None, *c) for c in missing_coordinates(tops, n_sources)]
        kinds = [pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [()] * 5
        names = [x.split()[0] for x in REQUEST.split(", ")]
        return pa.table({c: pa.array(v, k) for c, v, k in zip(names, columns, kinds, strict=True)})

    return run


class Paths:
    """The paths of one tree: known leaves and fetched nodes, with the interiors derived from them."""

    def __init__(self, known: dict[int, str], fetched: dict[int, dict[int, str]], n: int):
        self.sides: list[dict[int, tuple[str, str]]] = []  # per level, pos: texts left and right of it
        level = 0
        while n > 1:
            nodes = {**known, **fetched.get(level, {})}
            sides, known_above = {}, {}
            for g in {pos // FANOUT for pos in known}:
                run = [nodes[p] for p in range(g * FANOUT, min(n, (g + 1) * FANOUT))]
                text = "".join(run)
                known_above[g] = hash_text(text)
                for i in range(len(run)):
                    if (pos := g * FANOUT + i) in known:
                        sides[pos] = text[: 64 * i], text[64 * (i + 1) :]
            self.sides.append(sides)
            known, n, level = known_above, -(-n // FANOUT), level + 1
        self.root = next(iter(known.values()))

    def siblings(self, pos: int) -> Iterator[tuple[str, str]]:
        for sides in self.sides:
            yield sides[pos]
            pos //= FANOUT


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _expansion(root: str, n_sources: int, full: bool):
    names = [x.split()[0] for x in PROOF.split(", ")]

    def run(wanted: pa.Table, fetched: pa.Table) -> pa.Table:
        nodes: dict = defaultdict(lambda: defaultdict(dict))
        place = {}
        for top, source, level, pos, value in zip(
            *(fetched.column(c).to_pylist() for c in ("top", "source", "level", "pos", "hash")), strict=True
        ):
            if level == MARK:
                place[source] = pos
            else:
                nodes[top, source][level][pos] = value
        ids, leaf, tampered = (wanted.column(c).to_pylist() for c in ("doc_id", "leaf", "tampered"))
        pos, n = wanted.column("pos").to_pylist(), wanted.column("n").to_pylist()
        trees, members = {}, {}
        for source, own in _by_source(wanted):
            known = {pos[i]: leaf[i] for i in own}
            trees[source] = Paths(known, nodes[False, source], n[own[0]])
            members[source] = own
        upper = None
        if trees:
            upper = Paths({place[s]: t.root for s, t in trees.items()}, nodes[True, None], n_sources)
        out = []
        for source, tree in trees.items():
            above = list(upper.siblings(place[source]))
            tails: dict[int, tuple[list, str]] = {}  # of the leaves of one run
            for i in members[source]:
                g = pos[i] // FANOUT
                if g not in tails:
                    path = list(tree.siblings(pos[i]))[1:] + above
                    tails[g] = path, "".join(a + b for a, b in path)
                path, text = tails[g]
                first = tree.sides[0][pos[i]] if tree.sides else ("", "")
                folded = tampered[i] or leaf[i]
                steps = [first, *path] if tree.sides else path
                for a, b in steps:
                    folded = hash_text(a + folded + b)
                proof = first[0] + first[1] + text
                row = [ids[i], leaf[i], tree.root, root, hash_text(proof), folded]
                if full:
                    row.append([proof[k : k + 64] for k in range(0, len(proof), 64)])
                out.append(row)
        kinds = [pa.int64()] + [pa.string()] * 5 + [pa.list_(pa.string())] * full
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        cells = zip(names + ["proof"] * full, columns, kinds, strict=True)
        return pa.table({c: pa.array(v, k) for c, v, k in cells})

    return run


def prove(manifest: Manifest, wanted: Column | None = None, full: bool = False) -> DataFrame:
    """The proofs of all leaves, or of those that meet ``wanted`` (on doc_id, source or leaf).

    Per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root (recomputed
    from the tampered leaf, if there is one, and the original siblings), verified;
    ``full`` adds the siblings themselves as an array.  A null source is a source,
    first in order; null ids come first in theirs; rows equal in source, id and
    leaf are leaves of their own, with proofs of their own.  No rows: no proofs.
    """
    rows = manifest.leaves if wanted is None else manifest.leaves.where(wanted)
    held = rows.select(F.col("part").alias("held_by"), F.col("source").alias("held")).distinct()
    places = held.join(
        manifest.sources.select("source", "pos"), F.col("held").eqNullSafe(F.col("source"))
    ).select("held_by", "source", "pos")
    asked = rows.select("part", "source", "pos", "n").groupBy("part")
    requests = asked.cogroup(places.groupBy("held_by")).applyInArrow(_requests(manifest.n_sources), REQUEST)
    nodes = manifest.nodes.select(*(F.col(c).alias(f"n_{c}") for c in ("top", "source", "level", "pos")), "hash")
    same = (F.col("top") == F.col("n_top")) & F.col("source").eqNullSafe(F.col("n_source"))
    same &= (F.col("level") == F.col("n_level")) & (F.col("pos") == F.col("n_pos"))
    fetched = requests.join(nodes, same, "left").select("part", "top", "source", "level", "pos", "hash")
    schema = PROOF + ", proof array<string>" * full
    expand = _expansion(manifest.root or "", manifest.n_sources, full)
    proofs = rows.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(expand, schema)
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


def merkle_proofs(docs: DataFrame) -> DataFrame:
    """Proofs of every row of ``docs`` and what they say of the tampered rows.  Other columns
    than those of ``FIELDS`` are not read."""
    return prove(build_manifest(leaves(docs)))
