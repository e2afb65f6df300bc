"""An n-gram model as an Elias-Fano trie in memory-mapped levels.

Level 1 is the vocabulary: 64-bit word hashes in order; a word's id is its place.
Level k holds, for each node of level k - 1 (a context), its successors by word
id.  Two monotone sequences, both Elias-Fano coded, make a level: pointers, which
give the range of each context's successors, and the successors, each range
lifted above the last value of the range before it.  A look-up takes the
context's range from the pointers, the lift from the value before the range, and
searches the lifted word id; a context without successors ends there.

Per node there are an exact count (levels that are contexts), and 8-bit codes of
its smoothed log-probability and, as a context, of its back-off weight.
Smoothing is Dirichlet's, p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K), down to
add-one unigrams, so an unseen successor costs the factor K / (c(h) + K).

A level is cut into shards of about ``SHARD_TOKENS`` training tokens by (context,
word), a hot context among its successors; each shard is built by one task and
written as one file in the shared folder, and the manifest that Spark commits
names the files.  Counting folds equal n-grams in the tasks that read the texts,
which send sorted, delta-coded blocks to the shards, with the coded probability
of the shorter n-gram, whose node they have looked up anyway.  Texts are cut into
words once, by whole arrays, in runs of about ``FLUSH_BYTES``; a run's distinct word
hashes and the codes of its tokens are written to the shared folder, one run a row
group, and every later pass reads those.  Each distinct word of a run is hashed and
looked up once.  Readers map the files, ``OPEN`` shards of a level at a time, look n-grams
up in sorted order, and hold in memory only what they touch.

Words are told apart by 64-bit hashes.  Keys must fit 63 bits: V^2 for two levels.
"""

from __future__ import annotations

import json
import mmap
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from sellerdesk.llm.common import bounded_batches, drop_used_shuffles, planes, unplanes
from sellerdesk.llm.elias_fano import EliasFano, build
from sellerdesk.session import scratch_path, stage

SHARD_TOKENS = 2_000_000
FLUSH_BYTES = 8 << 20  # of texts in a run
OPEN = 64  # shards of a level that a reader holds mapped
K = 4.0  # weight of the shorter context
CODE = 12.0 / 255  # step of a code: log10 down to -12
END = xxh3_64_intdigest(b"\n")  # no word holds white space


# ------------------------------------------------------------------ files


def write_arrays(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Write ``arrays`` as one file of ``folder``; returns its path there."""
    files, base = pafs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    path, at, head = f"{base}/{uuid.uuid4().hex}.level", 0, {}
    for name, a in arrays.items():
        head[name] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    with files.open_output_stream(path, compression=None) as out:
        out.write(len(text).to_bytes(8, "little") + text + b" " * (-(8 + len(text)) % 64))
        for a in arrays.values():
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 64))
    return path


def map_arrays(folder: str, path: str) -> dict[str, np.ndarray]:
    """Memory-map a file of :func:`write_arrays`; from a store without files it is read."""
    files, _ = pafs.FileSystem.from_uri(folder)
    if isinstance(files, pafs.LocalFileSystem):
        with open(path, "rb") as source:
            raw = mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with files.open_input_file(path) as source:
            raw = source.read()
    size = int.from_bytes(raw[:8], "little")
    start = -(-(8 + size) // 64) * 64
    head = json.loads(raw[8 : 8 + size])
    return {
        n: np.frombuffer(raw, np.dtype(kind), length, start + at)
        for n, (kind, at, length) in head.items()
    }


# ----------------------------------------------------------------- levels


@dataclass(frozen=True)
class Shard:
    path: str
    first: int  # smallest key it may hold
    universe: int  # number of keys it may hold
    offset: int  # nodes of the level before it
    size: int


class Level:
    """The shards of a level; the ``OPEN`` last used are mapped."""

    def __init__(self, folder: str, shards: list[Shard], n_types: int = 0):
        self.folder, self.shards, self.n_types = folder, shards, n_types
        self.firsts = np.array([s.first for s in shards], np.uint64)
        self.ends = np.array([s.offset + s.size for s in shards], np.int64)
        self.open: OrderedDict[int, tuple[EliasFano, EliasFano | None, dict]] = OrderedDict()

    def shard(self, i: int) -> tuple[EliasFano, EliasFano | None, dict]:
        if i not in self.open:
            arrays = map_arrays(self.folder, self.shards[i].path)
            own = {n.removeprefix("pointer_"): a for n, a in arrays.items() if n.startswith("pointer_")}
            self.open[i] = EliasFano(arrays), EliasFano(own) if own else None, arrays
            if len(self.open) > OPEN:
                self.open.popitem(last=False)
        self.open.move_to_end(i)
        return self.open[i]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, found) of sorted keys: word hashes, or context * V + word."""
        node, found = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        if not self.shards:
            return node, found
        cuts = np.searchsorted(keys, self.firsts[1:], side="left")
        edges = np.concatenate(([0], cuts, [len(keys)]))
        for i in np.flatnonzero(np.diff(edges)):
            s, part = self.shards[i], slice(int(edges[i]), int(edges[i + 1]))
            own = keys[part]
            inside = (own >= np.uint64(s.first)) & (own - np.uint64(s.first) <= np.uint64(s.universe - 1))
            successors, pointers, _ = self.shard(int(i))
            if pointers is None:
                at, hit = successors.find(own[inside] - np.uint64(s.first))
            else:
                at, hit = self._successor(successors, pointers, s.first, own[inside])
            n, f = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
            n[inside], f[inside] = at + s.offset, hit
            node[part], found[part] = n, f
        return node, found

    def _successor(
        self, successors: EliasFano, pointers: EliasFano, first: int, keys: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Search each word in its context's range."""
        keys = keys.view(np.int64)  # below 2^63
        context = keys // self.n_types
        word = (keys - context * self.n_types).astype(np.uint64)
        fresh = np.append(True, context[1:] != context[:-1])[: len(context)]
        back = np.cumsum(fresh) - 1
        c = context[fresh] - first // self.n_types
        lo, hi = (x.astype(np.int64) for x in pointers.pairs(c))
        lo, hi = lo - c, hi - c - 1
        lift = np.zeros(len(c), np.uint64)
        held = np.flatnonzero((lo > 0) & (lo < hi))
        lift[held] = successors.at(lo[held] - 1) + np.uint64(1)
        lo, hi, lift = lo[back], hi[back], lift[back]
        at, hit = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        some = np.flatnonzero(lo < hi)
        top = successors.top
        lifted = lift[some] + word[some]
        some, lifted = some[lifted <= top], lifted[lifted <= top]
        at[some], hit[some] = successors.find(lifted)
        return at, hit & (at >= lo) & (at < hi)

    def get(self, name: str, nodes: np.ndarray) -> np.ndarray:
        """Array ``name`` at sorted nodes."""
        parts = []
        edges = np.searchsorted(nodes, self.ends, side="left")
        for i in np.flatnonzero(np.diff(np.concatenate(([0], edges)))):
            own = nodes[0 if i == 0 else edges[i - 1] : edges[i]]
            parts.append(self.shard(int(i))[2][name][own - self.shards[i].offset])
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def lifted_ranges(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Word ids of sorted (context, word), each context's above the last of the context before."""
    start = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    last = np.append(start[1:], len(word)) - 1
    lifts = np.cumsum(word[last] + np.uint64(1)) - (word[last] + np.uint64(1))
    return word + np.repeat(lifts, np.diff(np.append(start, len(word))))


def code_of(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) / CODE), 0, 255).astype(np.uint8)


@dataclass(frozen=True)
class Model:
    folder: str
    n_tokens: int  # N
    n_types: int  # V
    levels: list[list[Shard]]

    def opened(self) -> list[Level]:
        return [Level(self.folder, shards, self.n_types) for shards in self.levels]

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.n_tokens + self.n_types + 1)


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    fresh = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return keys[fresh], place


class Reader:
    """Nodes and scores of token runs, looked up in sorted order."""

    def __init__(self, model: Model):
        self.model, self.levels = model, model.opened()

    def _values(self, k: int, names: tuple[str, ...], node: np.ndarray, found: np.ndarray) -> list[np.ndarray]:
        """Arrays of level k at the found ones of sorted nodes, 0 elsewhere."""
        out = [np.zeros(len(node), np.int64) for _ in names]
        for a, name in zip(out, names, strict=True):
            a[found] = self.levels[k].get(name, node[found])
        return out

    def words(self, hashes: np.ndarray, *names: str) -> tuple[np.ndarray, ...]:
        """Id (or -1) of each hash and ``names`` of its node."""
        keys, back = _unique(hashes)
        node, found = self.levels[0].find(keys)
        values = self._values(0, names, node, found)
        return (np.where(found, node, -1)[back], *(a[back] for a in values))

    def step(self, k: int, context: np.ndarray, word: np.ndarray, *names: str) -> tuple[np.ndarray, ...]:
        """Node on level k (0-based) of each (context node, word id), -1 if there is none, and
        ``names`` of it, read with the same look-up."""
        known = np.flatnonzero((context >= 0) & (word >= 0))
        keys, back = _unique(context[known] * self.model.n_types + word[known])
        node, found = self.levels[k].find(keys.view(np.uint64))
        values = [np.where(found, node, -1), *self._values(k, names, node, found)]
        out = [np.full(len(context), -1, np.int64), *(np.zeros(len(context), np.int64) for _ in names)]
        for a, v in zip(out, values, strict=True):
            a[known] = v[back]
        return tuple(out)

    def get(self, k: int, name: str, nodes: np.ndarray) -> np.ndarray:
        keys, back = _unique(nodes)
        return self.levels[k].get(name, keys)[back]

    def log_probabilities(self, run: Run) -> tuple[np.ndarray, ...]:
        """(count, unigram log10 p, model log10 p) of the tokens of a run."""
        last = len(self.levels) - 1
        found = self.words(run.words, "count", *["back"][:last])
        word, count, *backs = (a[run.codes] for a in found)
        base = np.log10(self.model.unigram(count))
        score, node = base, word
        for k in range(1, last + 1):
            context = run.before(node)
            lower = score - np.where(context >= 0, run.before(backs[0]) * CODE, 0)
            node, prob, *backs = self.step(k, context, word, "prob", *["back"][: k < last])
            score = np.where(node >= 0, prob * -CODE, lower)
        return count, base, score


# --------------------------------------------------------------- counting


SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False
LOWER_CASE = np.arange(256, dtype=np.uint8)
LOWER_CASE[65:91] += 32


RUNS = "held_out boolean, doc_id array<long>, lengths binary, words binary, codes binary"


class Run:
    """The tokens of a run of texts: distinct ``words`` (hashes, the end first), ``codes`` into
    them, and the ``lengths`` of the texts in tokens."""

    def __init__(self, words: np.ndarray, codes: np.ndarray, lengths: np.ndarray):
        self.words, self.codes, self.lengths = words, codes, lengths
        self.begin = np.cumsum(lengths) - lengths

    @classmethod
    def cut(cls, texts: list[bytes]) -> Run:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        solid = SOLID[raw]
        edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        edges = np.append(0, edges) if solid[0] else edges
        starts, ends = edges[::2], edges[1::2]
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(LOWER_CASE[raw[solid]])]
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        words = np.empty(len(distinct) + 1, np.uint64)
        words[0] = END
        words[1:] = np.fromiter(map(xxh3_64_intdigest, distinct), np.uint64, len(distinct))
        own = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
        run = cls(words, np.zeros(len(starts) + len(texts), np.int64), own + 1)
        inside = np.ones(len(run.codes), bool)
        inside[run.begin + own] = False
        run.codes[inside] = coded.indices.to_numpy() + 1
        return run

    def before(self, node: np.ndarray) -> np.ndarray:
        """The node before each token, -1 where a text begins."""
        out = np.concatenate(([-1], node[:-1]))
        out[self.begin] = -1
        return out


def token_runs(texts: DataFrame) -> DataFrame:
    """Cut ``texts(doc_id, text, held_out)`` into words, once; a run holds texts of one side of the fold.

    Written one run a row group, so that a reader holds few runs, and a lost
    executor costs no second cutting of what was written.
    """

    def written(held_out: bool, pairs: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        run = Run.cut([text for _, text in pairs])
        columns = [
            pa.array([held_out], pa.bool_()),
            pa.array([[i for i, _ in pairs]], pa.list_(pa.int64())),
            pa.array([planes(run.lengths)], pa.binary()),
            pa.array([run.words.tobytes()], pa.binary()),
            pa.array([planes(run.codes.astype(np.uint32))], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RUNS.split(", ")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}
        for batch in batches:
            for i, text, held_out in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gathered[held_out].append((i, text or b""))
                size[held_out] += len(text or b"") + 8
                if size[held_out] >= FLUSH_BYTES:
                    yield written(held_out, gathered[held_out])
                    gathered[held_out], size[held_out] = [], 0
        for held_out, pairs in gathered.items():
            if pairs:
                yield written(held_out, pairs)

    spark = texts.sparkSession
    path = scratch_path(spark, "lm-runs")
    runs = texts.select("doc_id", "text", "held_out").mapInArrow(cut, RUNS)
    runs.write.option("parquet.block.row.count.limit", "1").parquet(path)
    return spark.read.parquet(path)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    """The runs of rows that end in lengths, words and codes."""
    for batch in batches:
        for lengths, words, codes in zip(*(c.to_pylist() for c in batch.columns[-3:]), strict=True):
            yield Run(
                np.frombuffer(words, np.uint64), unplanes(codes, np.uint32).astype(np.int64), unplanes(lengths, np.int64)
            )


def _signed(hashes: np.ndarray) -> np.ndarray:
    """Longs in the order of the unsigned hashes."""
    return (hashes ^ np.uint64(1 << 63)).view(np.int64)


MANIFEST = (
    "shard int, path string, first string, universe string, size long, "
    "cut_nodes array<long>, cut_parts array<int>, cut_of array<int>"
)


def _manifest_row(shard: int, path: str, first: int, universe: int, size: int, counts: np.ndarray) -> pa.Table:
    """With the places where the next level is cut: every SHARD_TOKENS tokens, hot nodes inside."""
    cuts: list[tuple[int, int, int]] = []
    place = (np.cumsum(counts) - counts) // SHARD_TOKENS
    for node in np.flatnonzero(np.diff(place, prepend=-1)):
        cuts.append((int(node), 0, 1))
    for node in np.flatnonzero(counts > SHARD_TOKENS):
        parts = int(-(-counts[node] // SHARD_TOKENS))
        cuts += [(int(node), j, parts) for j in range(1, parts)]
    cuts.sort(key=lambda c: (c[0], c[1] / c[2]))
    columns = list(zip(*cuts, strict=True)) if cuts else [(), (), ()]
    return pa.table(
        {
            "shard": pa.array([shard], pa.int32()),
            "path": [path],
            "first": [str(first)],
            "universe": [str(universe)],
            "size": pa.array([size], pa.int64()),
            "cut_nodes": pa.array([columns[0]], pa.list_(pa.int64())),
            "cut_parts": pa.array([columns[1]], pa.list_(pa.int32())),
            "cut_of": pa.array([columns[2]], pa.list_(pa.int32())),
        }
    )


def _shards(manifest: DataFrame, n_types: int) -> tuple[list[Shard], list[int]]:
    """The level's shards in order, and the first keys of the next level's shards."""
    shards, firsts, offset = [], [0], 0
    for r in sorted(manifest.collect(), key=lambda r: int(r.first)):  # one row per shard
        shards.append(Shard(r.path, int(r.first), int(r.universe), offset, r.size))
        for node, j, of in zip(r.cut_nodes, r.cut_parts, r.cut_of, strict=True):
            firsts.append((offset + node) * n_types + n_types * j // of)
        offset += r.size
    return shards, sorted(set(firsts))


def _vocabulary(train: DataFrame, folder: str) -> tuple[DataFrame, int, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _stored(batches):
            word, n = run.words, np.bincount(run.codes, minlength=len(run.words))
            for lo in range(0, len(word), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(word[part])), pa.array(n[part])], names=["word", "n"]
                )

    counted = train.mapInArrow(count, "word long, n long")
    counted = stage(counted.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    n_types, n_tokens = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_shards = max(1, -(-n_types // SHARD_TOKENS))
    width = -(-(1 << 64) // n_shards)

    def make(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        word = table.column("word").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
        order = np.argsort(word)
        n = table.column("n").to_numpy()[order].astype(np.uint64)
        first = shard * width
        universe = min(width, (1 << 64) - first)
        arrays = build(word[order] - np.uint64(first), universe)
        arrays |= {"count": n, "back": code_of(K / (n + K))}
        path = write_arrays(folder, arrays)
        return _manifest_row(shard, path, first, universe, len(n), n.astype(np.int64))

    # the shard of a hash by its unsigned size, in exact decimal arithmetic
    decimal = "decimal(38,0)"
    unsigned = f"(cast(word as {decimal}) + cast('{1 << 63}' as {decimal}))"
    shard = F.expr(f"cast({unsigned} div cast('{width}' as {decimal}) as int)")
    dealt = counted.withColumn("shard", F.least(shard, F.lit(n_shards - 1)))
    built = dealt.groupBy("shard").applyInArrow(make, MANIFEST)
    return stage(built, "lm-level"), n_types, n_tokens


def _next_level(train: DataFrame, model: Model, firsts: list[int], order: int) -> DataFrame:
    """Count, smooth and write the n-grams one word longer than the model's."""
    k = len(model.levels)
    if max(firsts, default=0) >= 1 << 63 or (sum(s.size for s in model.levels[-1]) + 1) * model.n_types >= 1 << 63:
        raise ValueError("the keys of this level do not fit 63 bits")
    edges = np.array(firsts, np.uint64)
    end = (sum(s.size for s in model.levels[-1])) * model.n_types
    last_level = k + 1 == order

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for run in _stored(batches):
            word = reader.words(run.words)[0][run.codes]
            context, prob = run.before(word), None
            for i in range(1, k):
                node, prob = reader.step(i, context, word, "prob")
                context = run.before(node)
            use = np.flatnonzero(context >= 0)
            keys = context[use].astype(np.uint64) * np.uint64(model.n_types) + word[use].astype(np.uint64)
            low = None
            if k > 1:  # the n-gram without its first word was counted, so it has a node
                by = np.argsort(keys)
                keys, low = keys[by], prob[use[by]].astype(np.uint8)
            else:
                keys.sort()
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            n = np.diff(np.append(start, len(keys)))
            keys, low = keys[start], low if low is None else low[start]
            cuts = np.searchsorted(keys, edges, side="left").tolist() + [len(keys)]
            for shard in range(len(edges)):
                part = slice(cuts[shard], cuts[shard + 1])
                if part.start < part.stop:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard], pa.int32()),
                            pa.array([planes(np.diff(keys[part], prepend=np.uint64(0)))], pa.binary()),
                            pa.array([planes(n[part].astype(np.uint32))], pa.binary()),
                            pa.array([b"" if low is None else planes(low[part])], pa.binary()),
                        ],
                        names=["shard", "keys", "counts", "lower"],
                    )

    def make(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys = np.concatenate([np.cumsum(unplanes(b, np.uint64), dtype=np.uint64) for b in table.column("keys").to_pylist()])
        n = np.concatenate([unplanes(b, np.uint32) for b in table.column("counts").to_pylist()])
        by = np.argsort(keys, kind="stable")
        keys, n = keys[by], n[by].astype(np.uint64)
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.add.reduceat(n, start)
        keys = keys[start]
        reader = Reader(model)
        context, word = np.divmod(keys, np.uint64(model.n_types))
        if k == 1:
            lower = model.unigram(reader.get(0, "count", word.astype(np.int64)))
        else:
            parts = [unplanes(b, np.uint8) for b in table.column("lower").to_pylist()]
            lower = 10.0 ** (np.concatenate(parts)[by][start] * -CODE)
        before = reader.get(k - 1, "count", context.astype(np.int64)).astype(np.float64)
        first = firsts[shard]
        universe = (firsts[shard + 1] if shard + 1 < len(firsts) else end) - first
        values = lifted_ranges(context, word)
        arrays = build(values, int(values[-1]) + 1)
        arrays["prob"] = code_of((n + K * lower) / (before + K))
        # the first successor of each context that the shard may hold, and the end
        origin = first // model.n_types
        held = np.arange((first + universe - 1) // model.n_types - origin + 2, dtype=np.uint64)
        pointers = np.searchsorted(context, held + np.uint64(origin)).astype(np.uint64) + held
        arrays |= {f"pointer_{x}": a for x, a in build(pointers, int(pointers[-1]) + 1).items()}
        if not last_level:
            arrays |= {"count": n, "back": code_of(K / (n + K))}
        path = write_arrays(model.folder, arrays)
        return _manifest_row(shard, path, first, universe, len(n), n.astype(np.int64))

    blocks = train.mapInArrow(count, "shard int, keys binary, counts binary, lower binary")
    return stage(blocks.groupBy("shard").applyInArrow(make, MANIFEST), "lm-level")


def train_model(runs: DataFrame, order: int = 2) -> Model:
    """Fit the trie on the runs of :func:`token_runs` that are not held out; none give an empty model."""
    spark: SparkSession = runs.sparkSession
    train = runs.where(~F.col("held_out")).select("lengths", "words", "codes")
    folder = scratch_path(spark, "lm")
    manifest, n_types, n_tokens = _vocabulary(train, folder)
    shards, firsts = _shards(manifest, n_types)
    model = Model(folder, n_tokens, n_types, [shards])
    while len(model.levels) < order and n_tokens:
        manifest = _next_level(train, model, firsts, order)
        shards, firsts = _shards(manifest, n_types)
        model = Model(folder, n_tokens, n_types, [*model.levels, shards])
    return model


def score_runs(runs: DataFrame, model: Model) -> DataFrame:
    """n_tokens, n_known, base_score and score of each text of the runs."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    names = [x.split()[0] for x in schema.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                (run,) = _stored(iter([row]))
                count, base, total = reader.log_probabilities(run)
                arrays = [
                    row.column("doc_id").flatten(),
                    pa.array(np.full(len(run.lengths), row.column("held_out")[0].as_py())),
                    pa.array(run.lengths),
                    pa.array(np.add.reduceat((count > 0).astype(np.int64), run.begin)),
                    pa.array(np.add.reduceat(base, run.begin)),
                    pa.array(np.add.reduceat(total, run.begin)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return runs.mapInArrow(score, schema)


def score_documents(docs: DataFrame, order: int = 2, folds: int = 7, fold: int = 2) -> DataFrame:
    """Scores of all documents under a model of those outside the held-out fold.

    A document is held out if crc32 of its id as text is ``fold`` modulo
    ``folds``; a null id never is.  A null or empty text is the end token alone.
    Repeated rows are each scored, and counted if they train.  Without training
    rows the unigram of an unseen word is 1.  An empty table gives no rows.
    Other columns are not read.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        F.coalesce(remainder == fold, F.lit(False)).alias("held_out"),
    )
    bounded_batches(docs.sparkSession, 8)
    drop_used_shuffles(docs.sparkSession)
    runs = token_runs(texts)
    model = train_model(runs, order)
    return score_runs(runs, model).withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))
