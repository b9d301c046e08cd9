"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

A replaced letter lowers one letter's count by one and raises another's; a
deleted letter lowers one count.  So near words lie within an L1 distance of
two, and for a pair of lengths the signs are known: ``(l, l)`` asks for one up
and one down, ``(l + 1, l)`` for one down.  Words of each length have a k-d
tree.  Its upper levels, split on a sample, deal the words out to leaves that
one task can hold; a word asks every leaf whose box the search touches.  In the
task a tree over the leaf's distinct vectors finds the cells in reach, and the
letter that goes and the one that comes tell which words of a cell can have the
right letter order: their hashes are looked up, their letters compared.

Bounds: the sample (``SAMPLE`` vectors at most, of 90 counts each) and one row
per word length reach the driver; the trees' splits go to all tasks.  Every word
is in the index and asks; nothing is capped.  A leaf that no split can divide
(anagrams of one another) is dealt out over several tasks by the words' hash.

Defined cases: a null text has no words; a null id counts as an empty string in
the hash that deletes letters; repeated rows count as often as they occur; a
text of any length is one row, its runs held by one task; ties between near
words of equal count go to the smallest in code-point order; an empty table
gives an empty result.  Columns but the id and the text are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm import scan
from siteweave.llm.store import store

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: letters of a word: a-z and U+00C0 to U+00FF
LETTERS = 26 + 64
#: bytes of words and vectors that one leaf should hold
LEAF_BYTES = 2 << 20
#: sampled vectors for the upper levels of all trees together, and those wanted per leaf
SAMPLE, SAMPLE_PER_LEAF = 1 << 17, 64
#: distinct vectors in a leaf of a task's own tree
CELLS = 4
#: word-leaf or word-cell pairs handled at once in a task
CHUNK = 1 << 18


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 6, least: int = 5, typo: int = 199) -> DataFrame:
    """``(word, n)``: lower-cased runs of letters, some with one letter deleted, of at least ``letters`` letters and ``least`` occurrences.

    A run loses the letter ``h % length`` where ``typo`` divides ``h``, the CRC-32 of ``<id>:<run>``.
    """
    # a run that is shorter before the deletion cannot be long enough after it
    runs = F.regexp_extract_all(text_col, F.lit(f"[A-Za-zÀ-ÿ]{{{letters},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    plain = F.octet_length("run") == F.char_length("run")
    rows = rows.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UP, LOW)).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    rows = rows.select(F.when(F.col("h") % typo == 0, cut).otherwise(F.col("run")).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n")).where((F.char_length("word") >= letters) & (F.col("n") >= least))


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after the other, and the bounds of the words."""
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(lengths)])


def letter_counts(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of letter counts per word."""
    n = len(bounds) - 1
    letter = np.where(flat < 128, flat - 97, flat - 192 + 26).astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(bounds))
    return np.bincount(row * LETTERS + letter, minlength=n * LETTERS).astype(np.int32).reshape(n, LETTERS)


@dataclass
class Tree:
    """A k-d tree as arrays: inner nodes have a letter and a bound, leaves a number."""

    letter: list[int] = field(default_factory=list)
    bound: list[int] = field(default_factory=list)  # right child: count >= bound
    low: list[int] = field(default_factory=list)  # the node's own box along its letter
    high: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)  # -1 at inner nodes
    members: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def build(cls, points: np.ndarray, most: int) -> Tree:
        """Split at medians, along the letter whose split is most even, until ``most`` points are left or all are equal."""
        tree = cls()
        todo = [(np.arange(len(points)), {}, None, False)]
        while todo:
            at, box, parent, is_right = todo.pop()
            node = len(tree.letter)
            if parent is not None:
                (tree.right if is_right else tree.left)[parent] = node
            split = cls._split(points[at]) if len(at) > most else None
            letter, bound = split or (0, 0)
            low, high = box.get(letter, (0, 1 << 30))
            for column, value in zip((tree.letter, tree.bound, tree.low, tree.high, tree.left, tree.right), (letter, bound, low, high, node, node)):
                column.append(value)
            tree.leaf.append(-1 if split else len(tree.members))
            if not split:
                tree.members.append(at)
                continue
            more = points[at, letter] >= bound
            todo.append((at[more], box | {letter: (bound, high)}, node, True))
            todo.append((at[~more], box | {letter: (low, bound - 1)}, node, False))
        for name in ("letter", "bound", "low", "high", "left", "right", "leaf"):
            setattr(tree, name, np.array(getattr(tree, name), np.int64))
        return tree

    @staticmethod
    def _split(points: np.ndarray) -> tuple[int, int] | None:
        """The letter and bound that halve the points best; None if all are equal."""
        middle = np.partition(points, len(points) // 2, axis=0)[len(points) // 2]
        best, chosen = 0, None
        for bound in (middle, middle + 1):
            share = (points >= bound).sum(axis=0)
            even = np.minimum(share, len(points) - share)
            letter = int(even.argmax())
            if even[letter] > best:
                best, chosen = int(even[letter]), (letter, int(bound[letter]))
        return chosen

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.zeros(len(points), np.int64)
        while (inner := np.flatnonzero(self.leaf[node] < 0)).size:
            at = node[inner]
            more = points[inner, self.letter[at]] >= self.bound[at]
            node[inner] = np.where(more, self.right[at], self.left[at])
        return self.leaf[node]

    def search(self, points: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """``(point, leaf)`` wherever a leaf's box can be reached by ``up`` counts raised and ``down`` lowered by one."""
        found_q, found_leaf = [], []
        q, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        rise = fall = np.zeros(len(points), np.int64)
        while len(q):
            done = self.leaf[node] >= 0
            found_q.append(q[done])
            found_leaf.append(self.leaf[node[done]])
            q, node, rise, fall = (x[~done] for x in (q, node, rise, fall))
            value, bound = points[q, self.letter[node]], self.bound[node]
            # the letter's own share of the distance grows with the tighter box
            rise_r = rise + np.maximum(bound - value, 0) - np.maximum(self.low[node] - value, 0)
            fall_l = fall + np.maximum(value - bound + 1, 0) - np.maximum(value - self.high[node], 0)
            r, lft = rise_r <= up, fall_l <= down
            q = np.concatenate([q[r], q[lft]])
            node = np.concatenate([self.right[node[r]], self.left[node[lft]]])
            rise, fall = np.concatenate([rise_r[r], rise[lft]]), np.concatenate([fall[r], fall_l[lft]])
        return np.concatenate(found_q or [q]), np.concatenate(found_leaf or [node])


class Forest:
    """The upper levels: a tree per word length; leaves and the parts of leaves that no split divides are numbered through."""

    def __init__(self, counts: dict[int, int], samples: dict[int, np.ndarray], leaves: dict[int, int]) -> None:
        self.trees, self.base, self.parts = {}, {}, {}
        total = 0
        for length in sorted(counts):
            points = samples.get(length, np.zeros((0, LETTERS), np.int32))
            tree = Tree.build(points, max(1, len(points) // leaves[length]))
            share = np.array([len(m) for m in tree.members]) * leaves[length] / max(1, len(points))
            parts = np.maximum(1, np.ceil(share / 4)).astype(np.int64)  # a leaf of over four shares is dealt out
            self.trees[length], self.parts[length] = tree, parts
            self.base[length] = total + np.concatenate([[0], np.cumsum(parts)])
            total += int(parts.sum())
            tree.members = []

    def deal(self, length: int, vectors: np.ndarray, salt: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """``(word, leaf part, kind)``: where words of a length live (kind 0) and whom they ask (1: own length, 2: one less)."""
        tree, parts, base = self.trees[length], self.parts[length], self.base[length]
        leaf = tree.home(vectors)
        home = base[leaf] + salt % parts[leaf]
        yield np.arange(len(vectors)), home, 0
        for kind, other, up, down in ((1, length, 1, 1), (2, length - 1, 0, 1)):
            if other not in self.trees:
                continue
            for start in range(0, len(vectors), CHUNK // 16):
                q, leaf = self.trees[other].search(vectors[start: start + CHUNK // 16], up, down)
                n = self.parts[other][leaf]
                q = np.repeat(q + start, n)
                first = np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(self.base[other][leaf], n) + np.arange(len(q)) - first
                asked = at != home[q] if kind == 1 else np.ones(len(q), bool)
                yield q[asked], at[asked], kind


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows and vectors of each word length of a batch."""
    flat, bounds = code_points(column)
    vectors, lengths = letter_counts(flat, bounds), np.diff(bounds)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        yield length, at, vectors[at]


def plant(known: DataFrame, leaf_bytes: int = LEAF_BYTES, sample: int = SAMPLE) -> Forest:
    """The trees' upper levels for a table of words, from at most ``sample`` vectors chosen by the words' hash."""
    spark = known.sparkSession
    counts = {r.length: r.n for r in known.groupBy(F.char_length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    leaves = {k: -(-n * (4 * k + 4 * LETTERS) // leaf_bytes) for k, n in counts.items()}
    wanted = {k: v * SAMPLE_PER_LEAF for k, v in leaves.items() if v > 1}
    scale = min(1.0, sample / max(1, sum(wanted.values())))
    samples: dict[int, np.ndarray] = {}
    if wanted:
        rates = spark.createDataFrame([(k, int(scale * v / counts[k] * (1 << 30)) + 1) for k, v in wanted.items()], "length int, rate long")
        some = known.select("word", F.char_length("word").alias("length")).join(F.broadcast(rates), "length")
        some = some.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < F.col("rate")).select("word")

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for length, at, found in _by_length(b.column(0)):
                    rows = pa.array([v.tobytes() for v in np.minimum(found, 65535).astype(np.uint16)], pa.binary())  # bounds of splits, no more
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), length, np.int32)), rows], ["length", "vector"])

        for r in some.mapInArrow(vectors, "length int, vector binary").collect():
            samples.setdefault(r.length, []).append(np.frombuffer(r.vector, np.uint16))
        samples = {k: np.stack(v).astype(np.int32) for k, v in samples.items()}
    return Forest(counts, samples, leaves)


class Leaf:
    """Words of one length, their k-d tree over distinct vectors, and their hashes."""

    def __init__(self, column: pa.Array) -> None:
        flat, bounds = code_points(column)
        self.n, self.length = len(column), int(bounds[1])
        self.letters = flat.reshape(self.n, self.length)
        self.cells = np.unique(letter_counts(flat, bounds), axis=0)
        self.tree = Tree.build(self.cells, CELLS)
        self.sizes = np.array([len(m) for m in self.tree.members])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.members = np.concatenate(self.tree.members)
        seed = 0
        while True:  # words told apart by their hash
            self.poly = scan.Poly(77 + seed)
            self.poly.powers(self.length + 1)
            self.code = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
            hashes = self.hashes(self.letters)[:, -1]
            self.order = np.argsort(hashes)
            self.sorted = hashes[self.order]
            if (self.sorted[1:] != self.sorted[:-1]).all():
                break
            seed += 1

    def hashes(self, letters: np.ndarray) -> np.ndarray:
        """Hashes of all prefixes of each word."""
        return np.cumsum(self.code[letters] * self.poly.up[: letters.shape[1]], axis=1, dtype=np.uint64)

    def reach(self, cells: np.ndarray, up: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(asking cell, letter gone, letter come)`` of the leaf's cells in reach; without a letter to come it is -1."""
        for start in range(0, len(cells), CHUNK // 64):
            some = cells[start: start + CHUNK // 64]
            q, leaf = self.tree.search(some, up, 1)
            n = self.sizes[leaf]
            q = np.repeat(q, n)
            at = self.members[np.repeat(self.starts[leaf] - (np.cumsum(n) - n), n) + np.arange(len(q))]
            for k in range(0, len(q), CHUNK):
                qk, ak = q[k: k + CHUNK], at[k: k + CHUNK]
                step = self.cells[ak] - some[qk]
                near = np.abs(step).sum(axis=1) == 1 + up
                step, qk = step[near], qk[near]
                yield qk + start, step.argmin(axis=1), step.argmax(axis=1) if up else np.full(len(qk), -1)

    def near(self, letters: np.ndarray, up: int) -> tuple[np.ndarray, np.ndarray]:
        """``(asking word, word of the leaf)`` that one replaced (``up`` 1) or deleted letter turns one into the other."""
        n, length = letters.shape
        vectors = letter_counts(letters.reshape(-1), np.arange(n + 1) * length)
        cells, cell = np.unique(vectors, axis=0, return_inverse=True)
        by_cell = np.argsort(cell.reshape(-1), kind="stable")
        size = np.bincount(cell.reshape(-1), minlength=len(cells))
        first = np.cumsum(size) - size
        letter = np.where(letters < 128, letters.astype(np.int64) - 97, letters.astype(np.int64) - 192 + 26)
        prefix = self.hashes(letters)
        out_q, out_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        back = self.poly.down[1]
        for q, gone, come in self.reach(cells, up):
            m = size[q]
            word = by_cell[np.repeat(first[q] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            gone, come = np.repeat(gone, m), np.repeat(come, m)
            step = max(1, CHUNK // length)
            for k in range(0, len(word), step):
                row, place = np.nonzero(letter[word[k: k + step]] == gone[k: k + step, None])
                w = word[k: k + step][row]
                whole = prefix[w, -1]
                if up:
                    new = come[k: k + step][row]
                    code = np.where(new < 26, new + 97, new - 26 + 192)
                    h = whole + (self.code[code] - self.code[letters[w, place]]) * self.poly.up[place]
                else:
                    head = np.where(place > 0, prefix[w, place - 1], scan.U(0))
                    h = head + (whole - prefix[w, place]) * back
                at = np.minimum(np.searchsorted(self.sorted, h), self.n - 1)
                hit = self.sorted[at] == h
                w, p, place = w[hit], self.order[at[hit]], place[hit]
                if up:
                    same = (letters[w] != self.letters[p]).sum(axis=1) == 1
                else:
                    columns = np.arange(self.length)
                    same = (letters[w[:, None], columns + (columns >= place[:, None])] == self.letters[p]).all(axis=1)
                out_q.append(w[same])
                out_p.append(p[same])
        pairs = np.unique(np.concatenate(out_q) * np.int64(self.n) + np.concatenate(out_p))  # a letter of a double may go twice
        return pairs // self.n, pairs % self.n


FOUND = "word string, n_near bigint, best_n bigint, best string"


def _reduced(asking: pa.Array, pairs: tuple[np.ndarray, np.ndarray], other: pa.Array, other_n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per asking word the number of near words and the best of them: largest count, then first in code-point order."""
    q, p = pairs
    if not len(q):
        return
    said = np.array(other.to_pylist(), object)
    alphabetical = np.empty(len(said), np.int64)
    alphabetical[np.argsort(said, kind="stable")] = np.arange(len(said))
    order = np.lexsort((alphabetical, -other_n))
    place = np.empty(len(said), np.int64)
    place[order] = np.arange(len(said))
    best = np.full(len(asking), len(said), np.int64)
    np.minimum.at(best, q, place[p])
    count = np.bincount(q, minlength=len(asking))
    rows = np.flatnonzero(count)
    at = order[best[rows]]
    yield pa.RecordBatch.from_arrays([asking.take(pa.array(rows)), pa.array(count[rows]), pa.array(other_n[at]), other.take(pa.array(at))],
                                     ["word", "n_near", "best_n", "best"])


def _leaf_task(table: pa.Table) -> pa.Table:
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    kind = table.column("kind").to_numpy()
    parts = []
    for k in range(3):
        rows = table.take(pa.array(np.flatnonzero(kind == k)))
        parts.append((rows.column("word").combine_chunks(), rows.column("n").to_numpy()))
    (points, n), (same, same_n), (longer, longer_n) = parts
    if not len(points):
        return schema.empty_table()
    leaf = Leaf(points)
    out = list(_reduced(points, leaf.near(leaf.letters, 1), points, n))
    for column, counts, up in ((same, same_n, 1), (longer, longer_n, 0)):
        if not len(column):
            continue
        flat, _ = code_points(column)
        q, p = leaf.near(flat.reshape(len(column), -1), up)
        out += _reduced(column, (q, p), points, n)
        if not up:  # the shorter word learns of the longer one here; words of one length ask each other
            out += _reduced(points, (p, q), column, counts)
    return pa.Table.from_batches([b.cast(schema) for b in out], schema)


def near_words(known: DataFrame, leaf_bytes: int = LEAF_BYTES, sample: int = SAMPLE) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words of ``known(word, n)`` that have near words; no others."""
    forest = plant(known, leaf_bytes, sample)
    shared = known.sparkSession.sparkContext.broadcast(forest)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, n, salt = b.column(0), b.column(1), b.column(2).to_numpy()
            for length, at, vectors in _by_length(word):
                for q, part, kind in shared.value.deal(length, vectors, salt[at]):
                    rows = pa.array(at[q])
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(q), kind, np.int32)), word.take(rows), n.take(rows)],
                                                     ["part", "kind", "word", "n"])

    salted = known.select("word", "n", F.pmod(F.xxhash64("word"), F.lit(1 << 30)).alias("salt"))
    dealt = salted.mapInArrow(deal, "part bigint, kind int, word string, n bigint")
    found = dealt.groupBy("part").applyInArrow(_leaf_task, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


def variants(known: DataFrame, ratio: int = 5, leaf_bytes: int = LEAF_BYTES, sample: int = SAMPLE) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``known(word, n)``.

    The form is the near word of the largest count if that is at least ``ratio`` times the word's own; the root is the last form on the way.
    Counts grow on that way, so it ends, and following it by doubling takes few rounds.
    """
    known = store(known, "words")
    near = near_words(known, leaf_bytes, sample)
    better: Column = F.col("best_n") >= ratio * F.col("n")
    rows = store(known.join(near, "word", "left").select(
        "word", F.when(better, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(better, F.col("best_n")).alias("form_n")), "forms")
    way = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = way.join(way.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        moved = store(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        way = moved.select("word", "root")
        if moved.where("moved").limit(1).count() == 0:
            break
    return rows.join(way, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

