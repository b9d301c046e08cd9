"""Ranked lexical search: MaxScore whose bounds come from term pairs.

All documents are ranked for every item of a stated query set.  The items' terms
are looked up in whole texts once, which leaves a table of term counts per
document.  From it, blocks of documents become an index: per term a posting list
with its largest impact, and per pair of terms that meet in an item an
intersection list, of which the joint maximum is stored: the most that one
document of the block gains from both.

For each item a block's terms are ordered by their bound.  A set of terms is
bounded by pairing them off: a pair counts with its joint maximum (or the larger
single one, if no document has both) instead of the sum of two independent
maxima.  The longest run of terms whose bound stays below the score of the
item's 20th best document so far cannot carry a document on its own; only
documents of the other lists are candidates, and a candidate goes as soon as its
score and the bound of the lists still closed stay below.  A block whose terms
all together stay below is skipped.  A sixteenth of the blocks, chosen by hash,
are searched first, and the scores they reach hold for all others.

Bounds: the items are taken in blocks of ``item_bytes`` of text, one pass over
the documents each; a block's terms and pairs go to all tasks.  Only an item's
``PAIRED`` commonest terms form pairs; other terms keep their own bounds, which
changes what is skipped and no result.  An index block holds ``BLOCK`` documents.

Defined cases: a null or empty text has no terms, such a document is in no list
and such an item has no result; each row of the items is an item of its own,
repeated ids or not; each row of the documents is a document of its own, so a
repeated row is ranked as often as it occurs; equal scores go by id, null ids
last; empty tables give no rows; other columns are ignored.  A text of any
length is one row, its words held by one task (about 60 bytes per byte of text).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm import scan
from siteweave.llm.store import store
from siteweave.operators.topk import top_k
from siteweave.session import shared_folder

#: text bytes of items searched for in one pass
ITEM_BYTES = 1 << 20
#: documents of an index block; one block of so many goes first
BLOCK, FIRST = 4096, 16
#: commonest terms of an item that form pairs
PAIRED = 32

FORWARD = "id bigint, n bigint, terms array<int>, counts array<int>"
INDEX = ("ids array<bigint>, bounds array<int>, terms array<int>, docs array<int>, impacts array<bigint>, most array<bigint>, "
         "pairs array<int>, joint array<bigint>, first boolean")
HITS = "item int, doc_id bigint, score bigint"


def tokens(text: str | None) -> list[bytes]:
    data = scan.lower_ascii(np.frombuffer((text or "").encode(), np.uint8))
    start, end, _ = scan.words(data, np.array([0, len(data)]), scan.ALNUM)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(start, end)]


class Vocabulary:
    """The items' terms, found in texts by hash and told by their bytes."""

    def __init__(self, terms: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        self.end = np.cumsum([len(t) for t in terms], dtype=np.int64)
        self.start = self.end - np.array([len(t) for t in terms], np.int64)
        hashes = scan.A.span(scan.A.prefix(self.data), self.start, self.end)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(word, term)`` of the words that are terms."""
        if not len(self.hashes) or not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = scan.A.span(scan.A.prefix(data), start, end)
        at = np.searchsorted(self.hashes, h)
        found_word, found_term = [], []
        word = np.arange(len(h))
        while len(word):  # once more for each term that shares a hash
            inside = at < len(self.hashes)
            word, at = word[inside], at[inside]
            maybe = self.hashes[at] == h[word]
            word, at = word[maybe], at[maybe]
            term = self.order[at]
            same = _same_bytes(data, start[word], end[word], self.data, self.start[term], self.end[term])
            found_word.append(word[same])
            found_term.append(term[same])
            word, at = word[~same], at[~same] + 1
        return np.concatenate(found_word or [word]), np.concatenate(found_term or [word])


def _same_bytes(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    size = a_end - a_start
    same = size == b_end - b_start
    row = np.flatnonzero(same)
    size = size[row]
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    differ = a[np.repeat(a_start[row], size) + step] != b[np.repeat(b_start[row], size) + step]
    same[np.repeat(row, size)[differ]] = False
    return same


@dataclass
class Item:
    """An item's distinct terms, how often it says each, and the numbers of their pairs."""

    row: int
    terms: np.ndarray
    times: np.ndarray
    pair: np.ndarray | None = None  # pair[i, j]: place in the pair list, -1 without one


def _items(rows: list[tuple[int, str | None]]) -> tuple[list[bytes], list[Item]]:
    said = [(row, Counter(tokens(text))) for row, text in rows]
    terms = sorted({t for _, c in said for t in c})
    number = {t: k for k, t in enumerate(terms)}
    return terms, [Item(row, np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for row, c in said if c]


def _pair_up(items: list[Item], df: np.ndarray, paired: int) -> np.ndarray:
    """Number the pairs of terms that meet in an item; returns them as rows ``(a, b)``, a < b."""
    known: dict[tuple[int, int], int] = {}
    for item in items:
        common = np.argsort(-df[item.terms], kind="stable")[:paired].tolist()
        item.pair = np.full((len(item.terms), len(item.terms)), -1, np.int64)
        for x, i in enumerate(common):
            for j in common[x + 1:]:
                a, b = sorted((int(item.terms[i]), int(item.terms[j])))
                item.pair[i, j] = item.pair[j, i] = known.setdefault((a, b), len(known))
    return np.array(list(known), np.int64).reshape(-1, 2)


def _forward(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """Per document with terms: its id, its number of terms, the items' terms in it and how often."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Vocabulary = vocabulary.value
        width = len(known.hashes) + 1
        for rows, data, offsets in scan.slices(batches, "text"):
            data = scan.lower_ascii(data)
            start, end, doc = scan.words(data, offsets, scan.ALNUM)
            n = np.bincount(doc, minlength=rows.num_rows).astype(np.int64)
            word, term = known.find(data, start, end)
            key, count = np.unique(doc[word] * np.int64(width) + term, return_counts=True)
            bounds = np.searchsorted(key, np.arange(rows.num_rows + 1) * np.int64(width)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (key % width, count)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), *lists], ["id", "n", "terms", "counts"]).filter(pa.array(n > 0))

    return docs.mapInArrow(task, FORWARD)


@dataclass
class Plan:
    """What tasks know of the items and the corpus."""

    items: list[Item]
    weight: np.ndarray
    pairs: np.ndarray
    documents: int
    terms: int
    k: int
    block: int


class Block:
    """Posting lists of some documents, by term, and the joint maxima of pairs."""

    def __init__(self, plan: Plan, ids: pa.Array, n: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        self.ids = ids
        m = 75 + (25 * n * plan.documents) // plan.terms
        impact = plan.weight[term] * ((1_000_000_000 * count) // (1000 * count + 12 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.docs, self.impacts, term = doc[order], impact[order], term[order]
        self.terms, start = np.unique(term, return_index=True)
        self.bounds = np.append(start, len(term))
        self.most = np.maximum.reduceat(self.impacts, start) if len(start) else np.zeros(0, np.int64)
        self.pairs, self.joint = self._joint(plan.pairs, len(n))

    def _joint(self, pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose lists intersect, with the largest joint impact: the shorter list is looked up in the longer one."""
        place = np.full(len(pairs) and int(pairs.max()) + 1, -1, np.int64)
        here = self.terms[self.terms < len(place)]
        place[here] = np.arange(len(here))
        at = place[pairs]
        both = np.flatnonzero((at >= 0).all(axis=1))
        size = np.diff(self.bounds)
        at = at[both]
        swap = size[at[:, 0]] > size[at[:, 1]]
        at[swap] = at[swap][:, ::-1]
        common = np.flatnonzero(size >= max(1, n // 32))
        dense = np.zeros((len(common), n), np.int64)
        row = np.full(len(size), -1, np.int64)
        row[common] = np.arange(len(common))
        for r, t in enumerate(common):
            dense[r, self.docs[self.bounds[t]: self.bounds[t + 1]]] = self.impacts[self.bounds[t]: self.bounds[t + 1]]
        order = np.argsort(at[:, 0], kind="stable")
        out = np.zeros(len(at), np.int64)
        edges = np.flatnonzero(np.diff(at[order, 0], prepend=-1))
        for s, e in zip(edges, [*edges[1:], len(order)]):
            some = order[s:e]
            t = at[some[0], 0]
            docs, impacts = self.docs[self.bounds[t]: self.bounds[t + 1]], self.impacts[self.bounds[t]: self.bounds[t + 1]]
            thick = row[at[some, 1]] >= 0
            if thick.any():
                other = dense[row[at[some[thick], 1]][:, None], docs]
                out[some[thick]] = np.where(other > 0, other + impacts, 0).max(axis=1)
            for x in some[~thick]:  # the longer list is short too
                b, e2 = self.bounds[at[x, 1]], self.bounds[at[x, 1] + 1]
                own = np.minimum(np.searchsorted(self.docs[b:e2], docs), e2 - b - 1)
                hit = self.docs[b:e2][own] == docs
                if hit.any():
                    out[x] = (impacts[hit] + self.impacts[b:e2][own[hit]]).max()
        some = np.flatnonzero(out)
        return both[some], out[some]


def _blocks(forward: DataFrame, shared: Broadcast) -> DataFrame:
    """Index blocks as rows; ``first`` marks those that are searched first."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = shared.value
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            terms, counts = (rows.column(c).combine_chunks() for c in ("terms", "counts"))
            size = np.diff(np.asarray(terms.offsets))
            b = Block(plan, rows.column("id").combine_chunks(), rows.column("n").to_numpy(), np.repeat(np.arange(len(size)), size),
                      np.asarray(terms.flatten()).astype(np.int64), np.asarray(counts.flatten()).astype(np.int64))
            first = scan.mix(np.array([len(b.docs) * 31 + int(b.impacts.sum() & 0xFFFFFFFF)], np.uint64))[0] % scan.U(FIRST) == 0
            columns = [b.ids, b.bounds.astype(np.int32), b.terms.astype(np.int32), b.docs.astype(np.int32), b.impacts, b.most, b.pairs.astype(np.int32), b.joint]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c)) for c in columns]
            return pa.RecordBatch.from_arrays([*lists, pa.array([bool(first)])], names)

        rows = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, plan.block - rows)
                held.append(some)
                at, rows = at + some.num_rows, rows + some.num_rows
                if rows == plan.block:
                    yield out()
                    held.clear()
                    rows = 0
        if held:
            yield out()

    names = [f.split()[0] for f in INDEX.split(", ")]
    return forward.mapInArrow(task, INDEX)


class Searcher:
    """The best documents so far of every item, over the blocks of a task."""

    def __init__(self, plan: Plan, floor: dict[int, int], pair_bounds: bool = True) -> None:
        self.plan, self.pair_bounds = plan, pair_bounds
        self.floor = [max(1, floor.get(i.row, 1)) for i in plan.items]  # a score of zero is no hit
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(plan.items)
        self.looked = 0  # documents scored

    def block(self, ids: np.ndarray, bounds: np.ndarray, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, most: np.ndarray,
              pairs: np.ndarray, joint: np.ndarray) -> None:
        place = np.full(len(self.plan.weight), -1, np.int64)
        place[terms] = np.arange(len(terms))
        together = np.zeros(len(self.plan.pairs) + 1, np.int64)  # the last one, at -1, is no pair
        together[pairs] = joint
        for x, item in enumerate(self.plan.items):
            at = place[item.terms]
            here = np.flatnonzero(at >= 0)
            if not len(here):
                continue
            at, times = at[here], item.times[here]
            own = times * most[at]
            order = np.argsort(own, kind="stable")
            here, at, times, own = here[order], at[order], times[order], own[order]
            sums = self._bounds(own, times, most[at], item.pair[np.ix_(here, here)], together)
            floor = self.floor[x]
            closed = int(np.searchsorted(sums, floor, "left"))  # bounds of the first 1, 2, ... lists that stay below
            if closed == len(at):
                continue
            score = np.zeros(len(ids), np.int64)
            for i in range(closed, len(at)):
                b, e = bounds[at[i]], bounds[at[i] + 1]
                score[docs[b:e]] += times[i] * impacts[b:e]
            some = np.flatnonzero(score)
            self.looked += len(some)
            for i in range(closed - 1, -1, -1):
                some = some[score[some] + sums[i] >= floor]
                if not len(some):
                    break
                b, e = bounds[at[i]], bounds[at[i] + 1]
                where = np.minimum(np.searchsorted(docs[b:e], some), e - b - 1)
                hit = docs[b:e][where] == some
                score[some[hit]] += times[i] * impacts[b:e][where[hit]]
            some = some[score[some] >= floor]
            if len(some):
                self._keep(x, ids[some], score[some])

    def _bounds(self, own: np.ndarray, times: np.ndarray, most: np.ndarray, pair: np.ndarray, together: np.ndarray) -> np.ndarray:
        """Bounds of the first 1, 2, ... terms: pairs taken as they come, each with the partner that saves most."""
        if not self.pair_bounds:
            return np.cumsum(own)
        fewer = np.minimum(times[:, None], times)
        joint = fewer * together[pair] + (times[:, None] - fewer) * most[:, None] + (times - fewer) * most
        save = np.minimum(own[:, None], own)  # no document has both: the larger one counts
        save = np.where(together[pair] > 0, np.minimum(save, own[:, None] + own - joint), save)
        save[pair < 0] = 0
        free = np.zeros(len(own), bool)
        out, total = np.zeros(len(own), np.int64), 0
        for i in range(len(own)):
            total += int(own[i])
            gain = np.where(free[:i], save[i, :i], 0)
            j = int(gain.argmax()) if i else -1
            if j >= 0 and gain[j] > 0:
                total -= int(gain[j])
                free[j] = False
            else:
                free[i] = True
            out[i] = total
        return out

    def _keep(self, x: int, ids: np.ndarray, score: np.ndarray) -> None:
        ids, score = np.concatenate([self.best[x][0], ids]), np.concatenate([self.best[x][1], score])
        order = np.lexsort((ids, -score))[: self.plan.k]
        self.best[x] = ids[order], score[order]
        if len(order) == self.plan.k:
            self.floor[x] = max(self.floor[x], int(score[order[-1]]))

    def hits(self) -> pa.RecordBatch:
        size = [len(b[0]) for b in self.best]
        ids = np.concatenate([b[0] for b in self.best] or [np.zeros(0, np.int64)])
        null = ids == NULL_ID
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([i.row for i in self.plan.items], size).astype(np.int32)), pa.array(ids, mask=null),
             pa.array(np.concatenate([b[1] for b in self.best] or [ids]))], ["item", "doc_id", "score"])


NULL_ID = (1 << 63) - 1


def _searched(index: DataFrame, shared: Broadcast, floor: dict[int, int]) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value, floor)
        for batch in batches:
            for r in range(batch.num_rows):
                columns = [batch.column(c)[r].values for c in range(8)]
                ids = columns[0].fill_null(NULL_ID).to_numpy(zero_copy_only=False)  # a null id goes last
                searcher.block(ids, *[c.to_numpy(zero_copy_only=False) for c in columns[1:]])
        yield searcher.hits()

    return index.drop("first").mapInArrow(task, HITS)


def _rank_block(docs: DataFrame, rows: list[tuple[int, str | None]], k: int, paired: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    terms, items = _items(rows)
    forward = store(_forward(docs, spark.sparkContext.broadcast(Vocabulary(terms))), "counts")
    total = forward.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(terms), np.int64)
    for r in forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():
        df[r.term] = r.n
    weight = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    plan = Plan(items, weight, _pair_up(items, df, paired), total[0], total[1] or 1, k, block)
    shared = spark.sparkContext.broadcast(plan)
    path = shared_folder(spark, "index")
    _blocks(forward, shared).write.option("compression", "zstd").partitionBy("first").parquet(path)
    index = spark.read.schema(INDEX).parquet(path)
    head = store(_searched(index.where("first"), shared, {}), "first")
    floor = {r.item: r.score for r in top_k(head, ["item"], _order(), k).where(F.col("rn") == k).collect()}
    return head.unionByName(_searched(index.where("not first"), shared, floor))


def _order():
    return [F.desc("score"), F.asc_nulls_last("doc_id")]


def rank(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_bytes: int = ITEM_BYTES, paired: int = PAIRED, block: int = BLOCK) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col("text").alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // item_bytes))
    names, parts = [], []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else asked
        said = own.collect()
        numbered = [(len(names) + i, r.text) for i, r in enumerate(said)]
        names += [(len(names) + i, r.item_id) for i, r in enumerate(said)]
        hits = _rank_block(rows, numbered, k, paired, block)
        parts.append(hits if blocks == 1 else store(top_k(hits, ["item"], _order(), k).drop("rn"), "hits"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = top_k(found, ["item"], _order(), k)
    numbers = spark.createDataFrame(names, f"item int, item_id {dict(asked.dtypes)['item_id']}")
    return best.join(F.broadcast(numbers), "item").select("item_id", F.col("rn").alias("rank"), "doc_id", "score")
