"""LM scoring with a Brown class-based bigram model (operator 6).

P(w | v) = P(class w | class v) * P(w | class w), mixed with add-one unigrams, over the training
documents' words (whitespace words with A-Z lowered) and one end token a document.

1. Blocks. Each block of documents becomes its lexicon (sorted word hashes), its training counts and
   its stream of lexicon numbers; texts are not read again.
2. Vocabulary. Blocks send their counts to hash shards. All training words are clustered, however rare;
   the number of classes follows their number (its cube root, twice), so that class tables grow slower than it.
3. Start. Words with at least `share` of all training tokens (no more than 1 / share) are exchanged on the driver:
   bigram counts among them are summed once; in each round the contexts of every such word are added up by
   class, and words move one after the other to the class that raises the class bigram likelihood most, the
   end token keeping its own.
4. Exchange of all words. Hash shards add up both contexts of every training word by class, over all training
   tokens, and each word goes to the class of the highest gain: first the others to the classes of the start,
   then, in at most `sweeps` rounds, all words given all classes. Moves of a sweep are made at once, so it
   is kept only if the likelihood of all training tokens rises.
5. Class transitions are counted over all training tokens. Words seen once stand for unseen words on
   the left side of a transition.
6. Scores. A word's emission is discounted by n1 / (n1 + 2 n2); what this frees in a class is the
   class's probability of an unseen word, so the model sums to one over known words and "unseen".

Only the starting words, their class counts (bounded by 1 / share) and the class matrix reach the
driver or are broadcast; word counts, contexts, classes of words and streams stay in tables.

Defined cases: a null or empty text is its end token; a null doc_id is not held out; repeated rows
count and are scored each; without training documents every probability is 1; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.llm import texts
from skein.llm.blocks import BLOCK_BYTES, settled, slices
from skein.session import Scratch, settings, shuffles_dropped

#: The end token's place among word hashes.
END = np.uint64(0xE4D0E4D0E4D0E4D0)
STREAMS = "block long, ids binary, known binary, held binary, first binary, lexicon binary, counts binary, stream binary, trained long"
SHARD_WORDS = 256


def _stream(table: pa.Table) -> pa.Table:
    table = table.sort_by([("id", "ascending"), ("text", "ascending")])
    data, offsets = texts.buffers(table["text"])
    h, first = texts.words(data, offsets, True)
    n = len(offsets) - 1
    size = np.diff(first)
    every = np.empty(len(h) + n, np.uint64)
    at = np.arange(len(h)) + np.repeat(np.arange(n), size)
    every[at] = h
    every[first[1:] + np.arange(n)] = END
    first = first + np.arange(n + 1)
    lexicon, stream = np.unique(every, return_inverse=True)
    ids = table["id"].combine_chunks()
    held = np.asarray(table["held"].combine_chunks().cast(pa.uint8()))
    counts = np.bincount(stream[np.repeat(held == 0, size + 1)], minlength=len(lexicon))
    cells = {"ids": np.asarray(ids.fill_null(0)).astype("<i8"), "known": np.asarray(ids.is_valid()).astype(np.uint8), "held": held, "first": first.astype("<i8"), "lexicon": lexicon.astype("<u8"), "counts": counts.astype("<u4"), "stream": stream.astype("<i4")}
    return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int64()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in cells.items()}, "trained": pa.array([int(counts.sum())], pa.int64())})


class Stream:
    def __init__(self, row: dict):
        self.number = row["block"]
        for c, t in (("ids", "<i8"), ("known", np.uint8), ("held", np.uint8), ("first", "<i8"), ("lexicon", "<u8"), ("counts", "<u4"), ("stream", "<i4")):
            setattr(self, c, np.frombuffer(row[c], t))
        self.counts = self.counts.astype(np.int64)
        size = np.diff(self.first)
        self.train = np.repeat(self.held == 0, size)
        #: Lexicon number of the token on the left; before a text stands the end token.
        self.left = np.empty_like(self.stream)
        self.left[1:] = self.stream[:-1]
        self.left[self.first[:-1]] = np.searchsorted(self.lexicon, END)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Stream, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
            yield Stream(row), row


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of n."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[begin], np.add.reduceat(n, begin) if len(keys) else n


def _starting_words(blocks: DataFrame, shards: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, counts) of the words with at least `least` training tokens, and the number of all; hashes ascend."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, _ in _streams(batches):
            ok = s.counts > 0
            h, n = s.lexicon[ok], s.counts[ok]
            rows = [(k, h[a:b].tobytes(), n[a:b].tobytes()) for k, a, b in slices(h, shards)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "h", "n"])

    def total(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, "<u8") for x in table["h"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, "<i8") for x in table["n"].to_pylist()])
        h, n = _summed(h, n)
        ok = n >= least
        return pa.table({"h": pa.array([*h[ok].view(np.int64).tolist(), None], pa.int64()), "n": pa.array([*n[ok].tolist(), len(h)], pa.int64())})

    rows = blocks.mapInArrow(send, "shard long, h binary, n binary").groupBy("shard").applyInArrow(total, "h long, n long").toArrow()  # at most 1 / share rows, and one of each shard
    found = np.asarray(rows["h"].is_valid())
    h, n = np.asarray(rows["h"].combine_chunks().fill_null(0)).view(np.uint64), np.asarray(rows["n"].combine_chunks())
    total, h, n = int(n[~found].sum()), h[found], n[found]
    order = np.argsort(h)
    return h[order], n[order], total


def _found(s: Stream, words: np.ndarray) -> np.ndarray:
    """For each lexicon entry its number among the ascending `words`, or -1."""
    at = np.searchsorted(words, s.lexicon)
    at[at == len(words)] = 0
    return np.where(words[at] == s.lexicon, at, -1) if len(words) else np.full(len(s.lexicon), -1)


def _bigrams(blocks: DataFrame, words, scratch: Scratch) -> DataFrame:
    """Packed rows: for some exchange words each, their right (side 0) and left (side 1) neighbours with counts."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words.value
        size, keys, counts = 0, [], []

        def flush() -> pa.RecordBatch:
            k, n = _summed(np.concatenate(keys), np.concatenate(counts))
            return pa.RecordBatch.from_arrays([pa.array((k // len(w)).astype(np.int32)), pa.array((k % len(w)).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

        for s, _ in _streams(batches):
            number = _found(s, w)
            a, b = number[s.left], number[s.stream]
            ok = (a >= 0) & (b >= 0) & s.train
            k, n = np.unique(a[ok].astype(np.int64) * len(w) + b[ok], return_counts=True)
            keys.append(k)
            counts.append(n.astype(np.int64))
            size += len(k)
            if size > 2_000_000:
                yield flush()
                size, keys, counts = 0, [], []
        if size:
            yield flush()

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({c: [np.asarray(table[c].combine_chunks()).astype(t).tobytes()] for c, t in (("side", np.int8), ("w", "<i4"), ("v", "<i4"), ("n", "<i8"))})

    sums = blocks.mapInArrow(pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    sums = scratch.store(sums, "pairs")
    sides = sums.select(F.lit(0).alias("side"), F.col("a").alias("w"), F.col("b").alias("v"), "n").union(sums.select(F.lit(1), "b", "a", "n"))
    out = sides.withColumn("shard", F.expr(f"w div {SHARD_WORDS}")).groupBy("shard").applyInArrow(pack, "side binary, w binary, v binary, n binary")
    out = scratch.store(out, "bigrams")
    scratch.drop("pairs")
    return out


def _by_class(bigrams: DataFrame, classes, n_classes: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(right, left): counts of each exchange word's neighbours by their class."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = classes.value
        for batch in batches:
            for row in batch.to_pylist():
                side, w, v, n = (np.frombuffer(row[k], t) for k, t in (("side", np.int8), ("w", "<i4"), ("v", "<i4"), ("n", "<i8")))
                base = int(w.min()) if len(w) else 0
                span = (int(w.max()) - base + 1) if len(w) else 0
                at = ((w - base).astype(np.int64) * 2 + side) * n_classes + c[v]
                got = np.bincount(at, n, 2 * span * n_classes)
                yield pa.RecordBatch.from_arrays([pa.array([base], pa.int64()), pa.array([got.astype("<f4").tobytes()], pa.binary())], ["base", "counts"])

    out = np.zeros((n_words, 2, n_classes))
    for r in bigrams.mapInArrow(fn, "base long, counts binary").toLocalIterator():
        part = np.frombuffer(r["counts"], "<f4").reshape(-1, 2, n_classes)
        out[r["base"] : r["base"] + len(part)] += part
    return out[:, 0], out[:, 1]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange_round(classes: np.ndarray, counts: np.ndarray, right: np.ndarray, left: np.ndarray, movable: int) -> int:
    """Moves words, most frequent first, to the class of the highest likelihood; returns the number of moves.

    classes is changed in place; classes from `movable` on are fixed.
    """
    k = right.shape[1]
    rows, cols = np.zeros((k, k)), np.zeros((k, k))
    np.add.at(rows, classes, right)  # rows[c, c2]: class c followed by c2
    np.add.at(cols, classes, left)  # cols[c, c2]: class c preceded by c2
    row_sum, col_sum = rows.sum(1), cols.sum(1)
    moves = 0
    for w in np.argsort(-counts, kind="stable"):
        c = classes[w]
        if c >= movable:
            continue
        r, q = right[w], left[w]
        rows[c] -= r
        cols[c] -= q
        row_sum[c] -= r.sum()
        col_sum[c] -= q.sum()
        ri, qi = np.flatnonzero(r), np.flatnonzero(q)
        a, b = rows[:movable][:, ri], cols[:movable][:, qi]
        gain = (_xlogx(a + r[ri]) - _xlogx(a)).sum(1) + (_xlogx(b + q[qi]) - _xlogx(b)).sum(1)
        gain -= _xlogx(row_sum[:movable] + r.sum()) - _xlogx(row_sum[:movable]) + _xlogx(col_sum[:movable] + q.sum()) - _xlogx(col_sum[:movable])
        best = int(np.argmax(gain))
        if gain[best] <= gain[c] + 1e-9:
            best = c
        moves += best != c
        classes[w] = best
        rows[best] += r
        cols[best] += q
        row_sum[best] += r.sum()
        col_sum[best] += q.sum()
    return moves


#: Up to this count, what a count adds to each cell of the class table is looked up.
_LOOKED_UP = 8
_FEW_KEYS = 6
_CHUNK = 1 << 20


def best_classes(now: np.ndarray, draw: np.ndarray, key: np.ndarray, n: np.ndarray, table: np.ndarray, movable: int) -> np.ndarray:
    """The class of the highest likelihood gain for each word, ties to its class in `now`, then to one of them by its
    number in `draw`: words alike would otherwise fill one empty class together, and be parted by no sweep.

    now holds -1 for words that `table` (counts of class pairs) does not contain. Ascending keys are
    (word * 2 + side) * classes + class of the neighbour, side 0 for those on the right; n are their counts.
    Classes from `movable` on are fixed.
    """
    k = len(table)
    out = now.copy()
    sides = [np.ascontiguousarray(table.T), table]  # [side][neighbour, class]
    logs = [_xlogx(x) for x in sides]
    sums = [table.sum(1), table.sum(0)]
    seen = [np.concatenate([_xlogx(x + i) - l for i in range(_LOOKED_UP + 1)]) for x, l in zip(sides, logs, strict=True)]  # row count * k + neighbour
    step = max(1, _CHUNK // (2 * k * k))  # no word has more than 2 k keys
    cuts = [0]
    first = np.searchsorted(key, np.arange(len(now) + 1) * 2 * k)
    while cuts[-1] < len(now):  # about _CHUNK cells a piece
        cuts.append(max(cuts[-1] + step, int(np.searchsorted(first, first[cuts[-1]] + _CHUNK // k, "right")) - 1))
        cuts[-1] = min(cuts[-1], len(now))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        e = slice(int(first[lo]), int(first[hi]))
        word, side, j, x = key[e] // (2 * k) - lo, key[e] // k % 2, key[e] % k, n[e]
        own = now[lo:hi]
        gain = np.zeros((hi - lo, k))
        for s in (0, 1):
            on = side == s
            w, c, m = word[on], j[on], x[on]
            begin = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, int)
            size = np.diff(np.r_[begin, len(w)])

            def cells(at: np.ndarray) -> np.ndarray:
                """What the given keys add to each class."""
                out = seen[s].take(np.minimum(m[at], _LOOKED_UP) * k + c[at], 0)
                more = np.flatnonzero(m[at] > _LOOKED_UP)
                if len(more):
                    out[more] = _xlogx(sides[s][c[at[more]]] + m[at[more], None]) - logs[s][c[at[more]]]
                # what a word adds to its own class is already in the table
                held = np.flatnonzero(own[w[at]] >= 0)
                keys, mine = at[held], own[w[at[held]]]
                out[held, mine] = logs[s][c[keys], mine] - _xlogx(np.maximum(sides[s][c[keys], mine] - m[keys], 0))
                return out

            # most words have few keys: all first ones at once, then all second ones; the other words' keys are summed up
            few = size <= _FEW_KEYS
            for r in range(_FEW_KEYS):
                at = begin[few & (size > r)] + r
                if len(at):
                    gain[w[at]] += cells(at)
            if not few.all():
                at = np.flatnonzero(np.repeat(~few, size))
                gain[w[begin[~few]]] += np.add.reduceat(cells(at), np.r_[0, np.cumsum(size[~few])[:-1]])
            added = np.bincount(w, m, hi - lo)
            some, which = np.unique(added, return_inverse=True)
            less = (_xlogx(sums[s] + some[:, None]) - _xlogx(sums[s]))[which]
            at = np.flatnonzero(own >= 0)
            total = sums[s][own[at]]
            less[at, own[at]] = _xlogx(total) - _xlogx(np.maximum(total - added[at], 0))
            gain -= less
        rows = np.arange(hi - lo)
        best = np.argmax(gain[:, :movable], 1)
        ties = gain[:, :movable] >= gain[rows, best][:, None] - 1e-9
        several = np.flatnonzero(ties.sum(1) > 1)
        if len(several):
            order = np.cumsum(ties[several], 1)
            best[several] = np.argmax(order > (draw[lo:hi][several] % order[:, -1].astype(np.uint64)).astype(np.int64)[:, None], 1)
        stay = (own >= 0) & ((own >= movable) | (gain[rows, best] <= gain[rows, own] + 1e-9))
        out[lo:hi] = np.where(stay, own, best)
    return out


def _exchanged(blocks: DataFrame, words, classes, table, shards: int, n_classes: int, scratch: Scratch, name: str) -> tuple[DataFrame, np.ndarray]:
    """Per block and shard the counts over all training documents and the new classes of the block's words; and
    [V, n1, n2, tokens by class..., words by class...]. Without info in the blocks only `words` have a class, and keep it."""
    first = "info" not in blocks.columns
    none = 2**16 - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, row in _streams(batches):
            if first:
                number = _found(s, words.value)
                cls = np.where(number >= 0, classes.value[np.maximum(number, 0)] if len(classes.value) else 0, -1)
            else:
                cls = _informed(s, row)[1]
            a, b = s.left[s.train].astype(np.int64), s.stream[s.train].astype(np.int64)
            right, left = cls[b] >= 0, cls[a] >= 0
            keys = np.concatenate([(2 * a[right]) * n_classes + cls[b[right]], (2 * b[left] + 1) * n_classes + cls[a[left]]])
            if first:  # words of the start stay
                keys = keys[cls[keys // (2 * n_classes)] < 0]
            keys, n = np.unique(keys, return_counts=True)
            at = keys // (2 * n_classes)
            rows = []
            for k, i, j in slices(s.lexicon, shards):
                x, y = np.searchsorted(at, (i, j))
                rows.append((k, s.number, s.lexicon[i:j].tobytes(), s.counts[i:j].astype("<u4").tobytes(), np.where(cls[i:j] < 0, none, cls[i:j]).astype("<u2").tobytes(), np.bincount(at[x:y] - i, minlength=j - i).astype("<u4").tobytes(), (keys[x:y] % (2 * n_classes)).astype("<u2").tobytes(), n[x:y].astype("<u4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 6), strict=True)], ["shard", "block", "h", "n", "now", "keys", "near", "times"])

    def decide(got: pa.Table) -> pa.Table:
        rows = got.to_pylist()
        h = [np.frombuffer(r["h"], "<u8") for r in rows]
        keys, inverse = np.unique(np.concatenate(h), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([np.frombuffer(r["n"], "<u4") for r in rows])).astype(np.int64)
        base = np.cumsum([0, *map(len, h)])
        now = np.empty(len(keys), np.int64)
        now[inverse] = np.concatenate([np.frombuffer(r["now"], "<u2") for r in rows])
        now[now == none] = -1
        word = np.concatenate([np.repeat(inverse[base[i] : base[i + 1]], np.frombuffer(r["keys"], "<u4")) for i, r in enumerate(rows)]).astype(np.int64)
        near = np.concatenate([np.frombuffer(r["near"], "<u2") for r in rows]).astype(np.int64)
        key, times = _summed(word * 2 * n_classes + near, np.concatenate([np.frombuffer(r["times"], "<u4") for r in rows]).astype(np.int64))
        cls = best_classes(now, keys, key, times, table.value, n_classes - 1)
        if first:
            cls[now >= 0] = now[now >= 0]
        seen = n > 0
        stats = np.concatenate([[seen.sum(), (n == 1).sum(), (n == 2).sum()], np.bincount(cls[seen], n[seen], n_classes), np.bincount(cls[seen], minlength=n_classes)]).astype("<i8")
        parts = [inverse[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]
        kind = "<u4" if n.max(initial=0) < 1 << 32 else "<i8"
        return pa.table(
            {
                "block": pa.array([*(r["block"] for r in rows), -1], pa.int64()),
                "shard": pa.array([*(r["shard"] for r in rows), rows[0]["shard"]], pa.int64()),
                "n": pa.array([*(n[p].astype(kind).tobytes() for p in parts), stats.tobytes()], pa.binary()),
                "cls": pa.array([*(cls[p].astype("<u2").tobytes() for p in parts), None], pa.binary()),
            }
        )

    sent = blocks.mapInArrow(send, "shard long, block long, h binary, n binary, now binary, keys binary, near binary, times binary")
    out = scratch.store(sent.groupBy("shard").applyInArrow(decide, "block long, shard long, n binary, cls binary"), name)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 + 2 * n_classes, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                total += np.frombuffer(cell.as_buffer(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "x"])

    stats = np.zeros(3 + 2 * n_classes, np.int64)
    for r in out.where("block < 0").select("n").mapInArrow(add, "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).collect():
        stats[r["i"]] = r["x"]
    per_block = out.where("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "n", "cls"))).alias("info"))
    return per_block, stats


def likelihood(table: np.ndarray) -> float:
    """The part of the class bigram likelihood that depends on the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def _informed(s: Stream, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(count, class) of each lexicon entry: the shards' slices, in order. A shard writes counts in 4 bytes where they fit, else in 8."""
    info = row["info"]
    counts = [np.frombuffer(i["n"], "<u4" if len(i["n"]) == 2 * len(i["cls"]) else "<i8") for i in info]  # cls has 2 bytes each
    return np.concatenate([c.astype(np.int64) for c in counts]), np.concatenate([np.frombuffer(i["cls"], "<u2") for i in info]).astype(np.int64)


def _transitions(informed: DataFrame, n_classes: int) -> np.ndarray:
    """Counts of class pairs; the last row is of words seen once, as what precedes."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_classes + 1) * n_classes, np.int64)
        for s, row in _streams(batches):
            n, cls = _informed(s, row)
            to, left = cls[s.stream][s.train], s.left[s.train]
            total += np.bincount(cls[left] * n_classes + to, minlength=len(total))
            total += np.bincount(n_classes * n_classes + to[n[left] == 1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "x"])

    out = np.zeros((n_classes + 1) * n_classes)
    for r in informed.mapInArrow(fn, "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).collect():  # a row for each class pair at most
        out[r["i"]] = r["x"]
    return out.reshape(n_classes + 1, n_classes)


def scores(docs: DataFrame, n_base: int | None = None, share: float = 2e-5, rounds: int = 6, weight: float = 0.95, block_bytes: int = BLOCK_BYTES, sweeps: int = 2) -> DataFrame:
    """docs with held (boolean) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    n_base counts the classes with the end token's, and follows the vocabulary if not given; weight is the
    class model's part in the mixture.
    """
    scratch = Scratch(docs.sparkSession, "brown")
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20)}):
        return scratch.store(_scores(docs, n_base, share, rounds, weight, block_bytes, sweeps, scratch), "scores")


def _scores(docs: DataFrame, n_base: int | None, share: float, rounds: int, weight: float, block_bytes: int, sweeps: int, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    docs = settled(docs.select("doc_id", "held", "text"), scratch, "rows")
    n = texts.blocks_for(docs.agg(F.sum(F.octet_length("text"))).first()[0], block_bytes)
    rows = docs.select(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(n)).alias("block"), F.col("doc_id").cast("long").alias("id"), "held", F.col("text").cast("binary").alias("text"))
    blocks = scratch.store(rows.repartition(texts.partitions_for(n, spark), "block").groupBy("block").applyInArrow(_stream, STREAMS), "blocks")
    total = blocks.agg(F.sum("trained")).first()[0] or 0

    with shuffles_dropped(spark):
        words, counts, vocabulary = _starting_words(blocks, n, max(1, int(np.ceil(share * total))))
    n_base = n_base or class_number(vocabulary)
    classes = np.empty(len(words), np.int64)
    classes[np.argsort(-counts, kind="stable")] = np.arange(len(words)) % (n_base - 1)
    classes[words == END] = n_base - 1
    shared = spark.sparkContext.broadcast(words)
    table = np.zeros((n_base, n_base))
    if len(words) > 1 and rounds:
        bigrams = _bigrams(blocks, shared, scratch)
        for i in range(rounds + 1):
            now = spark.sparkContext.broadcast(classes.copy())
            right, left = _by_class(bigrams, now, n_base, len(words))
            if i == rounds or exchange_round(classes, counts, right, left, n_base - 1) <= len(words) // 200:
                break
        right, _ = _by_class(bigrams, spark.sparkContext.broadcast(classes.copy()), n_base, len(words))
        np.add.at(table, classes, right)
        scratch.drop("pairs", "bigrams")

    def joined(per_block: DataFrame) -> tuple[DataFrame, np.ndarray]:
        informed = blocks.join(per_block, "block")
        with shuffles_dropped(spark):
            return informed, _transitions(informed, n_base)

    broadcast = spark.sparkContext.broadcast
    per_block, stats = _exchanged(blocks, shared, broadcast(classes), broadcast(table), n, n_base, scratch, "words0")
    informed, moves = joined(per_block)
    for i in range(1, sweeps + 1):
        per_block, new = _exchanged(informed, None, None, broadcast(moves[:n_base]), n, n_base, scratch, f"words{i}")
        then, after = joined(per_block)
        if likelihood(after[:n_base]) <= likelihood(moves[:n_base]):
            scratch.drop(f"words{i}")
            break
        informed, moves, stats = then, after, new
        scratch.drop(f"words{i - 1}")
    model = broadcast(Model(stats, moves, n_base, weight))
    return informed.mapInArrow(lambda batches: _scored(batches, model.value), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def class_number(vocabulary: int) -> int:
    """Classes for so many training words; never fewer than 48."""
    return min(2**15 - 1, max(48, 2 * int(np.ceil(np.cbrt(vocabulary)))))


class Model:
    """Tables of a trained model; all of a size fixed by the number of classes."""

    def __init__(self, stats: np.ndarray, moves: np.ndarray, n_base: int, weight: float, prior: float = 5.0):
        k = moves.shape[1]
        self.vocabulary, once, twice = (int(x) for x in stats[:3])
        tokens, kinds = stats[3 : 3 + k].astype(float), stats[3 + k :].astype(float)
        self.total, self.weight = int(tokens.sum()), weight
        d = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
        self.discount = np.full(k, d)
        self.discount[n_base - 1] = 0.0
        self.size = np.maximum(tokens, 1.0)
        share = tokens / max(1.0, tokens.sum())
        self.move = (moves + prior * share) / (moves.sum(1, keepdims=True) + prior)
        self.unseen = self.move @ (self.discount * kinds / self.size)


def _scored(batches: Iterator[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
    k = m.move.shape[1]
    for s, row in _streams(batches):
        n, cls = _informed(s, row)
        base = (n + 1.0) / (m.total + m.vocabulary + 1.0)
        if m.total:
            context = np.where(n > 0, cls, k)[s.left]
            context[s.first[:-1]] = cls[np.searchsorted(s.lexicon, END)]
            emit = np.where(n > 0, (n - m.discount[cls]) / m.size[cls], 0.0)
            p = np.where(n[s.stream] > 0, m.move[context, cls[s.stream]] * emit[s.stream], m.unseen[context])
            p = m.weight * p + (1 - m.weight) * base[s.stream]
        else:
            p = base[s.stream]

        def sums(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, s.first[:-1])

        docs = len(s.ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(s.ids, pa.int64(), mask=s.known == 0), pa.array(s.held == 1), pa.array(np.diff(s.first)), pa.array(sums((n[s.stream] > 0).astype(np.int64))), pa.array([m.total] * docs, pa.int64()), pa.array(sums(np.log10(base)[s.stream])), pa.array(sums(np.log10(p)))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    return scores(docs.withColumn("held", held))
