"""Best-fit packing of documents into token sequences, by bin-completion branch-and-bound.

A document is its token ids and an end id.  One longer than a sequence is cut into full pieces; only its
first piece may be shorter.  What is to be packed is known from the counts of the piece lengths alone, at
most CAPACITY numbers however large the corpus.  So the search runs over counts, on the driver: it yields
kinds of sequences (which lengths, how often that kind is used), and each piece finds its place from its
rank among the pieces of its length.  Ranks are counted in each task and shifted by the counts of earlier
tasks, so no length's pieces ever meet in one task.

Search: the incumbent is best fit decreasing.  While it doesn't meet the lower bound, branches complete the sequence around the
largest piece in undominated ways (no piece or group in it could be swapped for a larger waiting piece that still fits).
The first branch of a node takes the largest pieces whose waste stays within the even share of what a better solution may
waste; sums that pieces can reach are bits of one number, so that it costs about a shift a length.  They also give the least
waste of any completion: a node whose sequence must waste more than a better solution may is cut off, and so is one whose rest
can't do by the lower bound.  A kind of sequence is used as often as its pieces last, or once.  The other completions come in batches of at
most FILLINGS or STEPS, least waste first in each.  Best fit on what is left renews the incumbent.  The search ends at
the lower bound, when all is tried, or after WORK; that limits how long a better solution is sought, never which
pieces are packed.

Null text: as empty, the end id alone.  Null or repeated doc_id: packed like any other row.  Empty table: empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.llm.rans import slices
from kinmesh.llm.shared import keep
from kinmesh.llm.token_ids import encoder, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 0
#: Nodes times distinct lengths (and LEAST more) that the search may visit.
WORK, LEAST = 20_000_000, 200
#: Pieces of a completion up to which groups of two and three are tried for swaps; of more, single pieces are.
GROUPED = 16
#: Even shares of the waste that a better solution may have, that a node's first completion may waste; the search runs once for each.
SHARES = (1, 0)
#: What a batch of completions counts for, in nodes.
BATCH = 20
#: Best fit on what is left renews the incumbent at nodes of at most FEW distinct lengths, and at each of that many others.
FEW = 64
#: Fillings in a batch, and the steps that look for them.
FILLINGS, STEPS = 96, 4000

Kind = tuple[tuple[int, int], ...]  # (length, how many), longest first


# ---------------------------------------------------------------- the search over counts


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """The larger of total length over capacity and the bound by pieces of over half a sequence."""
    half = capacity // 2
    by = np.zeros(capacity + 1, dtype=np.int64)
    by[list(counts)] = list(counts.values())
    n = np.concatenate([[0], np.cumsum(by)])  # pieces shorter than each length, and their sum of lengths
    total = np.concatenate([[0], np.cumsum(by * np.arange(capacity + 1))])
    k = np.concatenate([[0], np.flatnonzero(by[: half + 1])])
    n_middle = n[capacity - k + 1] - n[half + 1]
    room = n_middle * capacity - (total[capacity - k + 1] - total[half + 1])
    small = total[half + 1] - total[k]
    large = n[-1] - n[capacity - k + 1] + n_middle + np.maximum(0, -(-(small - room) // capacity))
    return max(-(-int(total[-1]) // capacity), int(large.max()))


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Kind, int]]:
    """Best fit decreasing, many pieces a step: sequences of one kind and room are one entry."""
    room: dict[int, list[list]] = {}  # room left -> [kind as a list of (length, n), how many sequences]
    mask = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = mask >> length
            if not at:
                each = capacity // length  # new sequences, as full of this length as they get
                full, rest = divmod(left, each)
                for n, k in ((full, each), (1, rest)):
                    if n and k:
                        r = capacity - k * length
                        room.setdefault(r, []).append([((length, k),), n])
                        mask |= 1 << r
                break
            r = length + (at & -at).bit_length() - 1
            kind, n = room[r][-1]
            k = min(r // length, left)
            take = min(n, left // k)
            if take == n:
                room[r].pop()
                if not room[r]:
                    mask &= ~(1 << r)
            else:
                room[r][-1][1] -= take
            room.setdefault(r - k * length, []).append([kind + ((length, k),), take])
            mask |= 1 << r - k * length
            left -= take * k
    return [(kind, n) for entries in room.values() for kind, n in entries]


def fillings(counts: dict[int, int], largest: int, waste: int, capacity: int = CAPACITY) -> Iterator[list[tuple[int, ...]]]:
    """All undominated completions of a sequence that holds largest, with waste at most waste, in batches; least waste first in each."""
    have = {x: n - (x == largest) for x, n in counts.items()}
    rising = sorted(x for x in have if have[x] > 0 and x <= capacity - largest)
    lengths = rising[::-1]
    found: dict[tuple[int, ...], int] = {}
    smallest = lengths[-1] if lengths else capacity + 1
    steps = STEPS
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, capacity - largest, ())]
    while stack:
        if not steps or len(found) == FILLINGS:
            yield _ordered(found)
            found, steps = {}, STEPS
        steps -= 1
        i, left, chosen = stack.pop()
        fit = max(i, len(lengths) - bisect_right(rising, left)) if left >= smallest else len(lengths)
        while fit < len(lengths) and have[lengths[fit]] <= chosen.count(lengths[fit]):
            fit += 1
        if fit >= len(lengths):
            if left <= waste and not _dominated(chosen, left, rising, have):
                found[chosen] = left
            continue
        stack.append((fit + 1, left, chosen))  # without any more of this length
        stack.append((fit, left - lengths[fit], (*chosen, lengths[fit])))
    yield _ordered(found)


def _ordered(found: dict[tuple[int, ...], int]) -> list[tuple[int, ...]]:
    return sorted(found, key=lambda c: (found[c], len(c), [-x for x in c]))


def _dominated(chosen: tuple[int, ...], left: int, lengths: list[int], have: dict[int, int]) -> bool:
    """Whether a waiting piece could take the place of some chosen ones (or of none) and still fit.  lengths rise."""
    for k in range(min(len(chosen), 3 if len(chosen) <= GROUPED else 1) + 1):
        for group in set(combinations(chosen, k)) if k > 1 else {(x,) for x in chosen} if k else {()}:
            total = sum(group)
            for i in range(bisect_left(lengths, total + (k <= 1)), len(lengths)):  # one piece only by a larger one
                x = lengths[i]
                if x > total + left:
                    break
                if x not in group and have[x] > chosen.count(x):
                    return True
    return False


def completion(counts: dict[int, int], largest: int, waste: int, capacity: int = CAPACITY) -> tuple[tuple[int, ...], int]:
    """The completion of a sequence that holds largest, of the largest pieces that waste at most that (or as little as can be, if that is
    more), and the least waste of any completion.  It is undominated: with a larger waiting piece in place of some of its own, or one more
    piece, it would waste less and come first."""
    room = capacity - largest
    within = (1 << room + 1) - 1
    reach, below = 1, []  # bit s: a sum s can be had of the pieces so far; below: before each length
    for x in sorted(x for x in counts if x <= room):
        n = min(counts[x] - (x == largest), room // x)
        if n > 0:
            below.append((x, n, reach))
            step = 1
            while n:  # n copies as sums of 1, 2, 4 and so on of them
                step = min(step, n)
                reach |= reach << x * step & within
                n -= step
                step *= 2
    least = room - (reach.bit_length() - 1)
    waste = min(room, max(waste, least))
    window = (1 << waste + 1) - 1
    left, chosen = room, []
    for x, n, before in reversed(below):
        if left < x:
            continue
        k = min(n, left // x)
        # some sum of the shorter pieces must fill what is left up to the waste
        while k and not (before >> left - k * x - waste & window if left - k * x >= waste else before & (1 << left - k * x + 1) - 1):
            k -= 1
        chosen += [x] * k
        left -= k * x
    return tuple(chosen), least


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY, work: int = WORK) -> list[tuple[Kind, int]]:
    """Kinds of sequences and how many of each, that hold all pieces; as few sequences as the search finds."""
    counts = {x: n for x, n in counts.items() if n}
    full = [(((capacity, 1),), counts.pop(capacity))] if capacity in counts else []
    if not counts:
        return full
    size = lambda plan: sum(n for _, n in plan)
    best = best_fit(counts, capacity)
    found, bound, total = size(best), lower_bound(counts, capacity), sum(x * n for x, n in counts.items())

    def branches(share: int, left: dict[int, int], done: tuple, used: int, wasted: int) -> Iterator:
        """What follows a node, one at a time; None ahead of each batch of fillings."""
        largest = max(left)
        allowed = (found - 1) * capacity - total - wasted
        first, least = completion(left, largest, share * allowed // max(1, bound - used), capacity)
        if least > allowed:
            return
        yield from follow(left, done, used, wasted, (largest, *first))
        for batch in fillings(left, largest, (found - 1) * capacity - total - wasted, capacity):
            yield None
            for chosen in batch:
                if chosen != first:
                    yield from follow(left, done, used, wasted, (largest, *chosen))

    def follow(left: dict[int, int], done: tuple, used: int, wasted: int, pieces: tuple[int, ...]) -> Iterator:
        kind = tuple((x, pieces.count(x)) for x in sorted(set(pieces), reverse=True))
        waste, times = capacity - sum(pieces), min(left[x] // k for x, k in kind)
        for n in sorted({min(times, max(1, ((found - 1) * capacity - total - wasted) // waste if waste else times)), 1}, reverse=True):
            if wasted + waste * n <= (found - 1) * capacity - total:
                rest = left.copy()
                for x, k in kind:
                    rest[x] -= k * n
                    if not rest[x]:
                        del rest[x]
                yield rest, (done, (kind, n)), used + n, wasted + waste * n

    def plan(done: tuple) -> list[tuple[Kind, int]]:
        out = []
        while done:
            done, last = done
            out.append(last)
        return out[::-1]

    for share in SHARES:  # all over again with another first branch, unless the search is done
        stack: list[Iterator] = [iter([(counts, (), 0, 0)])]
        nodes, seen = max(1, work // (len(counts) + LEAST) // len(SHARES)), 0
        fewest: dict[frozenset, int] = {}  # sequences with which each small rest was reached
        while stack and nodes > 0 and found > bound:
            if (node := next(stack[-1], False)) is False:
                stack.pop()
                continue
            nodes -= 1
            if node is None:
                nodes -= BATCH
                continue
            left, done, used, wasted = node
            if (found - 1) * capacity - total - wasted < 0:
                continue
            seen += 1
            if len(left) <= FEW:
                if fewest.get(key := frozenset(left.items()), found) <= used:
                    continue
                fewest[key] = used
            if done and (len(left) <= FEW or seen % FEW == 0):
                rest = best_fit(left, capacity) if left else []
                if used + size(rest) < found:
                    best, found = plan(done) + rest, used + size(rest)
            if not left or (found - 1) * capacity - total - wasted < 0 or used + lower_bound(left, capacity) >= found:
                continue
            stack.append(branches(share, left, done, used, wasted))
        if not stack or found <= bound:
            break
    return full + best


def slots(plan: list[tuple[Kind, int]]) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, pieces in a sequence, offset), by length and rank: the
    pieces of a length with these ranks fill sequences of one kind.  At most a few rows a kind: bounded by CAPACITY."""
    rows, taken, sequence = [], {}, 0
    for kind, n in plan:
        offset = 0
        for length, k in kind:
            at = taken.get(length, 0)
            rows.append((length, at, at + n * k, sequence, k, offset))
            taken[length] = at + n * k
            offset += length * k
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


# ---------------------------------------------------------------- pieces


def cut(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity or capacity
    at = min(n, first)
    yield 0, at
    while at < n:
        yield at, capacity
        at += capacity


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row a piece, with its rank among its task's pieces of that length."""

    def run(batches):
        ranks: dict[int, int] = {}
        task = TaskContext.get().partitionId()
        encode = encoder(path, True).batch
        for part in (x for batch in batches for x in slices(batch)):
            ids, n = encode(part.column(1))
            pa.default_memory_pool().release_unused()  # else each worker keeps the most that a slice took
            raw = memoryview(np.insert(ids, np.cumsum(n), END_ID).astype("<u4", copy=False)).cast("B")
            rows, at = [], 0
            for key, size in zip(part.column(0).to_pylist(), (n + 1).tolist()):
                for k, (start, length) in enumerate(cut(size, capacity)):
                    crc = zlib.crc32(raw[4 * (at + start) : 4 * (at + start + length)])
                    rows.append((key, k, start, length, crc, task, ranks.get(length, 0)))
                    ranks[length] = rows[-1][-1] + 1
                at += size
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece's place."""
    spark = docs.sparkSession
    pieces = keep(token_pieces(docs, path or tokenizer_path(TOKENIZER), capacity), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    shipped = spark.sparkContext.broadcast(slots(pack_counts(counts, capacity)))
    before = by_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))

    def place(batches):
        table = shipped.value
        # lengths and ranks as one number: ranks are under 2^50
        keys = table[:, 0] << 50 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = table[np.searchsorted(keys, length << 50 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + nth % row[:, 4] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
