"""Near-duplicates by Order MinHash, verified by banded alignment.

The k-mers of a document are its runs of ``k`` words, each labelled with its
occurrence number, so that a repeated run counts as often as it occurs. For
each of ``m`` hash functions a sketch keeps the ``l = 2`` k-mers with the
smallest hashes, in the order in which they stand in the text. Two sketches
agree with a probability that falls with the edit distance, not just with the
overlap: moving passages about changes the order.

1. Documents with the same word sequence are one representative, the smallest id.
2. Representatives that share a sketch form a bucket. Its members are compared
   with its smallest id, its hub, unless the two are of one class by then: first
   in the buckets of one sketch, which settle the large groups of near copies,
   then in those of more and more sketches. Of a bucket of ``FEW`` members or
   fewer, all that are of different classes by then are compared with each other.
   A larger one takes another hub, the member with most links so far, until two in a
   row have not brought any of its classes together. A round is linear in the bucket.
3. A pair is a link when its edit similarity over words, 1 - distance /
   longer length, is ``similarity`` or more, at any length of text. Alignments
   through runs of words that both have once, or within a narrow band, show that
   most links are links; what has fewer runs in common than any link must have is
   none; for the rest a band is widened until it holds the allowed distance.
4. Connected components of the links give the classes.

Candidates are found with high probability, not with certainty. At the
threshold itself, with a word in five changed at random places, a third of the
5-mers are left (0.8^5), their share of both texts' k-mers is J = s / (2 - s) =
0.2, and a sketch agrees with J^2 = 0.04: of 64 one at least with 0.93. Where
words are changed at even distances fewer 5-mers are left, or none: so texts have
sketches of runs of three words too (``EVEN``), of which two in five are left with every
fifth word changed; one of these at least agrees then with 0.94, and at random places with
0.996. Two texts that share a passage with thousands meet in the buckets of the passage and
also in those of their own words, where they are alone. Few k-mers are left in a
short text, so texts of few words are sketched by shorter ones alone (``SHORTER``).

Edge cases: null text has no words, and all documents without words are one
class; a document of fewer than ``k`` words is one k-mer; rows of one id are one
document, whose text is, of several, the one whose words have the smallest MD5
(so that it depends on nothing else); rows with a null id take no part and come
out with a null class, kept; an empty table gives an empty result; other columns are
ignored by :func:`near_duplicates` and kept by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limber.llm.common import free_name, settled, text_of, words, written, written_so_far
from limber.llm.components import ROWS_A_TASK, connected_components

K = 5
SKETCHES = 64
#: Runs of so many words, and sketches of these, for texts of any length beside those of K words.
EVEN = (3, 44)
SIMILARITY = 0.8
#: Sketches of texts of up to so many words: (most words, k, sketches), shortest first.
SHORTER = ((15, 2, 64), (80, 3, 64))
#: The buckets of so many sketches of each kind are compared in a first and second stage, those of the others in a third.
STAGES = (1, 8)
#: Up to so many pairs their ids are broadcast to pick their texts.
BROADCAST_PAIRS = 100_000
#: Pairs that a task aligns at least; few pairs make few tasks, whatever the number of shuffle partitions.
PAIRS_A_TASK = 100
#: Members of a bucket that are all compared with each other.
FEW = 24
#: Runs of so many words that members of larger buckets have in common if they are links; longer ones are taken where fewer classes have them.
SIZES = (4, 2, 1)
#: Such runs are counted in 2^BIN_BITS bins.
BIN_BITS = 20
#: Texts of so many words and more, up to the next number, are a band: runs meet by the band of the text and by where they stand in it.
BANDS = [1]
while BANDS[-1] < 1 << 31:
    BANDS.append(BANDS[-1] * 5 // 4 + 1)
#: Texts a task cuts into such runs, about.
TEXTS_A_TASK = 1000
#: Words of a block of texts that are met with all texts of another, about.
BLOCK_WORDS = 1 << 18
#: Words handled at once by the sketching code; bounds its arrays.
CHUNK_WORDS = 1 << 18
#: Texts of more than SHORT words are first aligned through shared runs of RUN words, which settles most near copies.
SHORT, RUN = 256, 8
#: Pieces between such runs that are longer than this are not aligned there; the whole texts are then.
MOST_PIECE = 8192
#: Table cells of a batch of alignments, about.
CELLS = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def labelled_kmers(ids: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-mers of consecutive documents, the same with occurrence labels, and k-mers per document (1 at least where there is a word)."""
    docs = np.flatnonzero(lengths > 0)
    counts = np.zeros(len(lengths), dtype=np.int64)
    counts[docs] = np.maximum(lengths[docs] - k + 1, 1)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    first = np.repeat(starts, counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    room = np.repeat(np.minimum(lengths, k), counts)
    padded = np.r_[ids.astype(np.uint32).astype(np.uint64), np.zeros(k, dtype=np.uint64)]
    h = np.zeros(len(first), dtype=np.uint64)
    for j in range(k):
        word = np.where(j < room, padded[first + j] + np.uint64(1), np.uint64(0))
        h = _mix(h * np.uint64(0x100000001B3) + word)
    own = h ^ _mix(np.repeat(np.arange(len(lengths), dtype=np.uint64) + np.uint64(1), counts))
    ordered = np.sort(own)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    label = np.zeros(len(h), dtype=np.uint64)
    if len(twice):
        at = np.flatnonzero(np.isin(own, twice))
        by = at[np.argsort(own[at], kind="stable")]
        new = np.r_[True, own[by][1:] != own[by][:-1]]
        run = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        label[by] = run.astype(np.uint64)
    return h, _mix(h + label * np.uint64(0xD6E8FEB86659FD93)), counts


def multipliers(m: int) -> np.ndarray:
    """Odd 64-bit numbers, one a hash function: x times one of them orders the (mixed) x anew."""
    return _mix(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def order_minhash(ids: np.ndarray, lengths: np.ndarray, k: int = K, m: int = SKETCHES) -> np.ndarray:
    """Sketches (documents x m, uint64) of consecutive documents given as word ids; every length must be positive. Their last two bits are the stage."""
    h, labelled, counts = labelled_kmers(ids, lengths, k)
    starts = np.cumsum(counts) - counts
    # The low bits of a hash are replaced by the place, so that the least hash tells where it stands.
    low = np.uint64((1 << max(1, int(len(h)).bit_length())) - 1)
    place, high, top = np.arange(len(h), dtype=np.uint64), ~low, ~np.uint64(0)
    out = np.empty((len(lengths), m), dtype=np.uint64)
    several = counts > 1
    stages = np.searchsorted(STAGES, np.arange(m), side="right").astype(np.uint64)
    for s, a in enumerate(multipliers(m)):
        y = (labelled * a) & high | place
        one = np.minimum.reduceat(y, starts) & low
        y[one.astype(np.int64)] = top
        two = np.where(several, np.minimum.reduceat(y, starts) & low, one)
        first, second = np.minimum(one, two).astype(np.int64), np.maximum(one, two).astype(np.int64)
        pair = _mix(h[first]) * np.uint64(3) + np.where(several, _mix(h[second] ^ top), np.uint64(0))
        out[:, s] = _mix(pair + np.uint64(k << 32 | s)) & ~np.uint64(3) | stages[s]
    return out


def tiers(k: int, m: int, similarity: float) -> list[tuple[float, float, int, int]]:
    """(fewest words, most words, k, sketches): any two texts whose lengths allow a link are both in one of them."""
    found, least = [], 0.0
    for most, short_k, short_m in SHORTER:
        if short_k < k:
            found.append((least, most, short_k, short_m))
            least = similarity * most - 1e-9
    even_k, even_m = EVEN
    beyond = max((most for _, most, size, _ in found if size == even_k), default=0)
    if even_k < k:
        found.append((beyond + 1, float("inf"), even_k, even_m))
    return [*found, (least, float("inf"), k, m)]


def _sketched(batches: Iterator[pa.RecordBatch], k: int, m: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Words (wh) to their number n and the sketches of all tiers the text is in."""
    for batch in batches:
        values, ends = _flat(batch.column("wh"))
        lengths = np.diff(ends)
        parts = []
        filled = np.zeros(len(lengths), dtype=np.int64)
        for least, most, size, n_sketches in tiers(k, m, similarity):
            at = np.flatnonzero((lengths > 0) & (lengths >= least) & (lengths <= most))
            lo, sums = 0, np.cumsum(lengths[at])
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + CHUNK_WORDS, side="right")))
                ids = np.concatenate([values[ends[i] : ends[i + 1]] for i in at[lo:hi]])
                parts.append((at[lo:hi], filled[at[lo:hi]], order_minhash(ids, lengths[at[lo:hi]], size, n_sketches)))
                lo = hi
            filled[at] += n_sketches
        starts = np.r_[0, np.cumsum(filled)]
        flat = np.empty(int(starts[-1]), dtype=np.int64)
        for at, before, sketches in parts:
            flat[(starts[at] + before)[:, None] + np.arange(sketches.shape[1])] = sketches.view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("same"), pa.array(lengths.astype(np.int32)), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))],
            names=["id", "same", "n", "sketches"],
        )


def shared_runs(a: np.ndarray, b: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of runs of words that both have exactly once, as many as stand in the same order."""
    places = []
    for x in (a, b):
        h = np.zeros(max(0, len(x) - run + 1), dtype=np.uint64)
        for j in range(run):
            h = _mix(h * np.uint64(0x100000001B3) + x[j : j + len(h)].view(np.uint64) + np.uint64(1))
        values, first, n = np.unique(h, return_index=True, return_counts=True)
        places.append((values[n == 1], first[n == 1]))
    _, i, j = np.intersect1d(places[0][0], places[1][0], assume_unique=True, return_indices=True)
    at_a, at_b = places[0][1][i], places[1][1][j]
    order = np.argsort(at_a)
    at_a, at_b = at_a[order], at_b[order]
    if (at_b[1:] > at_b[:-1]).all():
        return at_a, at_b
    ends: list[int] = []  # the longest ascending subsequence of at_b, by patience
    ends_at: list[int] = []
    before = np.empty(len(at_b), dtype=np.int64)
    for p, v in enumerate(at_b.tolist()):
        pile = bisect_left(ends, v)
        before[p] = ends_at[pile - 1] if pile else -1
        ends[pile : pile + 1], ends_at[pile : pile + 1] = [v], [p]
    chain, p = [], ends_at[-1] if ends_at else -1
    while p >= 0:
        chain.append(p)
        p = int(before[p])
    return at_a[chain[::-1]], at_b[chain[::-1]]


def pieces(a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The pieces between shared runs, those that differ; equal ones have no distance."""
    at_a, at_b = shared_runs(a, b)
    at_a, at_b = np.r_[0, at_a, len(a)], np.r_[0, at_b, len(b)]
    differ = np.flatnonzero((np.diff(at_a) != 1) | (np.diff(at_b) != 1))
    return [(a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]]) for i in differ]


def _through_runs(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray) -> np.ndarray:
    """The distances of alignments that pass through the shared runs, none less than the edit distance."""
    parts, part_limits, owner = [], [], []
    found = np.zeros(len(pairs), dtype=np.int64)
    for i, (a, b) in enumerate(pairs):
        for x, y in pieces(a, b):
            longest = max(len(x), len(y))
            if longest > MOST_PIECE:
                found[i] += longest
            else:
                parts.append((x, y))
                part_limits.append(min(limits[i], longest))
                owner.append(i)
    np.add.at(found, np.array(owner, dtype=np.int64), banded_distances(parts, np.array(part_limits, dtype=np.int64)))
    return found


def shared_grams(a: np.ndarray, b: np.ndarray, q: int) -> int:
    """How many runs of q words both have, repeats counted; at least that many, should hashes collide."""
    sides = []
    for x in (a, b):
        h = np.zeros(max(0, len(x) - q + 1), dtype=np.uint64)
        for j in range(q):
            h = _mix(h * np.uint64(0x100000001B3) + x[j : j + len(h)].view(np.uint64) + np.uint64(1))
        sides.append(np.unique(h, return_counts=True))
    (u, n), (v, m) = sides
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def may_be_within(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """Whether the texts have as many runs of words in common as an edit distance within the limit leaves: each edit breaks q runs of q words at most."""
    longest = max(len(a), len(b))
    return all(longest - q + 1 - q * limit <= 0 or shared_grams(a, b, q) >= longest - q + 1 - q * limit for q in (4, 3, 2))


def within(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray) -> np.ndarray:
    """Whether the edit distances are within the limits; exact at any length."""
    longest = np.array([max(len(a), len(b)) for a, b in pairs], dtype=np.int64)
    cut = np.flatnonzero(longest > SHORT)
    near = np.zeros(len(pairs), dtype=bool)
    near[cut] = _through_runs([pairs[i] for i in cut], limits[cut]) <= limits[cut]
    open_ = [i for i in np.flatnonzero(~near) if longest[i] <= SHORT or may_be_within(*pairs[i], limits[i])]
    near[open_] = banded_distances([pairs[i] for i in open_], limits[open_], limits[open_]) <= limits[open_]
    return near


def banded_distances(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray, enough: np.ndarray | None = None) -> np.ndarray:
    """Edit distances over words, exact up to each pair's limit; above it, some number over the limit.

    A distance of no more than ``enough`` may be given too large, but not above that.
    """
    enough = np.full(len(pairs), -1) if enough is None else enough
    found = np.zeros(len(pairs), dtype=np.int64)
    left: list[int] = []
    cut: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i, (a, b) in enumerate(pairs):
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        head = int(differ[0]) if len(differ) else n
        a, b = a[head:], b[head:]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        tail = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        if min(len(a), len(b)) == 0 or abs(len(a) - len(b)) > limits[i]:
            found[i] = max(len(a), len(b))
            continue
        values, counts = np.unique(np.r_[a, b], return_counts=True)
        in_a = np.zeros(len(values), dtype=np.int64)
        seen, n_a = np.unique(a, return_counts=True)
        in_a[np.searchsorted(values, seen)] = n_a
        shared = int(np.minimum(in_a, counts - in_a).sum())
        if max(len(a), len(b)) - shared > limits[i]:  # no alignment can do better
            found[i] = max(len(a), len(b)) - shared
            continue
        cut[i] = (a, b)
        left.append(i)
    band = 8
    while left:
        left.sort(key=lambda i: max(map(len, cut[i])))
        again, lo = [], 0
        while lo < len(left):
            hi = lo + 1
            while hi < len(left) and (hi - lo) * (2 * band + 1) < CELLS and (hi - lo) * max(map(len, cut[left[hi]])) < 32 * CELLS:
                hi += 1
            group = left[lo:hi]
            got = _band(group, cut, band, max(limits[i] for i in group))
            for i, d in zip(group, got, strict=True):
                found[i] = d
                if d > max(band, enough[i]) and band < limits[i]:
                    again.append(i)
            lo = hi
        left = again
        band *= 4
    return found


def _band(group: list[int], cut: dict[int, tuple[np.ndarray, np.ndarray]], t: int, most: int) -> np.ndarray:
    """Distances within a band of ``t`` either side of the diagonal; over ``t`` they are upper bounds or infinite. What is over ``most`` may be left as infinite."""
    n = np.array([len(cut[i][0]) for i in group])
    m = np.array([len(cut[i][1]) for i in group])
    width, rows, far = 2 * t + 1, int(n.max()), 1 << 29
    a = np.full((len(group), rows), -1, dtype=np.int64)
    b = np.full((len(group), rows + width), -2, dtype=np.int64)
    for p, i in enumerate(group):
        a[p, : n[p]] = cut[i][0]
        y = cut[i][1][: rows + t]
        b[p, t : t + len(y)] = y
    step = np.arange(width)
    line = np.where(step >= t, step - t, far) + np.zeros((len(group), 1), dtype=np.int64)
    out = np.full(len(group), far)
    for r in range(1, rows + 1):
        new = line + (a[:, r - 1 : r] != b[:, r - 1 : r - 1 + width])
        np.minimum(new[:, :-1], line[:, 1:] + 1, out=new[:, :-1])
        line = np.minimum(np.minimum.accumulate(new - step, axis=1) + step, far)
        for p in np.flatnonzero(n == r):
            at = m[p] - n[p] + t
            out[p] = line[p, at] if 0 <= at < width else far
        if r % 256 == 0 and line.min() > most:  # no row's least ever falls
            break
    return out


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and ends (the first from 0) of the lists, also where the array is a slice."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64), ends - ends[0]


def shared_words(x: np.ndarray, x_ends: np.ndarray, y: np.ndarray, y_ends: np.ndarray) -> np.ndarray:
    """For each pair of lists how many words they have in common, repeats counted; at least that many, should hashes collide."""
    sides = []
    for words_, ends in ((x, x_ends), (y, y_ends)):
        pair = np.repeat(np.arange(len(ends) - 1, dtype=np.uint64), np.diff(ends))
        keys, first, n = np.unique(_mix(words_.view(np.uint64) ^ _mix(pair + np.uint64(1))), return_index=True, return_counts=True)
        sides.append((keys, pair[first].astype(np.int64), n))
    (a, pair, n), (b, _, m) = sides
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return np.bincount(pair[i], weights=np.minimum(n[i], m[j]), minlength=len(x_ends) - 1).astype(np.int64)


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (x, x_ends), (y, y_ends) = _flat(batch.column("x")), _flat(batch.column("y"))
        longest = np.maximum(np.diff(x_ends), np.diff(y_ends))
        limits = np.floor((1 - similarity) * longest + 1e-9).astype(np.int64)
        may = np.flatnonzero(longest - shared_words(x, x_ends, y, y_ends) <= limits)  # no alignment can do better
        pairs = [(x[x_ends[i] : x_ends[i + 1]], y[y_ends[i] : y_ends[i + 1]]) for i in may]
        linked = np.zeros(len(limits), dtype=bool)
        linked[may] = within(pairs, limits[may])
        names = ["a", "b", "label_a", "label_b"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(linked)], names=[*names, "linked"])


def _verify(pairs: DataFrame, n_pairs: int, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, label_a, label_b) to the same and linked."""
    if n_pairs <= BROADCAST_PAIRS:
        used = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        texts = texts.join(F.broadcast(used), "id", "left_semi")
    x, y = texts.select(F.col("id").alias("a"), F.col("wh").alias("x")), texts.select(F.col("id").alias("b"), F.col("wh").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "label_a", "label_b", "x", "y").coalesce(1 + n_pairs // PAIRS_A_TASK)
    kind = pairs.schema["a"].dataType.simpleString()
    return written(both.mapInArrow(lambda it: _verified(it, similarity), f"a {kind}, b {kind}, label_a {kind}, label_b {kind}, linked boolean"), "checked")


def _may_link(n: Column, n_other: Column, similarity: float) -> Column:
    """Whether texts of so many words can be a link."""
    return F.least(n, n_other) >= F.lit(similarity - 1e-9) * F.greatest(n, n_other)


def _all_pairs(members: DataFrame) -> DataFrame:
    """All pairs (id, n, hub, hub_n) of different classes in buckets of FEW members at most."""
    held = members.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "n", "label"))).alias("m")).where(F.exists("m", lambda x: x["label"] != F.get("m", F.lit(0))["label"]))
    later = lambda x: F.filter("m", lambda y: (y["id"] > x["id"]) & (y["label"] != x["label"]))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(later(x), lambda y: F.struct(y["id"].alias("id"), y["n"].alias("n"), x["id"].alias("hub"), x["n"].alias("hub_n")))))
    return held.select(F.explode(pairs).alias("p")).select("p.*")


def _compared(shared: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The classes (node, label) of the links found among the members of each bucket.

    ``shared`` has key (its last two bits are the stage), id, n, hub (the
    bucket's smallest id) and hub_n; ``texts`` the words (id, wh) of all its ids.
    """
    kind = shared.schema["id"].dataType.simpleString()
    labels = shared.sparkSession.createDataFrame([], f"node {kind}, label {kind}")
    checked = None

    def labelled(rows: DataFrame, of: str = "id", name: str = "label") -> DataFrame:
        known = labels.select(F.col("node").alias(of), F.col("label").alias(name))
        return rows.join(known, of, "left").withColumn(name, F.coalesce(name, of))

    def compare(rows: DataFrame) -> None:
        """Verify members with the hubs (hub, hub_n) of their buckets where the two may be a link."""
        nonlocal checked, labels
        may = (F.col("id") != F.col("hub")) & _may_link(F.col("n"), F.col("hub_n"), similarity)
        met = written(rows.where(may).select("id", "hub").distinct(), "met")  # written, so that a join of its own can split a hot hub
        met = labelled(labelled(met), "hub", "hub_label").where("label <> hub_label")
        larger = F.col("id") > F.col("hub")
        either = lambda x, y: F.when(larger, F.col(x)).otherwise(F.col(y))
        pairs = met.select(either("id", "hub").alias("a"), either("hub", "id").alias("b"), either("label", "hub_label").alias("label_a"), either("hub_label", "label").alias("label_b"))
        if checked is not None:
            pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        n_pairs = pairs.count()
        if not n_pairs:
            return
        found = _verify(pairs, n_pairs, texts, similarity)
        checked = found if checked is None else checked.unionByName(found)
        links = found.where("linked").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
        if links.isEmpty():
            return
        joined = connected_components(links)
        joined = joined.select(F.col("node").alias("label"), F.col("label").alias("new"))
        old = labels.join(joined, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
        fresh = joined.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("new").alias("label"))
        labels = old.unionByName(fresh)
        labels = written(labels.coalesce(1 + labels.count() // ROWS_A_TASK), "classes")

    for stage in range(len(STAGES) + 1):
        compare(shared.where(F.col("key").bitwiseAND(3) == stage))

    # An id gets its class before it is put in its buckets: most buckets are of one class by now.
    rows = labelled(shared.groupBy("id", "n").agg(F.collect_list("key").alias("keys"))).select("id", "n", "label", F.explode("keys").alias("key"))
    mixed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("least"), F.max("label").alias("most")).where("least < most and size > 2")
    members = written(rows.join(written(mixed.select("key", "size"), "mixed"), "key"), "members")
    compare(_all_pairs(members.where(F.col("size") <= FEW)))
    rest = labelled(members.where(F.col("size") > FEW).select("id", "n").distinct()).join(texts, "id")
    rest = written(rest, "rest")
    if not rest.isEmpty():
        compare(_across(rest, similarity))
    return labels


def _grams(x: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the runs of q words, one a place."""
    h = np.full(max(0, len(x) - q + 1), q, dtype=np.uint64)
    for j in range(q):
        h = _mix(h * np.uint64(0x100000001B3) + x[j : j + len(h)].view(np.uint64) + np.uint64(1))
    return h


def _bins(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts (wh) of a task have a run, by bins of the runs' hashes."""
    counts = np.zeros(1 << BIN_BITS, dtype=np.int64)
    for batch in batches:
        values, ends = _flat(batch.column("wh"))
        for i in range(batch.num_rows):
            for q in SIZES:
                counts[np.unique(_bins(_grams(values[ends[i] : ends[i + 1]], q)))] += 1
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bin", "n"])


def segments(x: np.ndarray, n_segments: int, usual: np.ndarray) -> tuple[float, int, list[int]]:
    """In how many texts so many runs of one size that do not overlap are by ``usual`` (by bin), the size and the places; of all sizes those that are in fewest."""
    best = None
    for q in SIZES:
        weights = usual[_bins(_grams(x, q))]
        free, found, total = bytearray(b"\1") * len(x), [], 0.0
        for i in np.argsort(weights, kind="stable").tolist():
            if len(found) == n_segments:
                break
            if free[i] and free[i + q - 1]:
                free[i : i + q] = bytes(q)
                found.append(i)
                total += weights[i]
        if len(found) == n_segments and (best is None or total < best[0]):
            best = (total, q, found)
    return best or (float("inf"), 1, [])


def cell_widths(similarity: float) -> list[int]:
    """Words of a cell of a text, by its band: as many as the edits of a link, about."""
    return [max(1, int((1 - similarity) * most)) for most in BANDS[1:]]


def _runs(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """All runs of a text's words: rows (seg, band, cell, id, label, n, lo, hi), one for all places from lo to hi where a cell of the text has the run."""
    widths = cell_widths(similarity)
    for batch in batches:
        values, ends = _flat(batch.column("wh"))
        of, parts, held = [], [], 0
        for i in range(batch.num_rows):
            x = values[ends[i] : ends[i + 1]]
            band = int(np.searchsorted(BANDS, len(x), side="right")) - 1
            for q in SIZES:
                h = _grams(x, q).view(np.int64)
                cells = np.arange(len(h)) // widths[band]
                order = np.lexsort((cells, h))  # stable: places ascend
                h, cells = h[order], cells[order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (cells[1:] != cells[:-1])]) if len(h) else order
                of.append(np.full(len(first), i))
                parts.append((h[first], np.full(len(first), band), cells[first], order[first], order[np.r_[first[1:], len(h)] - 1] if len(h) else order))
                held += len(first)
            if held >= CHUNK_WORDS or i + 1 == batch.num_rows:
                took = pa.array(np.concatenate(of))
                seg, *ints = (np.concatenate(c) for c in zip(*parts, strict=True))
                band, cell, lo, hi = (pa.array(c.astype(np.int32)) for c in ints)
                yield pa.RecordBatch.from_arrays([pa.array(seg), band, cell, *(batch.column(c).take(took) for c in ("id", "label", "n")), lo, hi], names=["seg", "band", "cell", "id", "label", "n", "lo", "hi"])
                of, parts, held = [], [], 0


def _chosen(batches: Iterator[pa.RecordBatch], similarity: float, usual: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (seg, id, label, n, place, least_band, band) of as many runs of a text's words as one edit more than a link has can touch, with the bands of texts that it can be linked to and that are no longer.

    Where more than ``most`` texts have those, there is one row with a place of -1.
    """
    for batch in batches:
        values, ends = _flat(batch.column("wh"))
        of, segs, places, bands, held = [], [], [], [], 0
        for i in range(batch.num_rows):
            x = values[ends[i] : ends[i + 1]]
            total, q, at = segments(x, int((1 - similarity) * len(x) + 1e-9) + 1, usual)
            if total > most:
                h, at = np.zeros(1, dtype=np.uint64), [-1]
            else:
                h = _grams(x, q)[at]
            of.append(np.full(len(h), i))
            segs.append(h.view(np.int64))
            places.append(np.array(at, dtype=np.int32))
            least = max(1, int(np.ceil((similarity - 1e-9) * len(x))))
            bands.append(np.tile(np.searchsorted(BANDS, [least, len(x)], side="right").astype(np.int32) - 1, (len(h), 1)))
            held += len(h)
            if held >= CHUNK_WORDS or i + 1 == batch.num_rows:
                took, bands = pa.array(np.concatenate(of)), np.concatenate(bands)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(segs)), *(batch.column(c).take(took) for c in ("id", "label", "n")), pa.array(np.concatenate(places)), pa.array(bands[:, 0]), pa.array(bands[:, 1])],
                    names=["seg", "id", "label", "n", "place", "least_band", "band"],
                )
                of, segs, places, bands, held = [], [], [], [], 0


def _across(rest: DataFrame, similarity: float) -> DataFrame:
    """All pairs (id, n, hub, hub_n) of texts (id, n, label, wh) of different classes that may be links: no link is left out.

    A link has d edits at most, d being what the longer text's length allows, and
    an edit touches one of several runs of words that do not overlap. Of d + 1
    such runs of the longer text one at least is in the other too, at a place
    that leaves no more than d edits for the words before it and after it: so
    runs meet only in texts of fitting length and near the place they have there
    (by bands of lengths and cells of places, which are dealt out with the runs).
    Which runs are taken changes only how many pairs come out: those that few
    classes have, as counted by bins of hashes. A text all of whose runs are so
    frequent that they would lead to more pairs than there are texts is met with
    all texts of fitting length instead (:func:`_in_blocks`).
    """
    kind = rest.schema["id"].dataType.simpleString()
    usual = np.zeros(1 << BIN_BITS, dtype=np.float32)
    source = rest.select("id", "label", "n", "wh").repartition(1 + rest.count() // TEXTS_A_TASK)  # files of texts are few
    counts = source.where("id = label").select("wh").mapInArrow(_counted, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    usual[counts["bin"].to_numpy()] = counts["n"].to_numpy()
    most = rest.count() // 4
    chosen = source.mapInArrow(lambda it: _chosen(it, similarity, usual, most), f"seg long, id {kind}, label {kind}, n int, place int, least_band int, band int")
    chosen = written(chosen.toDF("seg", "hub", "hub_label", "hub_n", "hub_place", "least_band", "most_band"), "segments")
    edits = F.floor(F.lit(1 - similarity) * F.col("hub_n") + F.lit(1e-9)).cast("int")
    hubs = chosen.where("hub_place >= 0").withColumn("edits", edits)
    runs = source.mapInArrow(lambda it: _runs(it, similarity), f"seg long, band int, cell int, id {kind}, label {kind}, n int, lo int, hi int")
    # Of a run the places are kept that are of another class than some hub with it, and of a length and at a place that suit one.
    asked = hubs.groupBy("seg").agg(
        F.min("hub_label").alias("hub_least"), F.max("hub_label").alias("hub_most"), F.min(F.col("hub_n") - F.col("edits")).alias("fewest"), F.max("hub_n").alias("longest"),
        F.min(F.col("hub_place") - F.col("edits")).alias("first"), F.max(F.col("hub_place") + F.floor(F.col("edits") / 2)).alias("last"),
    )
    suits = F.col("n").between(F.col("fewest"), F.col("longest")) & (F.col("lo") <= F.col("last")) & (F.col("hi") >= F.col("first"))
    suits &= (F.col("label") != F.col("hub_least")) | (F.col("label") != F.col("hub_most"))
    runs = written(runs.join(asked, "seg").where(suits).select(*runs.columns), "runs")

    least, most_ = F.min("label").alias("least"), F.max("label").alias("most")
    span = F.min("n").alias("n_least"), F.max("n").alias("n_most"), F.min("lo").alias("from"), F.max("hi").alias("to")
    shorter = F.greatest(F.col("hub_n") - F.col("n_most"), F.lit(0))  # by so many words at least
    fits = (F.col("n_least") <= F.col("hub_n")) & (shorter <= F.col("edits"))
    fits &= (2 * (F.col("from") - F.col("hub_place")) <= F.col("edits") - shorter) & (2 * (F.col("hub_place") - F.col("to")) <= F.col("edits") + F.least(F.col("hub_n") - F.col("n_least"), F.col("edits")))

    # Most runs are in texts of one class, or too far away: these are left before rows are made for bands and cells.
    others = (F.col("least") != F.col("hub_label")) | (F.col("most") != F.col("hub_label"))
    hubs = hubs.join(runs.groupBy("seg").agg(least, most_), "seg").where(others).drop("least", "most")
    hubs = hubs.withColumn("band", F.explode(F.sequence("least_band", "most_band")))
    hubs = hubs.join(runs.groupBy("seg", "band").agg(least, most_, *span), ["seg", "band"]).where(fits & others)
    width = F.get(F.array(*(F.lit(w) for w in cell_widths(similarity))), F.col("band"))
    cell_of = lambda place: F.floor(place / width).cast("int")
    cells = F.sequence(cell_of(F.greatest(F.col("hub_place") - F.col("edits"), F.col("from"))), cell_of(F.least(F.col("hub_place") + F.floor(F.col("edits") / 2), F.col("to"))), F.lit(1))
    hubs = hubs.select("seg", "band", "hub", "hub_label", "hub_n", "hub_place", "edits", F.explode(cells).alias("cell"))

    # Classes meet first, so that the members of one class never do.
    key = ["seg", "band", "cell"]
    across = hubs.join(runs.groupBy(*key, "label").agg(*span), key).where((F.col("label") != F.col("hub_label")) & fits)
    across = written(across.select(*key, "hub", "hub_n", "hub_place", "edits", "label"), "across")
    fewer = F.col("hub_n") - F.col("n")
    moved = F.greatest(F.col("lo") - F.col("hub_place"), F.col("hub_place") - fewer - F.col("hi"), F.lit(0))
    near = (fewer >= 0) & (fewer + 2 * moved <= F.col("edits"))
    found = across.join(runs, [*key, "label"]).where(near & _may_link(F.col("n"), F.col("hub_n"), similarity)).select("id", "n", "hub", "hub_n")
    return found.unionByName(_in_blocks(rest.join(chosen.where("hub_place < 0").select(F.col("hub").alias("id")), "id", "left_semi"), rest, similarity))


def _in_blocks(longer: DataFrame, rest: DataFrame, similarity: float) -> DataFrame:
    """Pairs (id, n, hub, hub_n) of ``longer`` (the hubs) and texts of ``rest`` no longer than they are, of other classes, that have as many words in common as a link.

    A grid of blocks: bands of lengths, and of each so many parts that a block has
    BLOCK_WORDS words, about. The work is that of all pairs, a task's memory is not.
    """
    kind = rest.schema["id"].dataType.simpleString()
    step = -np.log(max(similarity, 0.01))
    banded = lambda df: df.withColumn("band", F.floor(F.log(F.col("n")) / step + 1e-9))
    longer, shorter = banded(longer), banded(rest).withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    blocks = lambda df, name: df.groupBy("band").agg((1 + F.floor(F.sum("n") / BLOCK_WORDS)).alias(name))
    grid = written(blocks(longer, "rows").join(blocks(shorter, "columns"), "band"), "grid")
    keys = ("band", "row", "column")
    part = lambda of: F.pmod(F.xxhash64("id"), F.col(of))
    all_ = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    x = longer.join(grid, "band").select("band", part("rows").alias("row"), all_("columns").alias("column"), "id", "label", "n", "wh").toDF(*keys, "hub", "hub_label", "hub_n", "hub_wh")
    y = shorter.join(grid, "band").select("band", all_("rows").alias("row"), part("columns").alias("column"), "id", "label", "n", "wh")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        (xs, x_ends), (ys, y_ends) = (_flat(c.combine_chunks()) for c in (left["hub_wh"], right["wh"]))
        n, m = np.diff(x_ends), np.diff(y_ends)
        labels, others = left["hub_label"].to_pylist(), np.array(right["label"].to_pylist())
        bin_of = lambda values: (_mix(values.view(np.uint64)) >> np.uint64(54)).astype(np.int64)
        held = np.zeros((len(m), 1024), dtype=np.int32)
        np.add.at(held, (np.repeat(np.arange(len(m)), m), bin_of(ys)), 1)
        out_x, out_y = [], []
        for i in range(len(n)):
            x = xs[x_ends[i] : x_ends[i + 1]]
            limit = int((1 - similarity) * n[i] + 1e-9)
            at = np.flatnonzero((m <= n[i]) & (m >= n[i] - limit) & (others != labels[i]))
            own = np.bincount(bin_of(x), minlength=1024).astype(np.int32)
            at = at[np.minimum(held[at], own).sum(axis=1) >= n[i] - limit]
            for few in np.array_split(at, 1 + len(at) // 256):
                if len(few):
                    y = np.concatenate([ys[y_ends[j] : y_ends[j + 1]] for j in few])
                    same = shared_words(np.tile(x, len(few)), np.arange(len(few) + 1) * len(x), y, np.r_[0, np.cumsum(m[few])])
                    few = few[same >= n[i] - limit]
                    out_x += [i] * len(few)
                    out_y += few.tolist()
        take = lambda t, rows, c: t[c].take(pa.array(rows, pa.int64()))
        return pa.table({"id": take(right, out_y, "id"), "n": take(right, out_y, "n"), "hub": take(left, out_x, "hub"), "hub_n": take(left, out_x, "hub_n")})

    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(meet, f"id {kind}, n int, hub {kind}, hub_n int")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, k: int = K, sketches: int = SKETCHES
) -> DataFrame:
    """One row per input row: the id, class_id (smallest id of the class) and kept (whether the id is the class's)."""
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    split = docs.select("id", words(F.col("text")).alias("w")).select("id", F.md5(F.array_join("w", " ")).alias("same"), hashed("w").alias("wh"))
    rows = written(split.mapInArrow(lambda it: _sketched(it, k, sketches, similarity), f"id {id_type}, same string, n int, sketches array<long>"), "texts")
    several = rows.groupBy("id").agg(F.min("same").alias("chosen"), F.max("same").alias("other")).where("chosen <> other").select("id", "chosen")
    rows = rows.join(written(several, "several"), "id", "left").withColumn("chosen", F.coalesce("chosen", "same"))
    texts = rows.where("same = chosen")
    same = written(texts.select("id", "same").groupBy("same").agg(F.min("id").alias("rep")), "same")

    since = written_so_far()
    own = texts.where("n > 0").select("id", "n", "sketches").join(same.select(F.col("rep").alias("id")), "id", "left_semi")
    sketched = written(own.dropDuplicates(["id"]), "sketches")  # a rep may be a repeated row, alike in all of these
    keyed = sketched.select("id", F.explode("sketches").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    lengths = sketched.select("id", "n")
    hubs = hubs.join(lengths.select(F.col("id").alias("hub"), F.col("n").alias("hub_n")), "hub")
    hubs = written(hubs, "hubs")  # written, so that a join of its own can split a hot bucket
    shared = settled(keyed.join(hubs, "key").join(lengths, "id"), "shared", since)
    members = docs.join(shared.select("id").distinct(), "id", "left_semi").select("id", words(F.col("text")).alias("w"))
    members = members.select("id", F.md5(F.array_join("w", " ")).alias("same"), hashed("w").alias("wh")).groupBy("id").agg(F.min_by("wh", "same").alias("wh"))
    members = written(members, "members")
    labels = _compared(shared, members, similarity).select(F.col("node").alias("rep"), "label")
    classes = same.join(labels, "rep", "left").select("same", F.coalesce("label", "rep").alias("class_id"))
    out = rows.select("id", F.col("chosen").alias("same")).join(classes, "same").select(F.col("id").alias(id_col), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))
    unknown = df.where(F.col(id_col).isNull()).select(F.col(id_col), F.lit(None).cast(id_type).alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(unknown)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, k: int = K, sketches: int = SKETCHES) -> DataFrame:
    """The rows of ``df`` whose document stays, with all their columns."""
    gone_id = free_name(df, "gone_id")
    gone = near_duplicates(df, id_col, text_col, similarity, k, sketches).where("not kept").select(F.col(id_col).alias(gone_id)).distinct()
    return df.join(gone, F.col(id_col) == F.col(gone_id), "left_anti")
