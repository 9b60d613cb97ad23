"""Near-duplicate passages across documents, by compact windows.

A document is its sequence of five-word shingles. For each of ``HASHES`` hash
functions the Cartesian tree of the shingles' hashes splits it into compact
windows (l, c, r): all passages from [l, c] to [c, r] have their least hash at
c, so the window's signature, the shingle at c, is their min-hash. Only
windows of at least ``LEAST`` shingles (50 words) are kept; their centres are
the sliding minima of that width, and each one's parents in the tree are
centres too, so the tree is built over the centres alone.

Windows of equal signature meet in one group. Groups are never paired out: a
group is ordered by the centre's wider context, and each window is linked with
the first of its context, each context with the first of the group; equal
(signature, context) rows of one block of documents are linked before the
shuffle, so a passage that a third of all documents share sends one row a
block. Texts of equal word sequence are one node.

Only nodes that share a run of 22 words with another one are split into windows.
A verified passage holds such a run: an edit costs both sides at least nine
shingles together, so 0.8 of them leave 21 successive ones (25 words) between
edits. Only edits that repeat words they stand next to cost less; a pair whose
only passages have several of those within 50 words can be missed.

Groups whose members did not all verify into one component, each within a
verified passage, go on. Their members are sorted by the text right of the centre and again by the text left of
it, by hashes of successive ``CHUNK`` shingles, and neighbours are verified: the
documents that agree furthest to that side. Members that agree on so many
shingles to one side (``LEVELS``) are sorted by the other side once more. So a
document whose passage reaches past a sentence that many others have meets the
documents that reach as far, and a group costs as many comparisons as it has
members, times a fixed number. Where the agreement of two members ends inside a
chunk, others that agree up to its beginning can lie between them; they are then
found by another hash function's centre or level, or not.

Two documents are candidates where windows of at least ``ENOUGH`` different
hash functions meet in a common passage: the windows' rectangles of starts and
ends must intersect in both documents (an interval join); for neighbours in
groups that go on one window is enough. Candidates are
verified shingle by shingle: matched runs along the windows' diagonals are
chained, and a chain of at least 50 words whose matched shingles are 0.8 of
all shingles of both sides is a passage. A passage of equal words longer than
50 has equal minima under every function in both documents.

Defined results: null, empty and short texts (under 50 words) have no passage;
equal texts of at least 50 words repeat each other whole; repetition inside one
document is not reported; repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import SHINGLE_WORDS, SIMILARITY, Words, blocks, mix, seeds, shingles, signed, stored, text_keys
from murmur.llm.minhash import components

LEAST_WORDS = 50
LEAST = LEAST_WORDS - SHINGLE_WORDS + 1
HASHES = 6
CHUNK = 6  # shingles
CHAIN = 8  # chunks to either side: 48 shingles, more than a passage of 50 words has
LEVELS = (0, 4)  # chunks of agreement on the other side
MEMBERS_HELD = 1 << 16
ENOUGH = 2
NEAR = 32
COMPARED = 1 << 16
CONTEXT = 3
MARKS = 1 << 25
SPARSE = 8  # of 18 successive shingles, two at least are successive ones of every SPARSE
GAP = 25
LEAST_RUN = 3
PRINT_WORDS = 13  # every run of PRINT_WORDS + PRINTS - 1 = 22 words has one of its prints chosen
PRINTS = 10
_U = np.uint64
_EXTENT = (1 << 18) - 1


def sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every ``width`` successive ones, by doubling."""
    low, span = values, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def compact_windows(grams: np.ndarray, offsets: np.ndarray, hashes: int = HASHES, least: int = LEAST):
    """(hash function, text, l, c, r) arrays of all compact windows of at least ``least`` shingles; r inclusive."""
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= least)
    if not len(long):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    n_starts = sizes[long] - least + 1
    starts = np.arange(n_starts.sum()) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts) + np.repeat(offsets[:-1][long], n_starts)
    text = np.repeat(long, n_starts)
    bits = _U(max(20, int(len(grams)).bit_length()))
    low = (_U(1) << bits) - _U(1)
    place = np.arange(len(grams), dtype=_U)
    out = []
    for f, (a, b) in enumerate(zip(seeds(hashes, 41), seeds(hashes, 59), strict=True)):
        value = (((grams ^ a) * b) & ~low) | place
        minima = sliding_minima(value, least)[starts]
        new = np.ones(len(minima), dtype=bool)
        new[1:] = (minima[1:] != minima[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        centre, own = (minima[at] & low).astype(np.int64), text[at]
        left, right = _tree_bounds(minima[at].tolist(), own.tolist(), centre.tolist(), offsets)
        out.append((np.full(len(at), f), own, left - offsets[own], centre - offsets[own], right - offsets[own]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _tree_bounds(values: list[int], owner: list[int], centre: list[int], offsets: np.ndarray):
    """Cartesian tree of the centres: how far each one is the least of its text, to the left and to the right."""
    n = len(values)
    left, right = [0] * n, [0] * n
    stack: list[int] = []
    text = -1
    end = 0
    for i in range(n):
        if owner[i] != text:
            for k in stack:
                right[k] = end
            stack = []
            text = owner[i]
            begin, end = int(offsets[text]), int(offsets[text + 1]) - 1
        while stack and values[stack[-1]] > values[i]:
            right[stack.pop()] = centre[i] - 1
        left[i] = centre[stack[-1]] + 1 if stack else begin
        stack.append(i)
    for k in stack:
        right[k] = end
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def pack(left: np.ndarray, centre: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A window in one long: its centre and its extents (an extent of 2^18 shingles or more is cut to that)."""
    return (centre << 36) | (np.minimum(centre - left, _EXTENT) << 18) | np.minimum(right - centre, _EXTENT)


def unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    centre = x >> 36
    return centre - ((x >> 18) & _EXTENT), centre, centre + (x & _EXTENT)


# --- verification ------------------------------------------------------------

def joined_windows(f: np.ndarray, a: np.ndarray, b: np.ndarray, owner: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Which matched windows share a passage, in both documents, with a window of another hash function and the same
    owner (pair of documents). Neighbours by centre are compared first; a window without a match among them meets all
    whose centres lie within it."""
    order = np.lexsort((a >> 36, owner))
    f, owner, sides = f[order], owner[order], [unpack(a[order]), unpack(b[order])]

    def meet(i: slice | np.ndarray, j: slice | np.ndarray) -> np.ndarray:
        on = (f[i] != f[j]) & (owner[i] == owner[j])
        for left, centre, right in sides:
            lo, hi = np.maximum(left[i], left[j]), np.minimum(right[i], right[j])
            on &= (lo <= np.minimum(centre[i], centre[j])) & (hi >= np.maximum(centre[i], centre[j])) & (hi - lo + 1 >= least)
        return on

    good = np.zeros(len(f), dtype=bool)
    for by in range(1, min(NEAR, len(f) - 1) + 1):
        on = meet(slice(None, -by), slice(by, None))
        good[:-by] |= on
        good[by:] |= on
    rest = np.flatnonzero(~good)
    base = owner.astype(np.int64) << 28
    left, centre, right = (x + base for x in sides[0])
    begin = np.searchsorted(centre, left[rest])
    n = np.searchsorted(centre, right[rest], side="right") - begin
    ends = np.cumsum(n)
    first = 0
    while first < len(rest):
        done = ends[first] - n[first]
        own = slice(first, max(first + 1, int(np.searchsorted(ends, done + COMPARED, side="right"))))
        i = np.repeat(rest[own], n[own])
        j = np.arange(len(i)) + np.repeat(begin[own] - (ends[own] - n[own] - done), n[own])
        within = (sides[1][0][i] <= sides[1][1][j]) & (sides[1][1][j] <= sides[1][2][i])
        i, j = i[within], j[within]
        good[i[meet(i, j)]] = True
        first = own.stop
    out = np.empty(len(f), dtype=bool)
    out[order] = good
    return out


def repeated_passages(x: np.ndarray, y: np.ndarray, diagonals: np.ndarray, least: int = LEAST,
                      similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """Chains of matched shingle runs along the diagonals: (a begin, a end, b begin, b end, similarity), in shingles."""
    runs = []
    for d in np.unique(diagonals).tolist():
        lo, hi = max(0, -d), min(len(x), len(y) - d)
        if hi <= lo:
            continue
        same = np.concatenate(([False], x[lo:hi] == y[lo + d:hi + d], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        runs += [(int(e - s), lo + int(s), int(d)) for s, e in zip(edge[0::2], edge[1::2], strict=True) if e - s >= LEAST_RUN]
    runs.sort(key=lambda r: (-r[0], r[1], r[2]))
    taken = np.zeros(len(x), dtype=bool)
    chosen = []
    for size, begin, d in runs:
        free = np.flatnonzero(~taken[begin:begin + size])
        if len(free) < LEAST_RUN:
            continue
        s, e = begin + int(free[0]), begin + int(free[-1]) + 1
        if e - s != len(free):
            continue
        taken[s:e] = True
        chosen.append((s, e, d))
    chosen.sort()
    chains: list[list[tuple[int, int, int]]] = []
    for s, e, d in chosen:
        if chains:
            ps, pe, pd_ = chains[-1][-1]
            if s - pe <= GAP and 0 <= (s + d) - (pe + pd_) <= GAP:
                chains[-1].append((s, e, d))
                continue
        chains.append([(s, e, d)])
    out = []
    for chain in chains:
        i, j = 0, len(chain)
        while i < j:
            matched = sum(e - s for s, e, _ in chain[i:j])
            a0, a1, b0, b1 = chain[i][0], chain[j - 1][1], chain[i][0] + chain[i][2], chain[j - 1][1] + chain[j - 1][2]
            share = matched / ((a1 - a0) + (b1 - b0) - matched)
            if share >= similarity:
                if min(a1 - a0, b1 - b0) >= least:
                    out.append((a0, a1, b0, b1, share))
                break
            if chain[i][1] - chain[i][0] <= chain[j - 1][1] - chain[j - 1][0]:
                i += 1
            else:
                j -= 1
    return out


# --- Spark -------------------------------------------------------------------

_WINDOW = "sig long, context long, node long, place long"


def _texts(docs: DataFrame, key_col: str, text_col: str) -> DataFrame:
    rows = docs.select(docs[f"`{key_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    return rows.filter("text IS NOT NULL").withColumn("raw", F.xxhash64("text"))


def _prints(words: Words, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prints of all texts, each text's start): the least hash of every ``PRINTS`` successive runs of ``PRINT_WORDS``
    words. Of a block's equal prints one goes on; each other node meets its neighbour under a print of its own."""
    grams, offsets = shingles(words)
    n, step, wide = len(node), SHINGLE_WORDS - 1, PRINT_WORDS - SHINGLE_WORDS
    if len(grams) < wide + PRINTS:
        return np.empty(0, np.int64), np.zeros(n + 1, np.int64)
    run = grams[:len(grams) - wide]
    for at in range(step, wide + 1, step):
        run = mix(run * _U(0x9E3779B97F4A7C15) + grams[at:len(grams) - wide + at])
    least = sliding_minima(run, PRINTS)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    first, last = owner[:len(least)], owner[len(grams) - len(least):]
    on = (first == last) & (words.counts()[first] >= LEAST_WORDS)
    on[1:] &= (least[1:] != least[:-1]) | (first[1:] != first[:-1])
    value, own = least[on], first[on]
    order = np.lexsort((node[own], value))
    value, own = value[order], own[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (node[own[1:]] != node[own[:-1]])
    value, own = value[new], own[new]
    more = np.flatnonzero(value[1:] == value[:-1]) + 1
    one = np.setdiff1d(np.arange(len(value)), more, assume_unique=True)
    private = mix(value[more] ^ mix(node[own[more]].view(_U)))
    holder = np.concatenate((own[one], own[more], own[more - 1]))
    order = np.argsort(holder, kind="stable")
    return signed(np.concatenate((value[one], private, private))[order]), np.searchsorted(holder[order], np.arange(n + 1))


def document_nodes(docs: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(doc_id, raw hash of the text, node, number of words, prints) of every document with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for x, y in blocks(texts):
                words = Words(texts[x:y])
                node = signed(text_keys(words))
                prints, starts = _prints(words, node)
                own = [*(batch.column(c).slice(x, y - x) for c in ("doc_id", "raw")), pa.array(node), pa.array(words.counts()),
                       pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(prints))]
                yield pa.RecordBatch.from_arrays(own, names=["doc_id", "raw", "node", "words", "prints"]).filter(pa.array(words.counts() > 0))
    return _texts(docs, key_col, text_col).mapInArrow(run, "doc_id long, raw long, node long, words long, prints array<long>")


def window_rows(texts: DataFrame) -> DataFrame:
    """All compact windows of all texts (node, text): signature (its last 3 bits tell the hash function, the bit before
    them whether it is a block's own and the context holds the common one), context, node, place."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, nodes = batch["text"].tolist(), batch["node"].to_numpy()
            for x, y in blocks(texts):
                own = nodes[x:y]
                _, first = np.unique(own, return_index=True)
                once = np.zeros(len(own), dtype=bool)
                once[first] = True
                grams, offsets = shingles(Words(texts[x:y]))
                f, text, left, centre, right = compact_windows(grams, offsets)
                keep = once[text]
                f, text, left, centre, right = (v[keep] for v in (f, text, left, centre, right))
                at, begin, end = offsets[text] + centre, offsets[text], offsets[text + 1] - 1
                sig = signed((mix(grams[at]) & ~_U(15)) | f.astype(_U))
                context = signed(mix(grams[np.maximum(at - CONTEXT, begin)] * _U(3) + grams[np.minimum(at + CONTEXT, end)]))
                yield _linked_in_block(sig, context, own[text], pack(left, centre, right))
    return texts.mapInPandas(run, _WINDOW)


def _linked_in_block(sig, context, node, place) -> pd.DataFrame:
    """Of the block's equal (signature, context) rows the one of the least node goes on; each other row forms a
    group of two with it, under a signature of its own."""
    order = np.lexsort((place, node, context, sig))
    sig, context, node, place = sig[order], context[order], node[order], place[order]
    new = np.ones(len(sig), dtype=bool)
    new[1:] = (sig[1:] != sig[:-1]) | (context[1:] != context[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0)) if len(sig) else np.empty(0, np.int64)
    more = np.flatnonzero(~new & (node != node[first]))
    f = sig[more].astype(np.int64).view(_U) & _U(7)
    private = signed((mix(sig[more].view(_U) ^ mix(node[more].view(_U) + place[more].view(_U))) & ~_U(15)) | _U(8) | f)
    one = np.flatnonzero(new)
    return pd.DataFrame({"sig": np.concatenate((sig[one], private, private)),
                         "context": np.concatenate((context[one], sig[more], sig[more])),
                         "node": np.concatenate((node[one], node[first[more]], node[more])),
                         "place": np.concatenate((place[one], place[first[more]], place[more]))})


_MATCH = "a long, b long, f int, at_a long, at_b long, root long"


def matched_windows(windows: DataFrame) -> DataFrame:
    """(a, b, hash function, places, common signature): each window of a group with the first of its context, each context with the
    first of its group. Reads the sorted rows as a stream and keeps two rows of it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = np.empty((4, 0), dtype=np.int64)
        for batch in batches:
            rows = np.concatenate((carry, batch[["sig", "context", "node", "place"]].to_numpy(np.int64).T), axis=1)
            if not rows.shape[1]:
                continue
            sig, context, node, place = rows
            index = np.arange(len(sig))
            new_sig = np.concatenate(([True], sig[1:] != sig[:-1]))
            new = new_sig | np.concatenate(([True], context[1:] != context[:-1]))
            group = np.maximum.accumulate(np.where(new_sig, index, 0))
            inner = np.maximum.accumulate(np.where(new, index, 0))
            to = np.where(new, group, inner)
            hit = np.flatnonzero(~new_sig & (node != node[to]))
            if len(hit):
                swap = node[hit] < node[to[hit]]
                a, b = np.where(swap, hit, to[hit]), np.where(swap, to[hit], hit)
                yield pd.DataFrame({"a": node[a], "b": node[b], "f": (sig[hit] & 7).astype(np.int32),
                                    "at_a": place[a], "at_b": place[b], "root": np.where(sig[hit] & 8, context[hit], sig[hit])})
            last = [group[-1]] if group[-1] == inner[-1] else [group[-1], inner[-1]]
            carry = rows[:, last]
    n = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (windows.repartition(n, "sig").sortWithinPartitions("sig", "context", "node", "place").mapInPandas(run, _MATCH))


def _node_texts(docs: DataFrame, wanted: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(node, text) of one document (and rows equal to it) of each wanted node. A bit set of ``MARKS`` bits, marked by the
    wanted texts' hashes, is broadcast, so that few other texts are moved for the join."""
    word = F.shiftright("raw", 6).bitwiseAND(F.lit(MARKS // 64 - 1))
    marks = wanted.select("first.raw").groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(raw & 63))")).alias("marks"))
    rows = _texts(docs, key_col, text_col).withColumn("word", word).join(F.broadcast(marks), "word")
    rows = rows.filter(F.expr("shiftright(marks, int(raw & 63)) & 1 = 1")).select("doc_id", "text", "raw")
    w = wanted.select(F.col("first.doc_id").alias("w_id"), F.col("first.raw").alias("w_raw"), "node").hint("shuffle_hash")
    return rows.join(w, rows["doc_id"].eqNullSafe(w["w_id"]) & (rows["raw"] == w["w_raw"])).select("node", "text")


def _shingle_table(texts: DataFrame) -> DataFrame:
    """(node, grams, sparse): the shingles of each node, 16 bits each, and every ``SPARSE``-th of them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for x, y in blocks(texts):
                grams, offsets = shingles(Words(texts[x:y]))
                short = (grams >> _U(48)).astype(np.uint16)
                own = [short[offsets[i]:offsets[i + 1]] for i in range(y - x)]
                yield pd.DataFrame({"node": batch["node"].iloc[x:y], "grams": [g.tobytes() for g in own], "sparse": [g[::SPARSE].tobytes() for g in own]})
    return texts.mapInPandas(run, "node long, grams binary, sparse binary").dropDuplicates(["node"])


_PASSAGE = "a long, b long, a_first int, a_end int, b_first int, b_end int, similarity double"


def _passages(pairs: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """The passages of pairs (a, b, windows, x, y), x and y being their shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch.column("windows")
            owner, flat = pc.list_parent_indices(windows).to_numpy().astype(np.int64), windows.flatten()
            f, a, b = (flat.field(c).to_numpy() for c in ("f", "at_a", "at_b"))
            diagonal = (b >> 36) - (a >> 36)
            if enough > 1:
                good = joined_windows(f, a, b, owner)
                owner, diagonal = owner[good], diagonal[good]
            starts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            at, found = [], []
            for i in np.flatnonzero(np.diff(starts)).tolist():
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint16) for c in "xy")
                own = repeated_passages(x, y, diagonal[starts[i]:starts[i + 1]])
                at += [i] * len(own)
                found += own
            if found:
                more = SHINGLE_WORDS - 1
                s, e, u, v, z = (np.array(c) for c in zip(*found, strict=True))
                pair = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pair) for c in "ab"), *(pa.array(c, pa.int32()) for c in (s, e + more, u, v + more)),
                                                  pa.array(z)], names=["a", "b", "a_first", "a_end", "b_first", "b_end", "similarity"])
    return pairs.select("a", "b", "windows", "x", "y").mapInArrow(run, _PASSAGE)


def context_chains(grams: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(right, left): hashes of the successive chunks of shingles after and before each centre, 0 past the text."""
    place = np.arange(1, CHAIN + 1) * CHUNK
    padded = np.concatenate((np.zeros(CHUNK * CHAIN, np.uint64), grams.astype(np.uint64) + 1, np.zeros(CHUNK * (CHAIN + 1), np.uint64)))
    inside = np.concatenate((np.zeros(CHUNK * CHAIN, bool), np.ones(len(grams), bool), np.zeros(CHUNK * (CHAIN + 1), bool)))
    n = len(padded) - CHUNK + 1
    chunk, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(CHUNK):
        chunk = mix(chunk * _U(0x9E3779B97F4A7C15) + padded[j:n + j])
        whole &= inside[j:n + j]
    chunk = np.where(whole, (chunk >> _U(32)) | _U(1), _U(0)).astype(np.uint32)
    at = centres + CHUNK * CHAIN
    return chunk[at[:, None] + 1 + place[None, :] - CHUNK], chunk[at[:, None] - place[None, :]]


_PLACED = "key long, chain binary, f int, node long, place long, label long, covered boolean"


def _placed_rows(held: list[tuple]) -> pd.DataFrame:
    key, chain, f, node, place, label, covered = (np.concatenate(x) for x in zip(*held, strict=True))
    raw, width = chain.tobytes(), 4 * chain.shape[1]
    return pd.DataFrame({"key": key, "chain": [raw[i:i + width] for i in range(0, len(raw), width)], "f": f, "node": node, "place": place,
                         "label": label, "covered": covered})


def _in_context(members: DataFrame, grams: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """Each member once for either side as its order, and for each level (in chunks) once more among the members that
    agree on so much of the other side; level 0 asks for nothing."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, n = [], 0
            for node, label, members, grams in zip(*(batch[c] for c in ("node", "label", "own", "grams")), strict=True):
                root, place = (np.array([m[c] for m in members], dtype=np.int64) for c in ("root", "place"))
                covered = np.array([m["covered"] for m in members], dtype=bool)
                chains = context_chains(np.frombuffer(grams, np.uint16), place >> 36)
                for side in (0, 1):
                    order, other = chains[side].astype(">u4"), chains[1 - side]
                    for level in levels:
                        on = np.flatnonzero(other[:, level - 1] > 0) if level else np.arange(len(order))
                        key = root[on].view(_U) * _U(4) + _U(2 * (level > 0) + side)
                        for k in range(level):
                            key = mix(key * _U(0x9E3779B97F4A7C15) + other[on, k])
                        held.append((signed(mix(key)), order[on], (root[on] & 7).astype(np.int32), np.full(len(on), node, np.int64), place[on],
                                     np.full(len(on), label, np.int64), covered[on]))
                        n += len(on)
                if n >= MEMBERS_HELD:
                    yield _placed_rows(held)
                    held, n = [], 0
            if held:
                yield _placed_rows(held)
    own = members.groupBy("node").agg(F.min("label").alias("label"), F.collect_list(F.struct("root", "place", "covered")).alias("own"))
    return own.join(grams.select("node", "grams"), "node").mapInPandas(run, _PLACED)


def _neighbours(placed: DataFrame) -> DataFrame:
    """(a, b, w): neighbours in the order of a key's chains, but those that one component's passages cover already.
    Reads the sorted rows as a stream and keeps one of it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            rows = batch if last is None else pd.concat([last, batch], ignore_index=True)
            if len(rows):
                last = rows.iloc[-1:]
                key, node, place, label, covered, f = (rows[c].to_numpy() for c in ("key", "node", "place", "label", "covered", "f"))
                at = np.flatnonzero((key[1:] == key[:-1]) & (node[1:] != node[:-1])
                                    & ~((label[1:] == label[:-1]) & covered[1:].astype(bool) & covered[:-1].astype(bool)))
                swap = node[at] > node[at + 1]
                a, b = np.where(swap, at + 1, at), np.where(swap, at, at + 1)
                yield pd.DataFrame({"a": node[a], "b": node[b], "f": f[at].astype(np.int32), "at_a": place[a], "at_b": place[b]})
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = (placed.repartition(n, "key").sortWithinPartitions("key", "chain", "node", "place")
             .mapInPandas(run, "a long, b long, f int, at_a long, at_b long"))
    return pairs.groupBy("a", "b").agg(F.collect_set(F.struct("f", "at_a", "at_b")).alias("windows"))


def run_nodes(rows: DataFrame) -> DataFrame:
    """(node): the nodes that share a run of 22 words with another one, by the least print of every ``PRINTS``."""
    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = np.empty((2, 0), dtype=np.int64)
        for batch in batches:
            value, node = rows = np.concatenate((carry, batch[["print", "node"]].to_numpy(np.int64).T), axis=1)
            at = np.flatnonzero((value[1:] == value[:-1]) & (node[1:] != node[:-1]))
            yield pd.DataFrame({"node": np.unique(np.concatenate((node[at], node[at + 1])))})
            carry = rows[:, -1:]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = rows.select(F.explode("prints").alias("print"), "node")
    return prints.repartition(n, "print").sortWithinPartitions("print", "node").mapInPandas(met, "node long").distinct()


def _unsettled(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members, with label and whether a verified passage covers them, of the groups that are not one component
    with all members covered."""
    sides = [found.select(F.col(x).alias("node"), F.struct(F.col(f"{x}_first").alias("first"), F.col(f"{x}_end").alias("end")).alias("s")) for x in "ab"]
    spans = sides[0].unionByName(sides[1]).groupBy("node").agg(F.collect_set("s").alias("spans"))
    labels = components(found.select("a", "b").distinct())
    centre = F.shiftright("place", 36)
    covered = F.exists("spans", lambda s: (s["first"] <= centre) & (centre < s["end"] - (SHINGLE_WORDS - 1)))
    own = members.join(spans.join(labels, "node"), "node", "left").select(
        "root", "node", "place", F.coalesce("label", "node").alias("label"), F.coalesce(covered, F.lit(False)).alias("covered"))
    roots = (own.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("n0"), F.max("node").alias("n1"), F.min("label").alias("l0"),
                                     F.max("label").alias("l1"), F.min("covered").alias("all"))
             .filter("n0 < n1 AND (l0 < l1 OR NOT all)").select("root", "n"))
    return own.join(roots, "root")


def shares_run(sparse: np.ndarray, grams: np.ndarray, diagonals: np.ndarray) -> bool:
    """Whether two successive shingles of ``sparse`` stand in ``grams`` along one of the diagonals, as of each run of 18."""
    for d in np.unique(diagonals).tolist():
        first = max(0, -(d // SPARSE))
        other = grams[first * SPARSE + d::SPARSE]
        own = sparse[first:first + len(other)]
        same = own == other[:len(own)]
        if (same[1:] & same[:-1]).any():
            return True
    return False


def _sifted(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """The pairs (a, b, windows, short, long) that share a run along a window's diagonal."""
    columns = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch.column("windows")
            owner, flat = pc.list_parent_indices(windows).to_numpy(), windows.flatten()
            a, b = (flat.field(c).to_numpy() >> 36 for c in ("at_a", "at_b"))
            first = (batch.column("a").to_numpy() == batch.column("short").to_numpy())[owner]
            diagonal = np.where(first, b - a, a - b)
            starts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            on = [shares_run(*(np.frombuffer(batch.column(c)[i].as_buffer(), np.uint16) for c in ("sparse", "grams")), diagonal[starts[i]:starts[i + 1]])
                  for i in range(batch.num_rows)]
            yield batch.select(columns).filter(pa.array(on, pa.bool_()))
    both = pairs.join(grams.select(F.col("node").alias("short"), "sparse"), "short").join(grams.select(F.col("node").alias("long"), "grams"), "long")
    return both.select(*columns, "sparse", "grams").mapInArrow(run, pairs.schema)


def _verified(pairs: DataFrame, grams: DataFrame, enough: int) -> DataFrame:
    """The passages of pairs, stored. A pair brings the shingles of its shorter text to those of the longer one; where one
    window is enough to be a pair, a few of its shingles are brought first."""
    size = grams.select("node", F.length("sparse").alias("n"))
    own = pairs.join(size.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    swap = F.col("nb") > F.col("na")
    own = own.select("a", "b", "windows", F.when(swap, F.col("a")).otherwise(F.col("b")).alias("short"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("long"))
    own = _sifted(own, grams) if enough == 1 else own
    x = grams.select(F.col("node").alias("long"), F.col("grams").alias("gl"))
    y = grams.select(F.col("node").alias("short"), F.col("grams").alias("gs"))
    both = own.join(y, "short").join(x, "long")
    first = F.col("a") == F.col("long")
    both = both.select("a", "b", "windows", F.when(first, F.col("gl")).otherwise(F.col("gs")).alias("x"), F.when(first, F.col("gs")).otherwise(F.col("gl")).alias("y"))
    return stored(_passages(both, enough), "passages")


def _gone_on(found: DataFrame, matches: DataFrame, grams: DataFrame) -> DataFrame:
    """``found`` with the passages of neighbours in the groups that are not settled by it."""
    sides = [matches.select("root", F.col(x).alias("node"), F.col(f"at_{x}").alias("place")) for x in "ab"]
    members = stored(sides[0].unionByName(sides[1]).distinct(), "members")
    members = stored(_unsettled(members, found).drop("n"), "open")
    if not members.limit(1).count():
        return found
    pairs = stored(_neighbours(_in_context(members, grams, LEVELS)), "pairs")
    return stored(found.unionByName(_verified(pairs, grams, 1)).distinct(), "passages")


def passage_links(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their node, nodes, verified passages between nodes)."""
    rows = stored(document_nodes(docs, key_col, text_col), "nodes-of-documents")
    nodes = stored(rows.groupBy("node").agg(F.min(F.struct("doc_id", "raw")).alias("first"), F.min("doc_id").alias("least"),
                                            F.count(F.lit(1)).alias("copies"), F.max("words").alias("words")), "nodes")
    alike = stored(run_nodes(rows), "alike")
    texts = stored(_node_texts(docs, nodes.join(alike, "node", "left_semi"), key_col, text_col), "texts")
    grams = stored(_shingle_table(texts), "grams")
    matches = stored(matched_windows(window_rows(texts)), "matches")
    pairs = (matches.groupBy("a", "b").agg(F.collect_set(F.struct("f", "at_a", "at_b")).alias("windows"))
             .filter(F.size(F.array_distinct(F.col("windows.f"))) >= ENOUGH))
    found = _verified(stored(pairs, "pairs"), grams, ENOUGH)
    return rows, nodes, _gone_on(found, matches, grams)


def _merged(spans: Column) -> Column:
    """Overlapping spans of a sorted array joined."""
    empty = F.array().cast("array<struct<first_word: int, end_word: int>>")

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.concat(F.slice(done, F.lit(1), F.size(done) - 1),
                         F.array(F.struct(last["first_word"].alias("first_word"),
                                          F.greatest(last["end_word"], span["end_word"]).alias("end_word"))))
        return F.when((F.size(done) > 0) & (span["first_word"] <= F.try_element_at(done, F.lit(-1))["end_word"]), wider).otherwise(
            F.concat(done, F.array(span)))
    return F.aggregate(spans, empty, add)


def repeated(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that shares a passage with another document: (doc_id, class_id, verified_links, spans, words).

    ``class_id`` is the least doc_id among the documents connected by shared passages, ``verified_links`` the number of
    other texts with which a shared passage was verified (enough to connect the class, not all that share one), ``spans``
    the shared word ranges, ``words`` their sum.
    """
    rows, nodes, found = passage_links(docs, key_col, text_col)
    a = found.select(F.col("a").alias("node"), F.col("b").alias("other"), F.col("a_first").alias("first_word"), F.col("a_end").alias("end_word"))
    b = found.select(F.col("b").alias("node"), F.col("a").alias("other"), F.col("b_first").alias("first_word"), F.col("b_end").alias("end_word"))
    whole = nodes.filter(f"copies > 1 AND words >= {LEAST_WORDS}").select(
        "node", F.lit(None).cast("long").alias("other"), F.lit(0).alias("first_word"), F.col("words").cast("int").alias("end_word"))
    spans = a.unionByName(b).unionByName(whole)
    per_node = spans.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("first_word", "end_word"))).alias("all"),
                                         F.count_distinct("other").alias("verified_links"))
    labels = components(found.select("a", "b").distinct())
    per_node = (per_node.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
                .join(nodes.select("node", "least"), "node"))
    least = per_node.groupBy("label").agg(F.min("least").alias("class_id"))
    per_node = per_node.join(least, "label").select("node", "class_id", "verified_links", _merged(F.col("all")).alias("spans"))
    words = F.aggregate(F.transform("spans", lambda s: (s["end_word"] - s["first_word"]).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return rows.select("doc_id", "node").join(per_node, "node").select("doc_id", "class_id", "verified_links", "spans", words.alias("words"))
