"""N-gram Jaccard join by PartEnum signatures, and the groups its links form.

A document's set holds the 64-bit hashes of its distinct five-word shingles.  Two sets
of sizes a and b with Jaccard similarity 3/4 or more differ in at most (a + b) / 7
elements, so within a band of sizes the difference is bounded by a number k.  The
domain is cut into n1 parts of which each is cut into n2 smaller ones; by the
pigeonhole principle one part differs in at most k2 elements, so that some choice of
n2 - k2 of its smaller parts is equal in both sets.  The hash of each such choice is a
signature, and sets that link share one.

The job, none of whose steps gathers a group in one row, one task or the driver:

1. one pass over the texts: set size and digest of each document; copies become a class;
2. a pass that counts, exactly from above, how many shingles of a set (of every second
   shingle hash) occur in any other set; a set with a link has lost a quarter of them at
   most, so the others need no signatures;
3. signatures of the remaining sets, which leave out choices of frequent shingles alone
   wherever a link must show in another signature; within a signature each set is held against the
   least one only, and the links found are joined to clusters;
4. where a signature still joins sets of different clusters, all pairs across clusters
   are held against each other, since pairs inside a cluster cannot change the result.

Every pair is verified on whole sets.  Hashes have 64 bits (32 bits of a digest beside
32 more of a shingle in step 2), which is the only place where chance enters: of n distinct
sets about n^2 / 2^65 unlike pairs share a digest, 3 in a million runs at 10^7 sets, some
270 pairs at 10^11; in step 2 an equal hash can only keep a set that has no link.

Edge cases: a null or empty text, or one of blanks, has an empty set, links with nothing
and is its own component; texts of one to four words have one shingle, the whole
sequence; repeated rows and equal sets always share a component; a null doc_id never
is a component's smallest id unless all its ids are null; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import checkpoint, connected_components, shuffle_partitions
from tideline.llm.textops import Block, blocks, mix

U = np.uint64
WIDTH = 5
#: entries that a task holds before it sends them on
FLUSH = 400_000
_MANY = 0xFFFFFFFF
#: a shingle of more of the remaining sets than this counts as frequent
FREQUENT = 40
#: groups of sets up to this size give all pairs across clusters as rows; larger ones go through blocks of this many
SMALL, BLOCK = 24, 2048
#: entries of shingles, and elements of sets, that one bucket holds (about)
BUCKET = 1 << 24
#: larger groups than this many are not broadcast
BROADCAST_GROUPS = 200_000


def shingle_sets(block: Block, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after the other, offsets)."""
    words = block.word_hashes(fold_case=True)
    h, at = block.windows(words, width)
    doc = block.doc_of_word[at]
    for n in range(1, width):
        short, at = block.windows(words, n)
        whole = block.n_words[block.doc_of_word[at]] == n
        if whole.any():
            h = np.concatenate([h, mix(short[whole] ^ U(n))])
            doc = np.concatenate([doc, block.doc_of_word[at[whole]]])
            order = np.argsort(doc, kind="stable")
            h, doc = h[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(block.n + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        h[a:b].sort()
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    kept = np.concatenate([[0], np.cumsum(first)])
    return h[first], kept[bounds]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def digests(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set, the same for equal sets."""
    return mix(_sums(mix(h ^ U(0x5851F42D4C957F2D)), offsets) + np.diff(offsets).astype(np.uint64)).view(np.int64)


def _in_half(h: np.ndarray) -> np.ndarray:
    return (h & U(1)) == 0


# --- step 1: sizes and digests -------------------------------------------------


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1)):
            h, offsets = shingle_sets(block)
            half = _sums(_in_half(h).astype(np.int64), offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.first, block.n), pa.array(np.diff(offsets)), pa.array(digests(h, offsets)), pa.array(half)],
                ["doc_id", "n_shingles", "sid", "n_half"],
            )


# --- shingles that several sets share ------------------------------------------


def _spread(n_buckets: int, most: int, read, found_out):
    """Map side of a count of sets by shingle: rows (bucket, entries).

    An entry is 32 bits of a shingle beside 32 of a set's digest; 31 more bits of the
    shingle choose the bucket.  A shingle that more than ``most`` sets of the task's
    share have goes out once, marked as found in many, and ``found_out`` turns its sets
    into rows of their own: a passage in a third of all documents costs an entry for
    each share instead of one for each document.
    """

    def flush(shingles: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
        bucket = ((shingles >> U(33)) * U(n_buckets)) >> U(31)
        order = np.argsort(bucket.astype(np.uint16 if n_buckets < 65536 else np.uint32), kind="stable")
        packed = ((((shingles >> U(1)) & U(_MANY)) << U(32)) | (sets & U(_MANY)))[order]
        ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        keys, blobs, found = [], [], []
        for b, (i, j) in enumerate(zip(ends[:-1], ends[1:])):
            if i < j:
                part, many, new = _frequent(packed[i:j], most)
                found.append(part[many])
                keys.append(b)
                blobs.append(np.concatenate([part[~many], part[many & new] | U(_MANY)]).tobytes())
        for key, blob in found_out(np.concatenate(found)) if found else ():
            keys.append(-1 - key)
            blobs.append(blob.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int32()), pa.array(blobs, type=pa.binary())], ["bucket", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sets, held = [], [], 0
        for batch in batches:
            for h, owner in read(batch):
                shingles.append(h)
                sets.append(owner)
                held += len(h)
                if held >= FLUSH:
                    yield flush(np.concatenate(shingles), np.concatenate(sets))
                    shingles, sets, held = [], [], 0
        if held:
            yield flush(np.concatenate(shingles), np.concatenate(sets))

    return run


def _frequent(packed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct entries in order, whether more than ``most`` sets have the shingle, first of its shingle)."""
    part = np.unique(packed)
    new = np.ones(len(part), dtype=bool)
    new[1:] = (part[1:] >> U(32)) != (part[:-1] >> U(32))
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(part))) > most
    many |= (part[np.append(at[1:], len(part)) - 1] & U(_MANY)) == U(_MANY)  # marked by another task
    return part, many[np.cumsum(new) - 1], new


def _joined(table: pa.Table, column: str = "entries") -> np.ndarray:
    parts = [np.frombuffer(b.as_buffer(), dtype=np.uint64) for b in table.column(column).combine_chunks()]
    return np.concatenate([np.zeros(0, dtype=np.uint64), *parts])


def _read_half(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every second shingle hash of the texts of a batch, and the digests of their sets."""
    for block in blocks(batch.column(0)):
        h, offsets = shingle_sets(block)
        n = np.diff(offsets)
        use = _in_half(h) & np.repeat(n >= 3, n)
        yield h[use], np.repeat(digests(h, offsets).view(np.uint64), n)[use]


def _count_by_set(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(found & U(_MANY), return_counts=True)


def _support_out(found: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    sids, times = _count_by_set(found)
    if len(sids):
        yield int(sids[0] % U(1 << 20)), (sids << U(32)) | times.astype(np.uint64)


def _support_counts(key: tuple, table: pa.Table) -> pa.Table:
    """For each set of a bucket, how many of its shingles other sets have too."""
    entries = _joined(table)
    if key[0].as_py() < 0:
        sids, counts = entries >> U(32), entries & U(_MANY)
    else:
        part, many, _ = _frequent(entries, 1)
        sids, counts = _count_by_set(part[many & ((part & U(_MANY)) != U(_MANY))])
    return pa.table({"sid32": pa.array(sids.astype(np.int64)), "n": pa.array(counts.astype(np.int64))})


def _read_sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for sid, elements in zip(batch.column("sid").to_pylist(), batch.column("elements")):
        h = np.frombuffer(elements.as_buffer(), dtype=np.uint64)
        yield h, np.full(len(h), sid, dtype=np.int64).view(np.uint64)


def _by_set(n_buckets: int):
    """Entries, dealt by their set."""

    def out(found: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        found = found[(found & U(_MANY)) != U(_MANY)]
        to = (found & U(_MANY)) % U(n_buckets)
        for b in np.unique(to):
            yield int(b), found[to == b]

    return out


def _hot_entries(n_buckets: int, most: int):
    """The entries of frequent shingles, and how many less frequent ones of each set other sets share."""
    out = _by_set(n_buckets)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        entries, none = _joined(table), np.zeros(0, dtype=np.uint64)
        if key[0].as_py() < 0:
            rows = [(-1 - key[0].as_py(), entries, none)]
        else:
            part, many, _ = _frequent(entries, most)
            rows = [(b, e, none) for b, e in out(part[many])]
            _, shared, _ = _frequent(part[~many], 1)
            sids, times = _count_by_set(part[~many][shared])
            rows += [(b, none, e) for b, e in out((times.astype(np.uint64) << U(32)) | sids)]
        return pa.table(
            {
                "bucket": pa.array([b for b, _, _ in rows], type=pa.int32()),
                "entries": pa.array([e.tobytes() for _, e, _ in rows], type=pa.binary()),
                "shared": pa.array([e.tobytes() for _, _, e in rows], type=pa.binary()),
            }
        )

    return run


def _mark_hot(key: tuple, sets: pa.Table, hot: pa.Table) -> pa.Table:
    """Add to each set a byte for each element, 1 if it is rare; sets that share too little with the others go."""
    entries = np.unique(_joined(hot)) if hot.num_rows else np.zeros(0, dtype=np.uint64)
    shared = _joined(hot, "shared") if hot.num_rows else entries
    sids, at = np.unique(shared & U(_MANY), return_inverse=True)
    warm = dict(zip(sids.tolist(), np.bincount(at, weights=(shared >> U(32)).astype(np.float64), minlength=len(sids)).tolist()))
    sid = sets.column("sid").to_numpy()
    elements, sizes = _joined(sets, "elements"), sets.column("n").to_numpy()
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    wanted = (((elements >> U(1)) & U(_MANY)) << U(32)) | np.repeat(sid.view(np.uint64) & U(_MANY), sizes)
    place = np.searchsorted(entries, wanted)
    place[place == len(entries)] = 0
    rare = entries[place] != wanted if len(entries) else np.ones(len(wanted), dtype=bool)
    known = _sums((~rare).astype(np.int64), offsets) + np.array([warm.get(int(x) & _MANY, 0.0) for x in sid], dtype=np.float64)
    keep = np.flatnonzero(known >= sizes - sizes // 4)
    masks = [rare[offsets[i] : offsets[i + 1]].astype(np.uint8).tobytes() for i in keep]
    kept = sets.take(pa.array(keep))
    return pa.table({"sid": kept["sid"], "n": kept["n"], "elements": kept["elements"], "rare": pa.array(masks, type=pa.binary())})


# --- step 3: signatures --------------------------------------------------------


@lru_cache
def bands() -> np.ndarray:
    """The least size of each band; the largest is 4/3 of it, so links reach one band up at most."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * 4 // 3 + 1)
    return np.array(edges, dtype=np.int64)


@lru_cache(maxsize=4096)
def scheme(space: int, n2: int) -> tuple[int, int]:
    """(n1, spare) of a signature space, for n2 smaller parts of which one is left out if n2 > 1.

    Space 2b holds pairs inside band b, space 2b + 1 pairs of bands b - 1 and b.  Of the
    n1 parts ``spare`` more are made than the pigeonhole principle asks for, so that a
    set may have as many parts whose signatures do not count for it: those without any
    rare element.  With n2 = 1 there is room for 0.3 of frequent elements.
    """
    edges, b = bands(), space // 2
    top = lambda i: int(edges[i + 1]) - 1
    if space % 2:
        most, least = (top(b - 1) + top(b)) // 7, int(edges[b - 1])
    else:
        most, least = 2 * top(b) // 7, int(edges[b])
    needed = most // (2 if n2 > 1 else 1) + 1
    for n1 in range(needed, 2 * needed + 3):
        share = min(1.0, n2 * math.exp(-least * (n2 - 1) / n2 / n1)) if n2 > 1 else math.exp(-0.7 * least / n1)
        if n1 - n1 * share - 2 * math.sqrt(n1 * share * (1 - share)) >= needed:
            break
    return n1, n1 - needed


def signatures(h: np.ndarray, rare: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) for all sets.

    Inside a band, parts of three smaller parts, two of them to be equal; sets for which
    too many of those hold frequent elements only are signed again by single parts, as
    are pairs across bands.  A signature without a rare element is left out where the
    spare parts allow it: the pair's link then shows in another signature.  Frequent
    elements thus give signatures only to sets that consist mainly of them.
    """
    n = np.diff(offsets)
    band = np.searchsorted(bands(), n, side="right") - 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    everything = np.arange(len(n))
    left = _sign(h, rare, offsets, everything, 2 * band, 3, found, last=False)
    _sign(h, rare, offsets, left, 2 * band, 1, found)
    upper = everything[band > 0]
    _sign(h, rare, offsets, upper, 2 * band + 1, 1, found)  # as the larger set across bands
    _sign(h, rare, offsets, everything, 2 * band + 3, 1, found)  # as the smaller one
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _sign(h, rare, offsets, mine, spaces, n2, found, last=True) -> np.ndarray:
    """Append the signatures of the sets ``mine`` to ``found``; returns the sets with too many parts that do not count."""
    if not len(mine):
        return mine
    spaces = spaces[mine]
    kinds, which = np.unique(spaces, return_inverse=True)
    plans = np.array([scheme(int(x), n2) for x in kinds], dtype=np.int64)
    n1, spare = plans[which, 0], plans[which, 1]
    sizes = offsets[mine + 1] - offsets[mine]
    local = np.repeat(np.arange(len(mine)), sizes)
    elements = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(offsets[mine], sizes)
    x = h[elements]
    base = np.concatenate([[0], np.cumsum(n1)])
    part = base[local] + (((mix(x ^ U(0xA0761D6478BD642F)) >> U(32)) * n1[local].astype(np.uint64)) >> U(32)).astype(np.int64)
    slot = part * n2 + ((mix(x ^ U(0xE7037ED1A0B428DB)) >> U(32)) % U(n2)).astype(np.int64)
    rares = np.bincount(slot, weights=rare[elements], minlength=base[-1] * n2).reshape(-1, n2)
    value = np.zeros(base[-1] * n2, dtype=np.uint64)
    np.add.at(value, slot, mix(x ^ U(0x8EBC6AF09C88C6E3)))
    value = value.reshape(-1, n2)
    if n2 > 1:  # all but one of the smaller parts
        value = value.sum(axis=1, keepdims=True, dtype=np.uint64) - value
        rares = rares.sum(axis=1, keepdims=True) - rares
    owner = np.repeat(np.arange(len(mine)), n1)
    poor = np.bincount(owner[(rares == 0).any(axis=1)], minlength=len(mine)) > spare
    out = rares > 0
    if last:
        out |= poor[owner][:, None]
    number = (np.arange(base[-1]) - base[owner])[:, None] * 4 + np.arange(n2) + (n2 > 1)
    name = mix((spaces[owner].astype(np.uint64)[:, None] << U(40)) + number.astype(np.uint64))
    found.append((mix(value * U(0x9FB21C651E98DF25) + name)[out], np.broadcast_to(mine[owner][:, None], out.shape)[out]))
    return mine[poor]


def _survivor_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, n, elements) of texts whose digest is the wanted one, each set once a task."""
    seen: set[int] = set()
    for batch in batches:
        wanted = batch.column(0).to_numpy(zero_copy_only=False)
        for block in blocks(batch.column(1)):
            h, offsets = shingle_sets(block)
            sids = digests(h, offsets)
            ok = [i for i in range(block.n) if sids[i] == wanted[block.first + i] and not (sids[i] in seen or seen.add(int(sids[i])))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sids[ok]),
                    pa.array(np.diff(offsets)[ok]),
                    pa.array([h[offsets[i] : offsets[i + 1]].tobytes() for i in ok], type=pa.binary()),
                ],
                ["sid", "n", "elements"],
            )


def _held_sets(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """Sets in shares of about ``FLUSH / 2`` elements: other columns, elements, which are rare, offsets."""
    for batch in batches:
        lengths = batch.column("n").to_numpy()
        at = 0
        while at < len(lengths):
            to = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), FLUSH // 2, side="right")))
            part = batch.slice(at, to - at)
            h = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in part.column("elements")])
            rare = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in part.column("rare")])
            yield [part.column(c).to_numpy() for c in columns], h, rare, np.concatenate([[0], np.cumsum(lengths[at:to])])
            at = to


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, sid, n, c_sid, c_n): members of signatures.

    Members of one signature within a share are tied to the least of them here (their
    row has a key of its own), so a signature gets one open row from each share.
    """
    for (sid, n), h, rare, offsets in _held_sets(batches, ["sid", "n"]):
        sig, at = signatures(h, rare, offsets)
        order = np.lexsort((sid[at], sig))
        sig, at = sig[order], at[order]
        new = np.ones(len(sig), dtype=bool)
        new[1:] = sig[1:] != sig[:-1]
        head = at[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(sig) else at
        tied = np.unique(np.stack([head[~new], at[~new]]), axis=1)
        nulls = np.zeros(new.sum(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([sig[new].view(np.int64), (sid[tied[0]] * 31) ^ sid[tied[1]]])),
                pa.array(np.concatenate([sid[at[new]], sid[tied[1]]])),
                pa.array(np.concatenate([n[at[new]], n[tied[1]]])),
                pa.array(np.concatenate([nulls, sid[tied[0]]]), mask=np.arange(len(nulls) + tied.shape[1]) < len(nulls)),
                pa.array(np.concatenate([nulls, n[tied[0]]])),
            ],
            ["sig", "sid", "n", "c_sid", "c_n"],
        )


def alike(a: str, b: str) -> Column:
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (sid, label), h, rare, offsets in _held_sets(batches, ["sid", "label"]):
        sig, at = signatures(h, rare, offsets)
        yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(sid[at]), pa.array(label[at])], ["sig", "sid", "label"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set as parities of its elements by a hash: bitmaps differ in no more bits than the sets in elements."""
    for (sid, n, label), h, _, offsets in _held_sets(batches, ["sid", "n", "label"]):
        bits = []
        for i in range(len(sid)):
            width = max(256, 1 << int(4 * n[i] - 1).bit_length())
            odd = np.bincount((mix(h[offsets[i] : offsets[i + 1]]) % U(width)).astype(np.int64), minlength=width) & 1
            bits.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(n), pa.array(label), pa.array(bits, type=pa.binary())], ["sid", "n", "label", "bits"])


def _near_in_block(key: tuple, table: pa.Table) -> pa.Table:
    """Pairs of different clusters whose bitmaps leave a link possible."""
    low, high = key[1].as_py(), key[2].as_py()
    sid, n, label, own = (table.column(c).to_numpy() for c in ("sid", "n", "label", "own"))
    raw = table.column("bits").to_pylist()
    width = np.array([len(b) for b in raw])
    src, dst = [], []
    # Sizes of linked sets are within 4/3, so their widths are equal or one is twice the other.
    for w in np.unique(width):
        at = np.flatnonzero((width == w) | (width == 2 * w))
        maps = np.stack([np.frombuffer(raw[i][:w], dtype=np.uint64) ^ (np.frombuffer(raw[i][w:], dtype=np.uint64) if width[i] > w else U(0)) for i in at])
        for k, i in enumerate(at):
            if own[i] != low:
                continue
            ok = (own[at] == high) & (label[at] != label[i]) & (4 * np.minimum(n[at], n[i]) >= 3 * np.maximum(n[at], n[i]))
            ok &= np.minimum(width[at], width[i]) == w
            if low == high:
                ok &= sid[at] > sid[i]
            other = np.flatnonzero(ok)
            apart = np.bitwise_count(maps[other] ^ maps[k]).sum(axis=1, dtype=np.int64)
            hit = at[other[7 * apart <= n[at[other]] + n[i]]]
            src.append(np.full(len(hit), sid[i]))
            dst.append(sid[hit])
    none = np.zeros(0, dtype=np.int64)
    return pa.table({"src": pa.array(np.concatenate([none, *src])), "dst": pa.array(np.concatenate([none, *dst]))})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(2)]
        others = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(3)]
        common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(both, others)], dtype=np.int64)
        sizes = np.array([len(x) + len(y) for x, y in zip(both, others)], dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes - 2 * common), pa.array(100 * common >= 75 * (sizes - common))],
            ["src", "dst", "apart", "linked"],
        )


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (src, dst) with the size of their difference and whether they link."""
    a = sets.select(F.col("sid").alias("src"), F.col("elements").alias("x"))
    b = sets.select(F.col("sid").alias("dst"), F.col("elements").alias("y"))
    full = pairs.join(a, "src").join(b, "dst").select("src", "dst", "x", "y")
    return full.mapInArrow(_verify, "src long, dst long, apart long, linked boolean")


def linked_sets(docs: DataFrame, described: DataFrame) -> DataFrame:
    """(sid, label): label is the least digest of the cluster of each set that has a link."""
    spark = docs.sparkSession
    # Buckets are groups of one Python worker: as many as keep them within bounded bytes, whatever the number of partitions.
    entries = described.agg(F.sum("n_half")).first()[0] or 0
    buckets = max(4 * shuffle_partitions(spark), -(-entries // BUCKET))
    support = (
        docs.select("text")
        .mapInArrow(_spread(buckets, 1, _read_half, _support_out), "bucket int, entries binary")
        .groupBy("bucket")
        .applyInArrow(_support_counts, "sid32 long, n long")
        .groupBy("sid32")
        .agg(F.sum("n").alias("shared"))
    )
    classes = (
        described.where("n_shingles >= 3")
        .groupBy("sid")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("n_half").alias("n_half"))
        .withColumn("sid32", F.col("sid").bitwiseAND(F.lit(_MANY)))
    )
    alive = checkpoint(
        classes.join(support, "sid32", "left")
        .where(F.coalesce("shared", F.lit(0)) >= F.col("n_half") - F.floor(F.col("n") / 4))
        .select("sid", "rep")
    )
    texts = docs.select("doc_id", "text").join(alive.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep")))
    sets = checkpoint(texts.select("sid", "text").mapInArrow(_survivor_sets, "sid long, n long, elements binary"))
    elements = sets.agg(F.sum("n")).first()[0] or 0
    dealt = max(shuffle_partitions(spark), -(-elements // (BUCKET // 4)))
    hot = (
        sets.mapInArrow(_spread(buckets, FREQUENT, _read_sets, _by_set(dealt)), "bucket int, entries binary")
        .groupBy("bucket")
        .applyInArrow(_hot_entries(dealt, FREQUENT), "bucket int, entries binary, shared binary")
    )
    sets = checkpoint(
        sets.withColumn("bucket", F.pmod(F.col("sid").bitwiseAND(F.lit(_MANY)), F.lit(dealt)).cast("int"))
        .groupBy("bucket")
        .cogroup(hot.groupBy("bucket"))
        .applyInArrow(_mark_hot, "sid long, n long, elements binary, rare binary")
    )

    order = Window.partitionBy("sig").orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    ties = checkpoint(
        sets.mapInArrow(_stars, "sig long, sid long, n long, c_sid long, c_n long")
        .select(
            F.coalesce("c_sid", F.first("sid").over(order)).alias("src"),
            F.when(F.col("c_sid").isNotNull(), F.col("c_n")).otherwise(F.first("n").over(order)).alias("c_n"),
            F.col("sid").alias("dst"),
            "n",
        )
        .where("src <> dst")
        .groupBy("src", "dst")
        .agg(F.bool_or(alike("c_n", "n")).alias("alike"))
    )
    first = checkpoint(verified(ties.where("alike").select("src", "dst"), sets))
    links = first.where("linked").select("src", "dst")
    labels = checkpoint(connected_components(links))
    second = _across(ties, first, labels, sets)
    if second is None:
        return labels.select(F.col("node").alias("sid"), "label")
    return connected_components(links.union(second)).select(F.col("node").alias("sid"), "label")


def _across(ties: DataFrame, first: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links between different clusters that the comparison with the least sets did not show.

    Sets that share a signature with sets of another cluster meet in the group of the
    signature's least set.  Small groups give their pairs across clusters; larger ones are
    dealt into blocks whose pairs are first held against a lower bound of their
    difference, so that a large group's many distant pairs never become rows.
    """

    def label_of(name: str) -> DataFrame:
        return labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))

    named = (
        ties.join(label_of("src"), "src", "left")
        .join(label_of("dst"), "dst", "left")
        .select("src", "dst", (F.coalesce("src_label", "src") != F.coalesce("dst_label", "dst")).alias("split"))
    )
    # A tie leads from the least set of a signature to the heads of shares, or from a head to a member.
    # So the upper end of a split tie is the least set or one below it, and all members are two ties below that one at most.
    involved = checkpoint(named.where("split").select(F.col("src").alias("sid")).distinct())
    if involved.isEmpty():
        return None
    for at, to in (("dst", "src"), ("src", "dst"), ("src", "dst")):
        near = ties.join(involved.withColumnRenamed("sid", at), at, "left_semi").select(F.col(to).alias("sid"))
        involved = checkpoint(near.union(involved).distinct())
    labelled = checkpoint(
        sets.join(involved, "sid", "left_semi")
        .join(labels.withColumnRenamed("node", "sid"), "sid", "left")
        .select("sid", "n", F.coalesce("label", "sid").alias("label"), "elements", "rare")
    )
    members = labelled.mapInArrow(_members, "sig long, sid long, label long")
    mixed = members.groupBy("sig").agg(F.min("sid").alias("centre"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    groups = checkpoint(members.join(mixed.where("lo < hi").select("sig", "centre"), "sig").select("centre", "sid").distinct())
    sizes = checkpoint(groups.groupBy("centre").agg(F.count("*").alias("size")).where(F.col("size") > SMALL))
    # The larger groups are told by a broadcast of their names, so that their members stay where they are.
    large = F.broadcast(sizes) if sizes.count() <= BROADCAST_GROUPS else sizes

    few = groups.join(large.select("centre"), "centre", "left_anti").join(labelled.select("sid", "n", "label"), "sid")
    x = few.select("centre", F.col("sid").alias("src"), F.col("n").alias("a_n"), F.col("label").alias("a_label"))
    y = few.select("centre", F.col("sid").alias("dst"), F.col("n").alias("b_n"), F.col("label").alias("b_label"))
    pairs = x.join(y, "centre").where("a_label < b_label").where(alike("a_n", "b_n")).select("src", "dst")

    blocks_of = F.ceil(F.col("size") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    many = (
        groups.join(large, "centre")
        .withColumn("blocks", blocks_of)
        .select("centre", "sid", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        .join(labelled.mapInArrow(_bitmaps, "sid long, n long, label long, bits binary"), "sid")
        .groupBy("centre", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        .applyInArrow(_near_in_block, "src long, dst long")
    )
    pairs = (
        pairs.union(many)
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
        .join(first.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")), ["src", "dst"], "left_anti")
    )
    return verified(pairs, sets).where("linked").select("src", "dst")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    described = checkpoint(
        docs.select("doc_id", "text").mapInArrow(_describe, f"doc_id {kind}, n_shingles long, sid long, n_half long")
    )
    labels = checkpoint(linked_sets(docs, described))
    classes = described.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    grouped = classes.join(labels, "sid", "left")
    least = grouped.where("label IS NOT NULL").groupBy("label").agg(F.min("rep").alias("least"))
    # Only sets with copies or links need a look-up; the other documents are their own component.
    known = (
        grouped.where("label IS NOT NULL OR copies > 1")
        .join(least, "label", "left")
        .select("sid", F.coalesce("least", "rep").alias("component_id"))
    )
    rest = described.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = (
        described.where("n_shingles > 0")
        .join(known, "sid", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )
    return found.union(rest)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component.

    Of rows that repeat both id and text one is kept; ids that are unique cost no further shuffle.
    """
    key = "__id"
    while key in docs.columns:
        key += "_"
    found = components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    lead = checkpoint(found.groupBy(F.col("doc_id").alias(key)).agg((F.count("*") > 1).alias("again")))

    def rows(which: DataFrame) -> DataFrame:
        return docs.join(which.select(key).hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col(key)), "left_semi")

    repeated = lead.where("again")
    kept = rows(lead.where("NOT again"))
    return kept if repeated.isEmpty() else kept.union(rows(repeated).dropDuplicates(["doc_id", "text"]))


#: The same rows in SQL (for DuckDB): all pairs that share a shingle, and the closure of their links.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS common
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * common >= 75 * (nx + ny - common)),
reached AS (SELECT doc_id, doc_id AS r FROM sets UNION SELECT reached.doc_id, links.y FROM reached JOIN links ON links.x = reached.r)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(r) FROM reached WHERE reached.doc_id = sets.doc_id) AS component_id FROM sets
"""
