"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenised in one pass.  A document longer than a sequence is cut into full
pieces from its end, so only its first piece can be shorter; full pieces are sequences of
their own, and at most one piece of each document is left to pack.  Those pieces are
dealt into blocks of about ``block`` pieces by a hash of what they are.  A block's packing
is sought on several islands, each a task of its own with a population of packings:
crossover injects whole well-filled bins of one parent into the other, dissolves the bins
that now hold a document twice and some of the poor ones, and puts the displaced documents
back by best fit, where one or two of them that fill a bin best go in together.  After
each epoch the best packing of an island moves to the next island of its block.  Bins that
the best packing of a block leaves with room are dissolved, and their pieces go through a
second, coarser deal, so that blocks do not each end in a poor bin.

The packing depends on the rows alone, not on how the table is laid out in files: pieces
are ordered by id, place and checksum, and rows that repeat are numbered.

Edge cases: a null or empty text is one piece that holds the end token alone; repeated
rows are packed each; a null id is an id like others; an empty table gives an empty
result; a text of any length is tokenised whole, its pieces are rows; columns beside
doc_id and text are not read.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import checkpoint, shuffle_partitions

CAPACITY = 1024
END_TOKEN = 2
BLOCK = 4096
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 12
POPULATION = 5
#: generations without a better packing after which an epoch ends early
PATIENCE = 4
#: bytes of words and ids that a task remembers, and the longest word (in characters) it does
MEMORY, LONGEST = 32 << 20, 48
#: bytes that one remembered word takes beside its own
OVERHEAD = 150

_tokenizers: dict = {}


class WordCache:
    """Token ids, as little-endian bytes, of texts by a byte-level tokenizer.

    The strings of added tokens are cut out first, as the tokenizer does, and give their
    ids.  What lies between is cut before each blank that follows a character that is no
    white space, since such a tokenizer never joins that blank to what stands before it.
    What words give is remembered up to ``MEMORY`` bytes.  With ``ranks_path`` the words
    themselves go through the merge ranks of the same vocabulary.
    """

    def __init__(self, path: str, ranks_path: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {}
        self.held = 0
        self.tokenizer = Tokenizer.from_file(path)
        self.ranks = _ranks(ranks_path) if ranks_path else None
        added = self.tokenizer.get_added_tokens_decoder()
        # Tokens that take blanks with them or need word ends around them are left to the tokenizer.
        self.plain_added = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.added = {t.content: i.to_bytes(4, "little") for i, t in added.items()}
        names = sorted(self.added, key=len, reverse=True)
        self.at_added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def by_tokenizer(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _plain(self, texts: list[str]) -> list[bytes]:
        if self.ranks is not None:
            return [_little_endian(self.ranks.encode_ordinary(t)) for t in texts]
        return self.by_tokenizer(texts)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.plain_added:
            return self.by_tokenizer(texts)
        if self.at_added is None or not any(self.at_added.search(t) for t in texts):
            return self._ordinary(texts)
        cut = [self.at_added.split(t) for t in texts]  # ordinary text and added tokens in turn
        between = iter(self._ordinary([part for parts in cut for part in parts[::2]]))
        return [b"".join(self.added[part] if i % 2 else next(between) for i, part in enumerate(parts)) for parts in cut]

    def _ordinary(self, texts: list[str]) -> list[bytes]:
        cut = [_words(t) for t in texts]
        # What is remembered are words with the blank before them; a text's first word has none.
        heads = self._plain([words[0] for words in cut])
        known = self.known
        missing = list(set().union(*(words[1:] for words in cut)).difference(known))
        found = self._plain([" " + w for w in missing])
        known.update(zip(missing, found))
        out = [head + b"".join(map(known.__getitem__, words[1:])) for head, words in zip(heads, cut)]
        # Once full, the memory keeps what came first: frequent words come early.
        for w, ids in zip(missing, found):
            size = OVERHEAD + len(w) + len(ids)
            if len(w) > LONGEST or self.held + size > MEMORY:
                del known[w]
            else:
                self.held += size
        return out


def _little_endian(ids: list[int]) -> bytes:
    raw = array("I", ids)
    if sys.byteorder == "big":
        raw.byteswap()
    return raw.tobytes()


#: white space before a blank: the text must not be cut there
_SPACE_BEFORE_BLANK = re.compile(r"\s ")


def _words(text: str) -> list[str]:
    """``text`` cut before blanks; the blanks at the cuts are left out."""
    words = text.split(" ")
    if text[:1] != " " and not _SPACE_BEFORE_BLANK.search(text):
        return words
    whole = [words[0]]
    for w in words[1:]:
        if not whole[-1] or whole[-1][-1].isspace():
            whole[-1] += " " + w
        else:
            whole.append(w)
    return whole


def _ranks(path: str):
    """The same vocabulary as merge ranks, which give the same ids of ordinary text several times faster."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _shares(batch: pa.RecordBatch, rows: int = 256, characters: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of parts of a batch of at most so many rows and about so many characters."""
    at, held, texts = 0, 0, []
    for i, text in enumerate(batch.column(1)):
        texts.append(text.as_py() or "")
        held += len(texts[-1])
        if len(texts) == rows or held >= characters:
            yield at, texts
            at, held, texts = i + 1, 0, []
    if texts:
        yield at, texts


def _pieces(path: str, ranks_path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = WordCache(path, ranks_path)
        cache = _tokenizers[path]
        for batch in batches:
            for at, texts in _shares(batch):
                rows: list[list] = [[], [], [], [], []]
                for i, ids in enumerate(cache.encode(texts)):
                    ids += END_TOKEN.to_bytes(4, "little")
                    n = len(ids) // 4
                    start, piece = 0, 0
                    while start < n:
                        length = (n - start - 1) % capacity + 1 if piece == 0 else capacity
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        for column, value in zip(rows, (at + i, piece, start, length, crc)):
                            column.append(value)
                        start, piece = start + length, piece + 1
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[0])), *(pa.array(c, type=k) for c, k in zip(rows[1:], kinds))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        _pieces(path, ranks_path, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


# --- the grouping genetic algorithm --------------------------------------------


class Packing:
    """Bins of pieces; ``bin_of`` gives each piece's bin and ``fill`` each bin's tokens."""

    __slots__ = ("bin_of", "fill")

    def __init__(self, bin_of: np.ndarray, fill: np.ndarray) -> None:
        self.bin_of, self.fill = bin_of, fill

    def cost(self, capacity: int) -> tuple[int, float]:
        """Bins used, then how unevenly they are filled (full bins beside empty ones are better)."""
        used = self.fill[self.fill > 0]
        return len(used), -float(((used / capacity) ** 2).sum())


def best_fit(order: np.ndarray, sizes: np.ndarray, bin_of: np.ndarray, fill: np.ndarray, capacity: int) -> Packing:
    """Put the pieces ``order`` one by one into the fullest bin that has room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    have = 0  # bit r is set if a bin has exactly r tokens of room
    fills = fill.tolist()
    for b, f in enumerate(fills):
        if f < capacity:
            room[capacity - f].append(b)
            have |= 1 << (capacity - f)
    sized = sizes[order].tolist()
    for i, size in zip(order.tolist(), sized):
        fits = have >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                have &= ~(1 << r)
        else:
            r, b = capacity, len(fills)
            fills.append(0)
        fills[b] += size
        bin_of[i] = b
        left = r - size
        if left:
            room[left].append(b)
            have |= 1 << left
    return Packing(bin_of, np.array(fills, dtype=np.int64))


class _Loose:
    """Pieces without a bin, by size; ``have`` has bit s set if there is one of size s."""

    def __init__(self, order: np.ndarray, sizes: np.ndarray, capacity: int) -> None:
        self.of_size: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i, s in zip(order[::-1].tolist(), sizes[order][::-1].tolist()):
            self.of_size[s].append(i)  # the end of a list is what comes first in ``order``
        self.have = sum(1 << s for s, held in enumerate(self.of_size) if held)

    def take(self, size: int) -> int:
        i = self.of_size[size].pop()
        if not self.of_size[size]:
            self.have ^= 1 << size
        return i

    def largest(self, limit: int) -> int:
        """The largest size up to ``limit``; not positive if there is none."""
        return (self.have & ((1 << (limit + 1)) - 1)).bit_length() - 1

    def filling(self, room: int) -> tuple[int, ...]:
        """The sizes of the piece, or the two pieces, that leave the least of ``room``."""
        best = self.largest(room)
        if best <= 0:
            return ()
        found, a = (best,), self.largest(room - 1)
        while best < room and 2 * a > best:
            b = self.largest(min(room - a, a))
            if b == a and len(self.of_size[a]) < 2:
                b = self.largest(a - 1)
            if b > 0 and a + b > best:
                best, found = a + b, (a, b)
            a = self.largest(a - 1)
        return found


def best_fit_together(order: np.ndarray, sizes: np.ndarray, bin_of: np.ndarray, fill: np.ndarray, capacity: int) -> Packing:
    """Put the pieces ``order`` into bins, fullest bins first, by the one or two pieces that fill a bin best."""
    loose, fills = _Loose(order, sizes, capacity), fill.tolist()

    def top_up(b: int) -> None:
        while fills[b] < capacity and (found := loose.filling(capacity - fills[b])):
            for size in found:
                bin_of[loose.take(size)] = b
                fills[b] += size

    for b in np.argsort(-fill, kind="stable").tolist():
        if not loose.have:
            break
        if fills[b]:
            top_up(b)
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        if bin_of[i] < 0:
            fills.append(size)
            bin_of[loose.take(size)] = len(fills) - 1  # the first of its size in the order: the piece itself
            top_up(len(fills) - 1)
    return Packing(bin_of, np.array(fills, dtype=np.int64))


def _fresh(sizes: np.ndarray, capacity: int, rng: np.random.Generator, noise: float, fit=best_fit) -> Packing:
    order = np.argsort(-sizes * (1 + noise * rng.random(len(sizes))), kind="stable")
    return fit(order, sizes, np.full(len(sizes), -1), np.zeros(0, dtype=np.int64), capacity)


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: by the tokens, and by the pieces that cannot share a bin with each other."""
    bound, half = -(-int(sizes.sum()) // capacity), capacity / 2
    for small in range(0, capacity // 2 + 1, 8):
        alone = int((sizes > capacity - small).sum())
        large = sizes[(sizes > half) & (sizes <= capacity - small)]
        rest = sizes[(sizes >= small) & (sizes <= half)]
        beyond = int(rest.sum()) - (len(large) * capacity - int(large.sum()))
        bound = max(bound, alone + len(large) + max(0, -(-beyond // capacity)))
    return bound


def crossover(a: Packing, b: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """``a`` with whole well-filled bins of ``b`` injected, duplicates dissolved and the displaced refitted."""
    n_b = len(b.fill)
    full = np.argsort(-b.fill, kind="stable")[: max(1, n_b // 2)]
    chosen = np.zeros(n_b, dtype=bool)
    chosen[full[rng.random(len(full)) < rng.choice((0.05, 0.1, 0.5))]] = True
    moved = chosen[b.bin_of]
    broken = np.zeros(len(a.fill), dtype=bool)
    broken[a.bin_of[moved]] = True
    # Bins with much room are dissolved too, the more likely the more room they have.
    room = capacity - a.fill
    broken |= rng.random(len(room)) < 0.45 * np.minimum(1, room / max(1.0, np.quantile(room, 0.9)))
    stay = ~broken[a.bin_of] & ~moved
    # bins are numbered anew: those that stay, then those injected
    names = np.full(len(a.fill), -1)
    kept = np.unique(a.bin_of[stay])
    names[kept] = np.arange(len(kept))
    given = np.flatnonzero(chosen)
    other = np.full(n_b, -1)
    other[given] = len(kept) + np.arange(len(given))
    bin_of = np.full(len(sizes), -1)
    bin_of[stay] = names[a.bin_of[stay]]
    bin_of[moved] = other[b.bin_of[moved]]
    fill = np.bincount(bin_of[bin_of >= 0], weights=sizes[bin_of >= 0], minlength=len(kept) + len(given)).astype(np.int64)
    loose = np.flatnonzero(bin_of < 0)
    order = loose[np.argsort(-sizes[loose] * (1 + 0.1 * rng.random(len(loose))), kind="stable")]
    return best_fit_together(order, sizes, bin_of, fill, capacity)


def evolve(sizes: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray], generations: int, population: int) -> Packing:
    """The best packing after some generations on one island, which starts from ``elites``.

    It ends early where no packing can be better, or ``PATIENCE`` generations brought none with fewer bins.
    """
    rng = np.random.default_rng(seed)
    bound, rank = least_bins(sizes, capacity), lambda p: p.cost(capacity)
    pool = [Packing(e.copy(), np.bincount(e, weights=sizes).astype(np.int64)) for e in elites] or [_fresh(sizes, capacity, rng, 0.0)]
    pool.sort(key=rank)
    while len(pool) < population and rank(pool[0])[0] > bound:
        pool.append(_fresh(sizes, capacity, rng, 0.05 * len(pool), best_fit_together))
        pool.sort(key=rank)
    idle, generation = 0, 0
    while generation < generations and idle < PATIENCE and rank(pool[0])[0] > bound:
        before, i = rank(pool[0])[0], int(rng.integers(1, len(pool)))
        children = [crossover(pool[0], pool[i], sizes, capacity, rng), crossover(pool[i], pool[0], sizes, capacity, rng)]
        pool = sorted([*pool, *children], key=rank)[:population]
        generation, idle = generation + 1, 0 if rank(pool[0])[0] < before else idle + 1
    return pool[0]


def _island(capacity: int, generations: int, population: int):
    """One epoch of one island: rows (block, island, bins, waste, bin_of, sizes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in ("block", "island", "epoch")}
                sizes = np.frombuffer(batch.column("sizes")[i].as_buffer(), dtype=np.int64)
                elites = [np.frombuffer(e, dtype=np.int64) for e in batch.column("elites")[i].as_py() or []]
                seed = (row["block"] * 1000 + row["island"]) * 1000 + row["epoch"]
                best = evolve(sizes, capacity, seed & 0x7FFFFFFF, elites, generations, population)
                bins, waste = best.cost(capacity)
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([row["block"]]), "island": pa.array([row["island"]], type=pa.int32()),
                        "bins": pa.array([bins], type=pa.int64()), "waste": pa.array([waste]),
                        "bin_of": pa.array([best.bin_of.astype(np.int64).tobytes()], type=pa.binary()), "sizes": batch.column("sizes").slice(i, 1),
                    }
                )

    return run


_STATE = "block long, island int, bins long, waste double, bin_of binary, sizes binary"
_ORDER = [(c, "ascending") for c in ("doc_id", "piece", "start", "length", "ids_crc32", "copy")]
_PIECE = ("doc_id", "piece", "start", "length", "ids_crc32", "copy")


def _gather(table: pa.Table) -> pa.Table:
    """The sizes of a block's pieces, in the order of the pieces."""
    sizes = table.take(pc.sort_indices(table, sort_keys=_ORDER)).column("length").to_numpy().astype(np.int64)
    return pa.table({"block": table.column("block").slice(0, 1), "sizes": pa.array([sizes.tobytes()], type=pa.binary())})


def _assigned(table: pa.Table, best: pa.Table) -> pa.Table:
    """The pieces of a block with their bin, their offset in it and its fill."""
    table = table.take(pc.sort_indices(table, sort_keys=_ORDER))
    sizes, bin_of = (np.frombuffer(best.column(c)[0].as_buffer(), dtype=np.int64) for c in ("sizes", "bin_of"))
    order = np.argsort(bin_of, kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    first = np.append(True, np.diff(bin_of[order]) != 0)
    offset = np.empty(len(sizes), dtype=np.int64)
    offset[order] = before - before[first][np.cumsum(first) - 1]
    fill = np.bincount(bin_of, weights=sizes).astype(np.int64)
    for name, values in (("bin", bin_of), ("offset", offset), ("fill", fill[bin_of])):
        table = table.append_column(name, pa.array(values))
    return table.select([*_PIECE, "block", "bin", "offset", "fill"])


def pack_blocks(pieces: DataFrame, blocks: int, capacity: int, islands: int, epochs: int, generations: int, population: int) -> DataFrame:
    """``pieces`` with block, bin, offset and fill, dealt into ``blocks`` blocks."""
    kind = dict(pieces.dtypes)["doc_id"]
    dealt = pieces.select(*_PIECE, F.pmod(F.xxhash64(*_PIECE), F.lit(blocks)).alias("block"))
    state = (
        dealt.groupBy("block")
        .applyInArrow(_gather, "block long, sizes binary")
        .select("*", F.explode(F.array(*(F.lit(i) for i in range(islands)))).alias("island"), F.lit(0).alias("epoch"), F.lit(None).cast("array<binary>").alias("elites"))
    )
    for epoch in range(epochs):
        # One row is one island of one block, seconds of work: few bytes, so the number of tasks is given.
        tasks = min(blocks * islands, 4 * shuffle_partitions(pieces.sparkSession))
        state = state.repartition(tasks, "block", "island").mapInArrow(_island(capacity, generations, population), _STATE)
        state = checkpoint(state)
        if epoch + 1 < epochs:
            moved = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("bin_of").alias("guest"))
            state = state.join(moved, ["block", "island"]).select(
                "block", "island", F.lit(epoch + 1).alias("epoch"), "sizes", F.array("bin_of", "guest").alias("elites")
            )
    best = state.groupBy("block").agg(F.min_by(F.struct("bin_of", "sizes"), F.struct("bins", "waste", "island")).alias("b")).select("block", "b.*")
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, copy long, block long, bin long, offset long, fill long"
    return dealt.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(_assigned, schema)


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS,
    generations: int = GENERATIONS, population: int = POPULATION, spill_over: float = 0.995, ranks_path: str | None = None,
) -> DataFrame:
    """The pieces of every document with their sequence and their place in it.

    Bins of the first deal that are filled below ``spill_over`` are packed again, in
    blocks that mix the left-over pieces of many first blocks.
    """
    pieces = checkpoint(tokenised_pieces(docs, path, capacity, ranks_path))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # A sequence's number: its round in the lowest two bits, above them its bin (below 2^31) and its block.
    whole = pieces.where(F.col("length") == capacity).select(
        *columns, (F.monotonically_increasing_id() * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    # Rows that repeat are counted and numbered, so that even many of them are dealt to different blocks.
    part = pieces.where(F.col("length") < capacity).groupBy(*columns).agg(F.count("*").alias("n"))
    part = checkpoint(part.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")))
    blocks = -(-part.count() // block) or 1
    first = checkpoint(pack_blocks(part, blocks, capacity, islands, epochs, generations, population))
    # A single block has no others whose left-over pieces could meet its own.
    full = F.col("fill") >= int(spill_over * capacity) if blocks > 1 else F.lit(True)
    rest = first.where(~full).select(*_PIECE)
    blocks = -(-rest.count() // block) or 1
    second = pack_blocks(rest, blocks, capacity, islands, epochs, generations, population)

    def numbered(packed: DataFrame, number: int) -> DataFrame:
        sequence = F.shiftleft("block", 33).bitwiseOR(F.shiftleft("bin", 2)).bitwiseOR(F.lit(number).cast("long"))
        return packed.select(*columns, sequence.alias("sequence_id"), "offset")

    return whole.union(numbered(first.where(full), 1)).union(numbered(second, 2))
