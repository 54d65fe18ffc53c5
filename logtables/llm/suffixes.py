"""Passages that repeat across documents, found by deep-shallow sorting of suffixes.

The suffixes of all texts are cut at ``WINDOW`` bytes and dealt to buckets: a window's bucket is
the smallest hash of the ``GRAM``-byte strings in it, so equal windows meet, wherever they are.
Neighbouring windows mostly share their bucket and travel as one fragment. Inside a bucket the
windows are sorted the deep-shallow way: multikey quicksort up to ``SHALLOW`` bytes, then blind
tries for the groups that still agree. A group of equal windows belongs to the smallest
document in it; in every other document the bytes under the window go.

Equal texts count as one: the smallest of their documents owns the text, the others lose all of
it if it has a window. What is not alone is found first. A fragment's key is its bucket and two
short hashes of the bytes beside the bucket's string: equal windows hold all of one of its sides,
so a key that agrees with none of another text on a side repeats nothing. Only the keys of
different texts are shuffled for that, in sorted chunks, as steps and numbers within the chunk.
Texts with repeats are then joined to their keys and cut into fragments, copies once. Equal
fragments of a task travel once, with their places. A bucket met by more than ``CELL`` keys is hot: its fragments are dealt by their content,
and where they differ window by window, each window with its smallest document, combined
before the shuffle. So neither a passage in a third of all documents nor a common beginning
with many continuations comes together in one task.

Defined results: texts count as UTF-8 bytes, null as empty. A null doc_id is larger than any
other; rows of equal ids, repeated rows too, take nothing from each other. Texts are taken
whole, long ones in pieces that overlap. Other columns stay, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

WINDOW, GRAM = 50, 16
#: Bytes sorted by multikey quicksort, eight to a character, before blind tries take over.
SHALLOW = 16
#: Rows of a bucket beyond which it is split by content.
CELL = 4096
#: Windows of a fragment; bytes looked at together; fragments kept in a task to find equal ones.
LONGEST, SLAB, MEMORY = 64, 1 << 20, 150_000
#: Fragments whose buckets are sorted together.
TOGETHER = 30_000
NO_ID = (1 << 63) - 1
#: Strings of a window; bytes beside its smallest that decide; bits of a key below the bucket.
SPAN, SIDE, BELOW = WINDOW - GRAM + 1, (WINDOW - GRAM) // 2, 24
#: The sides that agree with all others.
ANY_LEFT, ANY_RIGHT = (1 << 12) - 1, (1 << 11) - 1
#: Keys of a chunk; keys looked through for shared buckets together, if a cell has so many.
CHUNK, LOOKED = 1 << 20, 1 << 21
#: Cells of buckets for each shuffle partition.
CELLS = 4

# Odd multipliers with well spread bits: the golden ratio and two primes of a common hash.
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def grams(data: bytes) -> np.ndarray:
    """The hash of every ``GRAM`` bytes of ``data``, even numbers; empty if it has no window."""
    n = len(data) - GRAM + 1
    if len(data) < WINDOW:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        found = words[:n] * _A
        found ^= (words[8 : 8 + n] * _B) >> np.uint64(7)
        found += words[GRAM - 8 : GRAM - 8 + n] * _C
        found ^= found >> np.uint64(32)
        found *= _D
    found ^= found >> np.uint64(29)
    found &= np.uint64(0xFFFFFFFFFFFFFFFE)
    return found


def buckets(data: bytes) -> np.ndarray:
    """The bucket of every window of ``data``, even numbers; empty if it is shorter than one."""
    return _least(grams(data))


def _least(found: np.ndarray) -> np.ndarray:
    if not len(found):
        return found
    span, width = SPAN, 1
    while 2 * width <= span:
        found = np.minimum(found[:-width], found[width:])
        width *= 2
    return np.minimum(found[: len(found) - (span - width)], found[span - width :])


def slabs(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts end to end, about ``SLAB`` bytes at a time: (data, number of the row, first byte, place in the text) of its parts."""
    parts: list[tuple[int, int, bytes]] = []
    held = 0
    for number, text in rows:
        for at in range(0, max(1, len(text) - WINDOW + 1), SLAB):
            parts.append((number, at, text[at : at + SLAB + WINDOW - 1]))
            held += len(parts[-1][2])
            if held >= SLAB:
                yield _slab(parts)
                parts, held = [], 0
    if parts:
        yield _slab(parts)


def _slab(parts: list[tuple[int, int, bytes]]):
    starts = np.cumsum([0, *(len(p[2]) for p in parts)])
    return b"".join(p[2] for p in parts), np.array([p[0] for p in parts]), starts, np.array([p[1] for p in parts])


def fragments(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one bucket: (part, first byte, windows, bucket); none crosses parts."""
    return _runs(buckets(data), starts)


def _runs(found: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if not len(found):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    part = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(found)]
    whole = np.arange(len(found)) + WINDOW <= starts[1:][part]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (part[1:] != part[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    # A run ends where the next begins or at the last whole window of its part.
    edge = np.flatnonzero(new | ~whole)
    after = np.append(edge, len(found))[np.searchsorted(edge, first, "right")]
    size = after - first
    pieces = -(-size // LONGEST)
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.repeat(first, pieces) + step * LONGEST
    size = np.minimum(np.repeat(size, pieces) - step * LONGEST, LONGEST)
    return part[at], at, size, found[at]


def keyed_fragments(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``fragments`` with a key in place of the bucket: 40 bits of the bucket, 12 of the hash of the
    ``SIDE`` bytes left of its string, 11 of those right of it, and a bit for later.

    A window holds the string and ``2 * SIDE`` bytes more, so all of one of its sides: equal windows
    have keys that agree on a side. Where the string is in a fragment twice, both are ``ANY``.
    A key follows from the part alone.
    """
    found = grams(data)
    part, at, size, bucket = _runs(_least(found), starts)
    if not len(at):
        return part, at, size, bucket
    # Some bits are enough: what only seems to be the string makes its place ambiguous at worst.
    short = (found >> np.uint64(1)).astype(np.uint16)
    near = np.lib.stride_tricks.sliding_window_view(short, SPAN)
    wanted = (bucket >> np.uint64(1)).astype(np.uint16)[:, None]
    place = at + (near[at] == wanted).argmax(axis=1)
    last = at + size - 1
    single = place == last + SPAN - 1 - (near[last][:, ::-1] == wanted).argmax(axis=1)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    sides = []
    for begin, values in ((place - SIDE, ANY_LEFT), (place + GRAM, ANY_RIGHT)):
        inside = (begin >= starts[part]) & (begin + SIDE <= starts[part + 1])
        begin = np.where(inside, begin, 0)
        with np.errstate(over="ignore"):
            mixed = words[begin] * _A
            mixed ^= (words[begin + 8] * _B) >> np.uint64(7)
            mixed += words[begin + SIDE - 8] * _C
            mixed ^= mixed >> np.uint64(32)
            mixed *= _D
        sides.append(np.where(single, np.where(inside, (mixed >> np.uint64(32)) % np.uint64(values), np.uint64(0)), np.uint64(values)))
    key = ((bucket >> np.uint64(1)) << np.uint64(BELOW)) | (sides[0] << np.uint64(12)) | (sides[1] << np.uint64(1))
    return part, at, size, key


def _packed(docs: DataFrame) -> DataFrame:
    """The same rows with their texts compressed, for the way to other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array([pack(t.as_py()) for t in batch.column(at)], pa.binary()))

    return docs.mapInArrow(run, docs.schema)


def _coded(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: of small ones the upper bytes cost nothing."""
    return zstandard.compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes(), 1)


def _decoded(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _key_blobs(keys: np.ndarray, owners: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Keys in order, as steps from bucket to bucket and as sides, and their owners."""
    steps = np.diff(keys >> np.uint64(BELOW), prepend=np.uint64(0))
    return _coded(steps), _coded((keys & np.uint64((1 << BELOW) - 1)).astype(np.uint32)), _coded(owners.astype(np.uint32))


def _blob_keys(steps: bytes, sides: bytes, owners: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = (np.cumsum(_decoded(steps, np.uint64), dtype=np.uint64) << np.uint64(BELOW)) | _decoded(sides, np.uint32)
    return keys, _decoded(owners, np.uint32).astype(np.int64)


KEY_NAMES = ["cell", "chunk", "steps", "sides", "owners"]
KEYS_DDL = "cell long, chunk long, steps binary, sides binary, owners binary"


def _key_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], KEY_NAMES)


def _hashes(packed: DataFrame, cells: int) -> DataFrame:
    """The keys of chunks of different texts, from rows in order of the text. A chunk gives a line
    for each of ``cells`` ranges of buckets, with the owners' numbers in the chunk, and one
    without keys, the table of its ``row``s. It is named after the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, unpack = None, zstandard.ZstdDecompressor().decompress
        table: list[int] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def chunk() -> pa.RecordBatch:
            nonlocal table, held, count
            rows = np.array(table, np.int64).tobytes()
            name = int(np.uint64(xxhash.xxh3_64_intdigest(rows)).view(np.int64))
            keys = np.concatenate([k for k, _ in held]) if held else np.zeros(0, np.uint64)
            owners = np.concatenate([o for _, o in held]) if held else np.zeros(0, np.int64)
            order = np.argsort(keys)
            keys, owners = keys[order], owners[order]
            tied = np.zeros(len(keys) + 1, bool)
            tied[1:-1] = keys[1:] == keys[:-1]
            at = np.flatnonzero(tied[1:] | tied[:-1])
            owners[at] = owners[at][np.lexsort((owners[at], keys[at]))]
            first = np.ones(len(keys), bool)
            first[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
            keys, owners = keys[first], owners[first]
            ranges = ((keys >> np.uint64(BELOW)) * np.uint64(cells)) >> np.uint64(64 - BELOW)
            edges = np.append(np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])), len(keys)) if len(keys) else [0]
            out = [(int(ranges[x]), name, *_key_blobs(keys[x:y], owners[x:y])) for x, y in zip(edges, edges[1:])]
            table, held, count = [], [], 0
            return _key_batch([*out, (name % cells, name, None, None, rows)])

        for batch in batches:
            new = []
            for n, key in enumerate(zip(batch.column("row").to_pylist(), batch.column("twin").to_pylist())):
                if key != last:  # copies follow each other
                    new.append(n)
                last = key
            rows, texts = batch.column("row").to_numpy(), batch.column("text")
            for data, numbers, starts, _ in slabs((n, unpack(texts[n].as_py())) for n in new):
                part, _, _, key = keyed_fragments(data, starts)
                own, place = np.unique(numbers, return_inverse=True)
                held.append((key, place[part] + len(table)))
                table.extend(rows[own].tolist())
                count += len(key)
                if count >= CHUNK:
                    yield chunk()
        if table:
            yield chunk()

    return packed.mapInArrow(run, KEYS_DDL)


def _differ(rows: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Which rows are in a group (of equal numbers, side by side) with a row of another value."""
    begins = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    several = np.minimum.reduceat(rows, begins) != np.maximum.reduceat(rows, begins)
    return np.repeat(several, np.diff(np.append(begins, len(rows))))


def partners(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which of some whole buckets' keys, in order, agree on a side with one of another row."""
    bucket = keys >> np.uint64(BELOW)
    found = np.zeros(len(keys), bool)
    at = np.flatnonzero(_differ(rows, bucket)) if len(keys) else np.zeros(0, np.int64)
    if not len(at):
        return found
    keys, rows, bucket = keys[at], rows[at], bucket[at]
    left = keys >> np.uint64(12)
    good = _differ(rows, left)
    right = (bucket << np.uint64(12)) | (keys & np.uint64(0xFFE))
    order = np.argsort(right, kind="stable")
    good[order] |= _differ(rows[order], right[order])
    begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    loose = np.logical_or.reduceat((left & np.uint64(ANY_LEFT)) == ANY_LEFT, begins)
    found[at] = good | np.repeat(loose, np.diff(np.append(begins, len(keys))))
    return found


def _shared(ordered: DataFrame, cell: int) -> DataFrame:
    """The keys that others may share windows with, in lines like those of ``_hashes``, from lines
    in order of the cell; odd keys are of hot buckets, which stay whole. Tables go on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunks, held, count, least = None, [], [], 0, LOOKED
        hot_buckets = np.zeros(0, np.uint64)

        def look(last: bool) -> list[tuple]:
            nonlocal held, count, least, hot_buckets
            keys, rows = np.concatenate([k for k, _ in held]), np.concatenate([r for _, r in held])
            order = np.argsort(keys)
            keys, rows = keys[order], rows[order]
            bucket = keys >> np.uint64(BELOW)
            begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            sizes = np.diff(np.append(begins, len(keys)))
            hot = (sizes > cell) | np.isin(bucket[begins], hot_buckets)
            alone = np.repeat((sizes == 1) & ~hot, sizes)
            spread = np.repeat(hot, sizes)
            out = [(keys[spread] | np.uint64(1), rows[spread])]
            if last:
                rest = ~spread & ~alone
                keys, rows = keys[rest], rows[rest]
                found = partners(keys, rows)
                out.append((keys[found], rows[found]))
                held, count, least, hot_buckets = [], 0, LOOKED, np.zeros(0, np.uint64)
            else:
                # Only what is not hot waits for the rest of the cell.
                hot_buckets = np.union1d(hot_buckets, bucket[begins][hot])
                held, count = [(keys[~spread], rows[~spread])], int((~spread).sum())
                least = max(LOOKED, 2 * count)
            keys, rows = (np.concatenate([o[i] for o in out]) for i in range(2))
            order = np.lexsort((keys, rows >> 32))
            keys, rows = keys[order], rows[order]
            number = rows >> 32
            edges = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(number)) if len(number) else [0]
            return [(at, chunks[number[x]], *_key_blobs(keys[x:y], rows[x:y] & 0xFFFFFFFF)) for x, y in zip(edges, edges[1:])]

        for batch in batches:
            for line in batch.to_pylist():
                if line["steps"] is None:
                    yield _key_batch([tuple(line.values())])
                    continue
                if line["cell"] != at:
                    if held:
                        yield _key_batch(look(True))
                    at, chunks = line["cell"], []
                keys, owners = _blob_keys(line["steps"], line["sides"], line["owners"])
                held.append((keys, owners | (len(chunks) << 32)))
                chunks.append(line["chunk"])
                count += len(keys)
                if count >= least:
                    yield _key_batch(look(False))
        if held:
            yield _key_batch(look(True))

    return ordered.mapInArrow(run, KEYS_DDL)


def _marks(ordered: DataFrame) -> DataFrame:
    """``row, marks``: the shared keys of each text of a chunk, from lines in order of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, table, held = None, None, []

        def close() -> pa.RecordBatch:
            if held and table is None:
                raise ValueError("the table of a chunk is missing: its task ran again on other rows")
            keys = np.concatenate([k for k, _ in held]) if held else np.zeros(0, np.uint64)
            owners = np.concatenate([o for _, o in held]) if held else np.zeros(0, np.int64)
            order = np.argsort(owners, kind="stable")
            keys, owners = keys[order], owners[order]
            begins = np.flatnonzero(np.append(True, owners[1:] != owners[:-1])) if len(owners) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(keys)), pa.int32()), pa.array(keys.view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(table[owners[begins]] if held else [], pa.int64()), lists], ["row", "marks"])

        for batch in batches:
            for line in batch.to_pylist():
                if line["chunk"] != last:
                    yield close()
                    last, table, held = line["chunk"], None, []
                if line["steps"] is None:
                    table = np.frombuffer(line["owners"], np.int64)
                else:
                    held.append(_blob_keys(line["steps"], line["sides"], line["owners"]))
        yield close()

    return ordered.mapInArrow(run, "row long, marks array<long>")


def _fragments(joined: DataFrame) -> DataFrame:
    """``route, fragment, places`` of the shared buckets: places are (row, doc, first window) in binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[tuple[int, bytes], list[bytes]] = {}
        last, unpack = None, zstandard.ZstdDecompressor().decompress

        def flush() -> pa.RecordBatch:
            routes = [xxhash.xxh3_64_intdigest(f) | 1 if m & 1 else m for m, f in memory]
            routes = np.array(routes, np.uint64).view(np.int64)
            columns = [pa.array(routes), pa.array([f for _, f in memory], pa.binary()), pa.array([b"".join(p) for p in memory.values()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["route", "fragment", "places"])

        for batch in batches:
            rows = batch.column("row").to_numpy()
            docs, own = [], []
            for row, twin, owners in zip(rows.tolist(), batch.column("twin").to_pylist(), batch.column("owners").to_pylist()):
                own.append((row, twin) != last)  # copies follow each other
                last = (row, twin)
                docs.append(next((o["doc"] for o in owners or () if o["twin"] == twin), NO_ID))
            docs = np.array(docs, np.int64)
            lists = batch.column("marks")
            marks = np.unique(lists.flatten().to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
            known = np.unique(marks & np.uint64(0xFFFFFFFFFFFFFFFE))
            hot = marks[(marks & np.uint64(1)) == 1] - np.uint64(1)
            whole = ~np.uint64((1 << BELOW) - 1)
            valid = np.asarray(lists.is_valid()) & np.array(own, bool)
            texts = batch.column("text")
            for data, numbers, starts, places in slabs((n, unpack(texts[n].as_py())) for n in np.flatnonzero(valid).tolist()):
                part, at, size, key = keyed_fragments(data, starts)
                keep = np.isin(key, known)
                part, at, size, key = part[keep], at[keep], size[keep], key[keep]
                marked = (key & whole) + np.isin(key, hot)
                number = numbers[part]
                where = np.stack([rows[number], docs[number], places[part] + at - starts[part]], axis=1).astype("<i8")
                packed = where.tobytes()
                for i, (mark, first, n) in enumerate(zip(marked.tolist(), at.tolist(), size.tolist())):
                    memory.setdefault((mark, data[first : first + n + WINDOW - 1]), []).append(packed[24 * i : 24 * i + 24])
                if len(memory) > MEMORY:
                    yield flush()
                    memory = {}
        yield flush()

    return joined.mapInArrow(run, "route long, fragment binary, places binary")


class BlindTrie:
    """Sorts windows that agree up to some depth.

    An inner node knows only the byte at which its children part. A window goes down by those
    bytes alone, is compared once with the window it ends at, and branches off where they part.
    """

    def __init__(self, window: bytes, place: int):
        self.root: list = [None, window, [place]]  # a leaf: (no branch, window, places)

    def add(self, window: bytes, place: int) -> None:
        node, path = self.root, []
        while node[0] is not None:
            path.append(node)
            node = node[1].get(window[node[0]]) or next(iter(node[1].values()))
        if node[1] == window:
            node[2].append(place)
            return
        parted = next(i for i, (a, b) in enumerate(zip(node[1], window)) if a != b)
        above = [n for n in path if n[0] < parted]
        leaf = [None, window, [place]]
        below = path[len(above)] if len(above) < len(path) else node
        if below[0] == parted:
            below[1][window[parted]] = leaf
            return
        branch = [parted, {node[1][parted]: below, window[parted]: leaf}]
        if above:
            above[-1][1][window[above[-1][0]]] = branch
        else:
            self.root = branch

    def groups(self) -> Iterator[list[int]]:
        """Places of equal windows, the windows in order."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node[0] is None:
                yield node[2]
            else:
                todo.extend(node[1][c] for c in sorted(node[1], reverse=True))


def shallow(cells: np.ndarray, characters: list[np.ndarray]) -> np.ndarray:
    """The order of windows by cell and characters, and where groups of equal ones begin in it.

    Multikey quicksort, all groups of a depth at once: each character sorts only the windows
    that have agreed so far, inside their groups.
    """
    order = np.argsort(cells, kind="stable")
    first = np.append(True, cells[order][1:] != cells[order][:-1]) if len(order) else np.zeros(0, bool)
    for letters in characters:
        group = np.cumsum(first)
        tied = ~first
        tied[:-1] |= ~first[1:]
        at = np.flatnonzero(tied)
        rows = order[at]
        by_letter = np.argsort(letters[rows], kind="quicksort")
        by_group = np.argsort(group[at][by_letter], kind="stable")
        moved = by_letter[by_group]
        order[at] = rows[moved]
        letter = letters[order[at]]
        new = np.ones(len(at), bool)
        new[1:] = (letter[1:] != letter[:-1]) | (group[at][1:] != group[at][:-1])
        first[at] = new
    return order, first


def lower(texts: list[bytes], cells: np.ndarray, low: np.ndarray, lows: np.ndarray, first: np.ndarray) -> None:
    """Sorts the windows of texts inside their cells; each gets the smallest ``low`` of the texts
    with an equal one, in ``lows``, where the windows of a text begin at ``first``."""
    sizes = np.array([len(t) - WINDOW + 1 for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    data = b"".join(texts)
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    at = starts[text] + place
    order, new = shallow(cells[text], [words[at + depth].astype(np.uint64) for depth in range(0, SHALLOW, 8)])
    begins = np.flatnonzero(new)
    holder = text[order]
    several = np.minimum.reduceat(holder, begins) != np.maximum.reduceat(holder, begins)
    # Groups that agree to the end are one leaf; the rest of the groups goes to blind tries.
    agree = np.ones(len(order), bool)
    for depth in (*range(SHALLOW, WINDOW - 8, 8), WINDOW - 8):
        letters = words[at[order] + depth]
        agree[1:] &= letters[1:] == letters[:-1]
    equal = np.logical_and.reduceat(agree | new, begins)
    smallest = np.minimum.reduceat(low[holder], begins)
    counts = np.diff(np.append(begins, len(order)))
    done = np.repeat(several & equal, counts)
    target = first[holder] + place[order]
    lows[target[done]] = np.repeat(smallest, counts)[done]
    for begin, count in zip(begins[several & ~equal].tolist(), counts[several & ~equal].tolist()):
        trie = None
        for i in range(begin, begin + count):
            window = data[at[order[i]] : at[order[i]] + WINDOW]
            if trie is None:
                trie = BlindTrie(window, i)
            else:
                trie.add(window, i)
        for group in trie.groups():
            if len(group) > 1:
                lows[target[group]] = low[holder[group]].min()


def spans(places: np.ndarray, lows: np.ndarray) -> Iterator[np.ndarray]:
    """(row, doc, first window, windows) of the runs of windows that a smaller document has."""
    if (lows == lows[0]).all():
        hit = places[places[:, 1] > lows[0]]
        if len(hit):
            yield np.column_stack([hit, np.full(len(hit), len(lows))])
        return
    hit = places[places[:, 1] > lows.min()]
    if len(hit):
        gone = np.zeros((len(hit), len(lows) + 2), np.int8)
        gone[:, 1:-1] = hit[:, 1:2] > lows
        step = np.diff(gone, axis=1)
        line, start = np.nonzero(step == 1)
        _, end = np.nonzero(step == -1)
        yield np.column_stack([hit[line, 0], hit[line, 1], hit[line, 2] + start, end - start])


SPAN_DDL = "row long, doc long, span long"


def _span_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    columns = (rows[:, 0], rows[:, 1], rows[:, 2] * (2 * LONGEST) + rows[:, 3])
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], ["row", "doc", "span"])


def solved(texts: list[bytes], cells: list[int], owners: list[int], places: list[bytes]) -> list[np.ndarray]:
    """Spans of the distinct fragments of some buckets; ``owners``: the fragment of each of ``places``."""
    if not texts:
        return []
    owner = np.repeat(np.array(owners), [len(p) // 24 for p in places])
    where = np.frombuffer(b"".join(places), "<i8").reshape(-1, 3)
    low = np.full(len(texts), NO_ID)
    np.minimum.at(low, owner, where[:, 1])
    sizes = np.array([len(t) - WINDOW + 1 for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    lows = np.repeat(low, sizes)
    cell = np.array(cells)
    mixed = np.flatnonzero(np.bincount(cell)[cell] > 1)
    if len(mixed):
        lower([texts[i] for i in mixed.tolist()], cell[mixed], low[mixed], lows, first[mixed])
    least, most = np.minimum.reduceat(lows, first), np.maximum.reduceat(lows, first)
    whole = where[:, 1] > most[owner]
    found = [np.column_stack([where[whole], sizes[owner[whole]]])]
    for i in np.flatnonzero((where[:, 1] > least[owner]) & ~whole).tolist():
        o = owner[i]
        found.extend(spans(where[i : i + 1], lows[first[o] : first[o] + sizes[o]]))
    return found


def _cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the buckets that are not hot, from rows in order of the route."""
    last, cell, number = None, {}, -1
    texts, cells, owners, blobs = [], [], [], []
    for batch in batches:
        batch = batch.filter(pa.array((batch.column(0).to_numpy() & 1) == 0))
        for route, fragment, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if route != last:
                if len(texts) > TOGETHER:
                    yield _span_batch(solved(texts, cells, owners, blobs))
                    texts, cells, owners, blobs, number = [], [], [], [], -1
                last, cell, number = route, {}, number + 1
            i = cell.setdefault(fragment, len(texts))
            if i == len(texts):
                texts.append(fragment)
                cells.append(number)
            owners.append(i)
            blobs.append(places)
    yield _span_batch(solved(texts, cells, owners, blobs))


def _hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of hot buckets, with the smallest document of each."""
    for batch in batches:
        batch = batch.filter(pa.array((batch.column(0).to_numpy() & 1).astype(bool)))
        low = [int(np.frombuffer(p, "<i8")[1::3].min()) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.int64())], ["route", "fragment", "places", "low"])


def _hot_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[np.ndarray] = []
        for places, lows in zip(batch.column("places").to_pylist(), batch.column("lows").to_pylist()):
            found.extend(spans(np.frombuffer(places, "<i8").reshape(-1, 3), np.array(lows, np.int64)))
        yield _span_batch(found)


def repeated_spans(packed: DataFrame, owners: DataFrame, cell: int = CELL) -> DataFrame:
    """``row, doc, span`` of packed texts (see ``keyed``), dealt by row: runs of windows that start in a smaller doc too."""
    cells = CELLS * int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = _hashes(packed.sortWithinPartitions("row", "twin"), cells)
    shared = _shared(hashes.repartition("cell").sortWithinPartitions("cell"), cell)
    marks = _marks(shared.repartition("chunk").sortWithinPartitions("chunk"))
    marks = marks.groupBy("row").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    # All columns stay, so that one shuffle of the texts serves the hashes and both joins.
    joined = packed.join(marks.join(owners, "row"), "row", "left")
    dealt = _fragments(joined).repartition("route").sortWithinPartitions("route")
    cold = dealt.mapInArrow(_cold, SPAN_DDL)
    hot = dealt.mapInArrow(_hot, "route long, fragment binary, places binary, low long")
    # Window by window: the smallest document of each, then back to the fragments it is in.
    distinct = hot.groupBy("route").agg(F.first("fragment").alias("fragment"), F.min("low").alias("low"))
    starts = F.sequence(F.lit(1), F.length("fragment") - (WINDOW - 1))
    pieces = distinct.select("route", "low", F.posexplode(F.transform(starts, lambda i: F.substring("fragment", i, F.lit(WINDOW)))).alias("at", "window"))
    least = pieces.groupBy("window").agg(F.min("low").alias("least"))
    lows = pieces.join(least, "window").groupBy("route").agg(F.array_sort(F.collect_list(F.struct("at", "least"))).alias("lows"))
    hot = hot.join(lows.select("route", F.col("lows.least").alias("lows")), "route").select("places", "lows")
    return cold.unionAll(hot.mapInArrow(_hot_spans, SPAN_DDL))


def keyed(docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` in one, doc and text, and two hashes of the text: row, which rows
    are joined by, and twin, which tells texts of one row apart."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    text = F.coalesce(text.cast("binary"), F.lit(b""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("kept"), doc.alias("doc"), text.alias("text"))
    return rows.select("kept", F.xxhash64("text").alias("row"), F.unhex(F.md5("text")).alias("twin"), "doc", "text")


def owned(rows: DataFrame) -> DataFrame:
    """``row, owners``: the smallest doc of each text of a row, (twin, doc)."""
    least = rows.groupBy("row", "twin").agg(F.min("doc").alias("doc"))
    return least.groupBy("row").agg(F.collect_list(F.struct("twin", "doc")).alias("owners"))


def without_repeats(docs: DataFrame, contents: bool = True, cell: int = CELL) -> DataFrame:
    """Adds ``n_bytes, n_removed, n_spans, kept_sha256`` and, with ``contents``, ``kept`` (bytes)
    and ``removed`` (first byte and end of each removed run); the text itself is left out."""
    rows = keyed(docs, F.col("text"))
    owners, packed = owned(rows), _packed(rows).repartition("row")
    found = repeated_spans(packed, owners, cell).groupBy("row").agg(F.collect_set(F.struct("doc", "span")).alias("spans"))
    # Every row has an owner; the join keeps the shape of the one before, so that the texts are shuffled once.
    joined = packed.join(owners.join(found, "row", "left"), "row", "left")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "removed"] if contents else [])]
    added = T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, removed array<array<bigint>>" if contents else ""))
    schema = T.StructType([T.StructField("row", rows.schema["kept"].dataType), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c) for c in ("doc", "twin", "text", "owners", "spans"))
            for doc, twin, text, owners, spans in zip(*columns):
                doc, twin, text, removed = doc.as_py(), twin.as_py(), unpack(text.as_py()), []
                owner = next((o["doc"] for o in owners.as_py() or () if o["twin"] == twin), doc)
                if owner < doc and len(text) >= WINDOW:
                    removed = [[0, len(text)]]
                    spans = pa.scalar(None)
                for start, end in sorted((s["span"] // (2 * LONGEST), s["span"] // (2 * LONGEST) + s["span"] % (2 * LONGEST) + WINDOW - 1) for s in spans.as_py() or () if s["doc"] == doc):
                    if removed and start <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], end)
                    else:
                        removed.append([start, end])
                edges = [0, *(x for r in removed for x in r), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(text), len(text) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), kept, removed))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64())))[: len(names)]
            arrays = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), *arrays], ["row", *names])

    made = joined.mapInArrow(run, schema)
    columns = [F.col(f"row.`{c}`") for c in docs.columns if c != "text"]
    taken = docs.drop("text")
    return made.select(*columns, *[F.col(n).alias(free_name(taken, n)) for n in names])


# Every window of 50 bytes in hex, the smallest document of each, and the bytes it covers elsewhere.
ORACLE = """
with d as (select row_number() over () as r, doc_id, coalesce(doc_id, 9223372036854775807) as d, encode(coalesce(text, '')) as b, hex(encode(coalesce(text, ''))) as h from documents),
w as (select r, d, i, substring(h, 2 * i + 1, 100) as win from (select r, d, h, unnest(range(octet_length(b) - 49)) as i from d where octet_length(b) >= 50)),
m as (select win, min(d) as low from w group by win),
c as (select r, i, i - row_number() over (partition by r order by i) as run from w join m using (win) where d > low),
s as (select r, min(i) as low, max(i) + 50 as high from c group by r, run),
j as (select r, low, high, max(high) over (partition by r order by low rows between unbounded preceding and 1 preceding) as upto from s),
k as (select r, low, high, sum(case when upto is null or low > upto then 1 else 0 end) over (partition by r order by low) as run from j),
g as (select r, run, min(low) as low, max(high) as high from k group by r, run),
e as (
  select r, count(*) as n_spans, sum(high - low)::bigint as n_removed, list(low order by low) as lows, list(high order by low) as highs from g group by r)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when lows is null then h else array_to_string(list_transform(range(len(lows) + 1),
    lambda i: substring(h, (2 * case when i = 0 then 0 else highs[i] end + 1)::bigint, (2 * (case when i = len(lows) then octet_length(b) else lows[i + 1] end - case when i = 0 then 0 else highs[i] end))::bigint)), '') end)) as kept_sha256
from d left join e using (r)
"""
