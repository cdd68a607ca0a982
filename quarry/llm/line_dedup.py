"""Line dedup: repeated and nearly repeated lines go, one occurrence of each stays.

Lines are normalised to their words. Equal ones are grouped by a 128-bit hash. Distinct ones
meet under runs of words: a line's runs are ordered from rare to frequent, the same way in all
lines, and all but the last few are its keys. Two lines that share that many runs and one more
then share a key, so none of those pairs is lost; runs of one line alone are left out by a bit
set of fixed size that never misses a shared one. Short lines meet under their halves as well.
Runs of few lines give pairs. Where a pair has to share two runs or more, one such run is chance
and no reason to hold the two against each other: a line has a key more, and two must agree.

Lines that meet are verified by the edit similarity of the normalised lines. Lines whose lengths
are too far apart for it do not meet, and pairs whose counts of letters are get no distance; nor do
pairs whose parts of 64 characters have, each for itself, too many edits from whatever piece of the
other line they could stand for. All three are bounds, which lose no pair. A SimHash, half of its
bits over words and half over pairs of words, says which pairs are worth a quick attempt at a short
way to edit before the bounds; all others get the distance itself, many pairs at a time. It drops no pair.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import BATCH_ROWS, map_batches, pieces
from quarry.llm.components import components
from quarry.llm.hashing import BASE, INVERSE, gram_hashes, mix, powers, span_hashes, word_spans, word_table
from quarry.storage import Scratch, join_groups, key_filter, may_be_in

#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: The same, but newlines stay.
FOLD_LINES = FOLD[:10] + b"\n" + FOLD[11:]
_NOT_SPACE = word_table(lambda b: b not in b" \n")
#: Characters of three or four bytes in UTF-8: among them are the scripts without spaces.
_WIDE = re.compile(rb"[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf7][\x80-\xbf]{3}")
_HAS_WIDE = re.compile(rb"[\xe0-\xff]").search
#: Bits of a SimHash, and the radius within which a short way to edit is tried first.
LINE_BITS, LINE_RADIUS = 128, 40
#: Lines of a star that one task verifies at most; a larger star is cut, and each pair of its parts is one task's.
LINE_CHUNK = 1024
#: Lines of several stars that are verified together, and bytes of them, about.
LINE_ROWS, LINE_BYTES = 1 << 15, 16 << 20
#: Characters of a part of a line, which is a machine word; the share of a line's parts that is looked for before all of
#: them; the kinds of characters told apart there; the parts looked for at a time, and characters of a text;
#: and pairs from which on their distances are worked out together.
WORD, HEAD, CODES, LANES, STRETCH, FEW = 64, 0.45, 256, 4096, 256, 16
#: Bytes of text hashed at a time: their arrays stay in a core's cache.
SMALL_PIECE = 1 << 18
#: Units to a run, and the part of a line's runs that another must share to be sure to meet it. Where a fifth of the
#: words are others, two fifths of the runs of three are left. Lines of up to PAIRED units have runs of two as well,
#: and those of up to HALVES their first and last half.
RUN, SHARE, PAIR_SHARE, PAIRED, HALVES = 3, 0.25, 0.4, 12, 18
#: Slots of two bits in the set that says in how many lines a run stands: 16 MB, and up to 64 MB for over 2 GB of text.
SLOTS = (26, 28)
#: Lines from which on a run is of the next level.
LEVELS = (2, 9, 65)
#: Bytes of text whose keys one bucket of that set holds, about, and keys that are held before they are dealt out.
BUCKET_BYTES, HELD_KEYS = 16 << 20, 1 << 19
#: Rows of keys that pairs are made of at a time.
PAIR_ROWS = 1 << 14
#: Bits of a run that tell it from others, in its bucket and in all, and bits that tell the lines of a run apart.
INNER_BITS, KEY_BITS, LINE_HASH = 30, 40, 24
#: Kinds of characters that are counted: letters, space, and what is left by its code point.
LETTERS = 32
_LETTER_OF = np.array([c - 97 if 97 <= c <= 122 else 26 if c == 32 else 27 + c % 5 for c in range(128)], np.int64)


def normalised(line: bytes) -> list[bytes]:
    return line.translate(FOLD).split()


def units(line: bytes) -> bytes:
    """A normalised line with its units parted by spaces: its words, and single characters of scripts
    without spaces; where that gives under three, its bytes."""
    if not line.isascii() and _HAS_WIDE(line):
        line = b" ".join(_WIDE.sub(rb" \g<0> ", line).split())
    if line.count(b" ") < 2:
        line = b" ".join([line[i : i + 1] for i in range(len(line)) if line[i] != 32])
    return line


def _majorities(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash (8 bytes a row) of each line from the hashes of its items; every line has one at least."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    # Eight bits at a time are added as the bytes of one number; a byte holds the sum of 255 items.
    parts = -(-counts // 255)
    ends = np.cumsum(parts)
    begin = np.repeat(first - 255 * (ends - parts), parts) + 255 * np.arange(ends[-1])
    sums = np.add.reduceat(bits.view(np.uint64), begin, axis=0).view(np.uint8)
    if len(sums) > len(first):
        sums = np.add.reduceat(sums, ends - parts, axis=0, dtype=np.int64)
    return np.packbits(2 * sums.astype(np.int64) > counts[:, None], axis=1)


def _hashed(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hash of every unit and its line's number; the number of units of each line, and where they begin."""
    data, starts, ends, of = word_spans([units(line) for line in lines], _NOT_SPACE)
    counts = np.bincount(of, minlength=len(lines))
    return span_hashes(data, starts, ends), of, counts, np.cumsum(counts) - counts


def simhashes(words: np.ndarray, of: np.ndarray, counts: np.ndarray, first: np.ndarray) -> list[bytes]:
    # Pairs of neighbours; the first word of a line has a pair of its own with what stands before every line.
    pairs = mix(words * np.uint64(BASE) + np.where(np.arange(len(words)) == first[of], np.uint64(0), np.roll(words, 1)))
    prints = np.concatenate([_majorities(words, first, counts), _majorities(pairs, first, counts)], axis=1)
    return [p.tobytes() for p in prints]


def line_keys(words: np.ndarray, of: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line numbers, a key for each, and its kind: 0 halves, 1 runs of two, 2 runs of three. Repeats stay."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(BASE, len(words)), out=sums[1:])
    back = powers(INVERSE, len(words) + 1)
    rows, keys = [], []
    number = np.arange(len(counts))
    halved = counts <= HALVES
    for size, who in ((counts // 2, halved & (counts > 3)), ((counts + 1) // 2, halved & (counts > 2) & (counts % 2 == 1))):
        for end, begin in ((0, first[who]), (1, (first + counts - size)[who])):
            run = (sums[begin + size[who]] - sums[begin]) * back[begin]
            rows.append(number[who])
            keys.append(mix(run + (2 * size[who] + end).astype(np.uint64)))
    kinds = [np.zeros(sum(map(len, rows)), np.int64)]
    for kind, size in ((1, RUN - 1), (2, RUN)):
        grams = gram_hashes(words, size)
        begin = of[: len(grams)]
        inside = begin == of[size - 1 :]
        if kind == 1:
            inside &= counts[begin] <= PAIRED
        rows.append(begin[inside])
        keys.append(grams[inside])
        kinds.append(np.full(len(rows[-1]), kind))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(kinds)


def line_prints(lines: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The 128-bit SimHash of each normalised line; then all its keys: line numbers in order, and a key for each."""
    hashed = _hashed(lines)
    row, key, _ = line_keys(*hashed)
    order = np.argsort(row, kind="stable")
    return simhashes(*hashed), row[order], (key[order] >> np.uint64(1)).astype(np.int64)


def _sorted_set(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


class Levels:
    """How frequent a run is among the distinct lines: 0 if it stands in one, and then by LEVELS; never too low."""

    def __init__(self, text_bytes: int):
        self.bucket_bits = max(6, (text_bytes // BUCKET_BYTES).bit_length())
        self.inner_bits = min(INNER_BITS, KEY_BITS - self.bucket_bits)
        self.slot_bits = min(max((text_bytes // 32).bit_length(), SLOTS[0]), SLOTS[1]) - self.bucket_bits
        self.flags: np.ndarray | None = None  # a row for each bucket, four slots to a byte

    def short(self, keys: np.ndarray) -> np.ndarray:
        """The bits of a key that count: those of its bucket, and then those inside it."""
        return keys >> np.uint64(64 - self.bucket_bits - self.inner_bits)

    def slots(self, short: np.ndarray) -> np.ndarray:
        return (short & np.uint64((1 << self.slot_bits) - 1)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slots(self.short(keys))
        return self.flags[(keys >> np.uint64(64 - self.bucket_bits)).astype(np.int64), slot >> 2] >> (2 * (slot & 3)).astype(np.uint8) & 3

    def values(self, keys: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """A number for each key and its line: the key's bits that count, then a hash of both."""
        return self.short(keys) << np.uint64(LINE_HASH) | mix(lines ^ keys) & np.uint64((1 << LINE_HASH) - 1)

    def deal(self, values: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The buckets that sorted values fall in, and the values of each in few bytes."""
        bounds = np.searchsorted(values >> np.uint64(LINE_HASH + self.inner_bits), np.arange((1 << self.bucket_bits) + 1, dtype=np.uint64))
        used = np.flatnonzero(bounds[1:] > bounds[:-1])
        return used, [self._written(values[bounds[b] : bounds[b + 1]]) for b in used]

    def _written(self, values: np.ndarray) -> bytes:
        # The upper bits of sorted keys are written as steps in a row of bits, the lower ones and the line's as bytes.
        key, n = values >> np.uint64(LINE_HASH) & np.uint64((1 << self.inner_bits) - 1), len(values)
        low = 2 if 1 << max(0, self.inner_bits - 16) <= 4 * n else 3
        high = (key >> np.uint64(8 * low)).astype(np.int64)
        steps = np.zeros(n + (1 << max(0, self.inner_bits - 8 * low)), bool)
        steps[high + np.arange(n)] = True
        planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 3 + low]
        return np.array([n, low], "<u4").tobytes() + planes.tobytes() + np.packbits(steps).tobytes()

    @staticmethod
    def read(written: bytes) -> np.ndarray:
        """The values of a bucket, without the bits of the bucket itself."""
        n, low = np.frombuffer(written, "<u4", 2).tolist()
        whole = np.zeros((n, 8), np.uint8)
        whole[:, : 3 + low] = np.frombuffer(written, np.uint8, n * (3 + low), 8).reshape(n, 3 + low)
        steps = np.flatnonzero(np.unpackbits(np.frombuffer(written, np.uint8, offset=8 + n * (3 + low))))
        return whole.view("<u8").ravel() | (steps - np.arange(n)).astype(np.uint64) << np.uint64(LINE_HASH + 8 * low)

    def packed(self, values: np.ndarray) -> bytes:
        """The flags of a bucket from its values."""
        keys = _sorted_set(values) >> np.uint64(LINE_HASH)
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        lines = np.diff(np.append(begin, len(keys)))
        slots = self.slots(keys[begin])
        flags = np.zeros(1 << self.slot_bits, np.uint8)
        for level, least in enumerate(LEVELS, 1):
            flags[slots[lines >= least]] = level
        four = flags.reshape(-1, 4)
        return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()


def _by(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The order by group and then value, from one sort by the bits that fit; where those are equal, from a slower one."""
    bits = np.uint64(int(group.max(initial=0)).bit_length())
    both = group.astype(np.uint64) << np.uint64(64) - bits | value >> bits if bits else value
    order = np.argsort(both)
    ordered = both[order]
    # Equal values are in any order, as they are the same key.
    same = ordered[1:] == ordered[:-1]
    if (value[order[1:][same]] != value[order[:-1][same]]).any():
        return np.lexsort((value, group))
    return order


def rare_first(rows: np.ndarray, keys: np.ndarray, kinds: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that lines have to meet under, in the lines' order: halves, and runs but for the most frequent; and
    how: 0 under this key alone, 1 as a pair under this key alone, 2 as a pair under two keys of any kind.

    Of n runs, lines that share t have one in common among the first n - t + 1 of each, and two
    among the first n - t + 2. Runs of level 0 come first and need no row. A run gives pairs if it has
    three units and is of level 1: that holds in all lines that have it. It does so alone in a line
    that need not share two, or that has it twice.
    """
    group = rows * 3 + kinds
    n = np.bincount(group)
    kind = np.arange(len(n)) % 3
    needed = np.maximum(1, np.ceil(n * np.array([0, PAIR_SHARE, SHARE])[kind] - 1e-9)).astype(np.int64)
    shared = np.flatnonzero(levels)
    left = np.bincount(group[shared], minlength=len(n)) - needed + 1 + ((kind == 2) & (needed > 1))
    shared = shared[left[group[shared]] > 0]
    shared = shared[_by(group[shared], levels[shared].astype(np.uint64) << np.uint64(62) | keys[shared] >> np.uint64(2))]
    of = group[shared]
    n = np.bincount(of, minlength=len(n))
    kept = shared[np.arange(len(of)) - (np.cumsum(n) - n)[of] < left[of]]
    kept = kept[_by(rows[kept], keys[kept])]
    row, key = rows[kept], (keys[kept] >> np.uint64(1)).astype(np.int64)
    new = np.ones(len(kept), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    once = new & np.append(new[1:], True)
    how = np.where((kinds[kept] == 2) & (levels[kept] == 1), 1 + (once & (needed[group[kept]] > 1)), 0)
    return row[new], key[new], how[new]


def few_pairs(keyed: DataFrame, similarity: float) -> DataFrame:
    """(a, b, alone): the pairs a > b under each key of rows (key, rep, size, alone) whose lengths allow the similarity.

    ``size`` counts a line's characters. Keys stand in few lines; those of more get all their pairs as well.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            key, rep, size, alone = (table.column(c).to_numpy() for c in ("key", "rep", "size", "alone"))
            order = np.lexsort((size, key))
            key, rep, size, alone = key[order], rep[order], size[order], alone[order]
            least = size - ((1 - similarity) * size + 1e-9).astype(np.int64)
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            at = np.arange(len(key))
            for shift in range(1, len(key)):
                at = at[at + shift < len(key)]
                # Sorted by length, so further ones of a key are longer still.
                at = at[(key[at] == key[at + shift]) & (size[at] >= least[at + shift])]
                if not len(at):
                    break
                left.append(at)
                right.append(at + shift)
            i, j = np.concatenate(left), np.concatenate(right)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.maximum(rep[i], rep[j]), np.minimum(rep[i], rep[j]), alone[i] | alone[j])], names=["a", "b", "alone"])

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            key = batch.column("key").to_numpy()
            edge = np.flatnonzero(key[1:] != key[:-1])
            new = bool(held and len(key) and held[-1].column("key")[-1].as_py() != key[0])
            # The last key may go on in the next batch.
            if count + batch.num_rows >= PAIR_ROWS and (new or len(edge)):
                end = int(edge[-1]) + 1 if len(edge) else 0
                yield done([*held, batch.slice(0, end)])
                held, count, batch = [], 0, batch.slice(end)
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
        if held:
            yield done(held)

    spread = keyed.repartition("key").sortWithinPartitions("key")  # by one number, which is sorted without comparisons
    return map_batches(spread, run, "a long, b long, alone int")


def fewer_stars(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) of rows (a, b, star) without the pairs that a star holds already: those whose lines have the same least
    neighbour below. Rows of a star stay, as they stand for pairs with its other lines too."""
    least = scratch.keep(pairs.groupBy("a").agg(F.min("b").alias("m")), "least")
    under = join_groups(pairs, least, "a")
    spare = (F.col("b") != F.col("m")) & ~F.col("star")
    theirs = least.select(F.col("a").alias("b"), F.col("m").alias("n"))
    apart = under.where(spare).join(theirs, "b", "left").where("n is null or n != m")
    return under.where(~spare).select("a", "b").unionByName(apart.select("a", "b"))


def _walk(left: list[str], right: list[str], allowed: int) -> bool:
    """Whether some way to edit word by word, found without looking back, costs at most ``allowed``; false decides nothing."""
    i = j = cost = 0
    left, right = [*left, None, None], [*right, None, None]
    while (x := left[i]) is not None and (y := right[j]) is not None:
        if x == y:
            i, j = i + 1, j + 1
            continue
        if left[i + 1] == y and left[i + 1] != right[j + 1]:
            cost, i = cost + len(x) + 1, i + 1
        elif right[j + 1] == x and left[i + 1] != right[j + 1]:
            cost, j = cost + len(y) + 1, j + 1
        else:
            cost, i, j = cost + max(len(x), len(y)), i + 1, j + 1
        if cost > allowed:
            return False
    return cost + sum(len(w) + 1 for w in [*left[i:], *right[j:]] if w is not None) <= allowed


def edit_similar(a: str, b: str, least: float = 0.8) -> bool:
    """Whether 1 - (edit distance / longer length) is at least ``least``; bit-parallel, on what differs."""
    most = max(len(a), len(b))
    allowed = int((1 - least) * most + 1e-9)
    if abs(len(a) - len(b)) > allowed:
        return False
    at, end = 0, min(len(a), len(b))
    while at < end and a[at] == b[at]:
        at += 1
    a, b = a[at:], b[at:]
    end = min(len(a), len(b))
    at = 0
    while at < end and a[-1 - at] == b[-1 - at]:
        at += 1
    a, b = a[: len(a) - at], b[: len(b) - at]
    if max(len(a), len(b)) <= allowed:
        return True
    if not a or not b:
        return False
    if _walk(a.split(" "), b.split(" "), allowed):
        return True
    # Vertical differences of a column of the distance matrix, as two bit vectors.
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for j, c in enumerate(b):
        match = where.get(c, 0)
        zero = (((match & up) + up) ^ up) | match | down
        rise, fall = down | ~(zero | up) & full, up & zero
        distance += bool(rise & top) - bool(fall & top)
        if distance - (len(b) - 1 - j) > allowed:
            return False
        rise = (rise << 1 | 1) & full
        up, down = (fall << 1 | ~(zero | rise)) & full, rise & zero
    return distance <= allowed


def distances(a: str, others: list[str]) -> list[int]:
    """The edit distance of each text from ``a``; bit-parallel, a lane of one large integer for each of them."""
    if not a:
        return [len(t) for t in others]
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    width = len(a) // 8 + 1  # bytes; a lane has a bit more than it needs, for what is carried over
    masks = {c: m.to_bytes(width, "little") for c, m in where.items()}
    none, top = bytes(width), (1 << len(a)) - 1
    order = sorted(range(len(others)), key=lambda i: -len(others[i]))  # ended lanes are the uppermost
    texts, out = [others[i] for i in order], [len(a)] * len(others)
    live = len(texts)
    full = int.from_bytes(top.to_bytes(width, "little") * live, "little")
    ones = int.from_bytes((1).to_bytes(width, "little") * live, "little")
    up, down, j = full, 0, 0
    while True:
        while live and len(texts[live - 1]) == j:
            live -= 1
            at = 8 * width * live
            out[order[live]] = j + (up >> at).bit_count() - (down >> at).bit_count()
            cut = (1 << at) - 1
            full, ones, up, down = full & cut, ones & cut, up & cut, down & cut
        if not live:
            return out
        match = int.from_bytes(b"".join([masks.get(t[j], none) for t in texts[:live]]), "little")
        zero = ((((match & up) + up) ^ up) | match | down) & full
        rise, fall = down | full ^ (zero | up), up & zero
        rise = (rise << 1 | ones) & full
        up, down, j = (fall << 1 | full ^ (zero | rise)) & full, rise & zero, j + 1


def letter_counts(lines: list[str]) -> np.ndarray:
    """How often each kind of character stands in each line; an edit changes one count up and one down at most."""
    points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    kind = np.arange(int(points.max(initial=0)) + 1) % LETTERS
    kind[:128] = _LETTER_OF[: len(kind)]
    at = np.repeat(np.arange(len(lines)) * LETTERS, [len(t) for t in lines])
    at += kind[points]
    return np.bincount(at, minlength=len(lines) * LETTERS).reshape(len(lines), LETTERS).astype(np.int32)


class Parts:
    """Bounds on the edit distances of many pairs of lines at once: parts of up to WORD characters, one machine word each."""

    def __init__(self, lines: list[str]):
        points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
        count = np.bincount(points)
        kinds = np.flatnonzero(count)
        # Rare characters of a large alphabet count as equal, which makes a distance no larger.
        self.kinds, self.exact = min(len(kinds), CODES), len(kinds) <= CODES
        number = np.zeros(len(count), np.uint8)
        number[kinds[np.argsort(-count[kinds], kind="stable")]] = np.minimum(np.arange(len(kinds)), CODES - 1)
        self.codes = number[points]
        self.sizes = np.array([len(t) for t in lines], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def least(self, part: np.ndarray, width: np.ndarray, text: np.ndarray, length: np.ndarray, held: np.ndarray, whole: bool = False) -> np.ndarray:
        """The least distance of each part, ``width`` characters from ``part``, from a piece of its text that begins
        anywhere, or where the text does if ``held`` is 1; from the text itself if ``whole``."""
        if not whole:
            # A piece nearer than the empty one is under twice as long as the part, so a long text is cut into some that overlap by that.
            n = np.maximum(1, -(-(length - 2 * WORD) // STRETCH))
            of = np.repeat(np.arange(len(part)), n)
            k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            part, width, held = part[of], width[of], held[of] * (k == 0)
            text, length = text[of] + k * STRETCH, np.minimum(length[of] - k * STRETCH, STRETCH + 2 * WORD)
        out = np.empty(len(part), np.int64)
        order = np.argsort(-length, kind="stable")  # ended ones are the last
        for at in range(0, len(order), LANES):
            lanes = order[at : at + LANES]
            out[lanes] = self._least(part[lanes], width[lanes], text[lanes], length[lanes], held[lanes].astype(np.uint64), whole)
        return out if whole or not len(out) else np.minimum.reduceat(out, np.cumsum(n) - n)

    def _masks(self, part: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each character stands in each part, as bits; and where those of a part begin."""
        own, base = np.unique(part * (WORD + 1) + width, return_inverse=True)
        starts, widths = own // (WORD + 1), own % (WORD + 1)
        masks = np.zeros(len(own) * self.kinds, np.uint64)
        rows = np.arange(len(own)) * self.kinds
        for k in range(int(widths.max(initial=0))):
            if not (inside := widths > k).all():
                starts, widths, rows = starts[inside], widths[inside], rows[inside]
            masks[rows + self.codes[starts + k]] |= np.uint64(1 << k)
        return masks, base * self.kinds

    def _least(self, part, width, text, length, held, whole):
        masks, base = self._masks(part, width)
        one, last = np.uint64(1), (width - 1).astype(np.uint64)
        n = len(part)
        score, least = width.copy(), width.copy()
        up, down = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
        match, x, rise, fall, at = (np.empty(n, np.uint64) for _ in range(5))
        step, place, code = np.empty(n, np.int64), text.copy(), np.empty(n, np.uint8)
        # Sorted by length, so that those that go on are the first ones.
        lives = np.searchsorted(-length, -np.arange(int(length[0]) if n else 0), side="left").tolist()
        was = -1
        for live in lives:
            if live != was:
                u, d, m, z, r, f, h, g, s, p, c, b, l, t, e = (v[:live] for v in (up, down, match, x, rise, fall, held, at, step, place, code, base, last, score, least))
                gs = g.view(np.int64)
                was = live
            self.codes.take(p, out=c, mode="clip")
            np.add(b, c, out=s)
            masks.take(s, out=m, mode="clip")
            p += 1
            np.bitwise_and(m, u, out=z)
            z += u
            z ^= u
            z |= m  # where a column goes on along a diagonal, from below
            m |= d
            np.bitwise_or(z, u, out=r)
            np.invert(r, out=r)
            r |= d
            np.bitwise_and(u, z, out=f)
            np.right_shift(r, l, out=g)
            g &= one
            t += gs
            np.right_shift(f, l, out=g)
            g &= one
            t -= gs
            if not whole:
                np.minimum(e, t, out=e)
            r <<= one
            r |= h
            f <<= one
            np.bitwise_or(m, r, out=u)
            np.invert(u, out=u)
            u |= f
            np.bitwise_and(r, m, out=d)
        return score if whole else least

    def batches(self, a: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
        """Places in a list of lines, those of about one length at a time; and whether ``distances`` suits so many of them."""
        order = np.argsort(-self.sizes[a], kind="stable")
        sizes, at = self.sizes[a[order]], 0
        words = np.cumsum(sizes // WORD + 1)
        while at < len(order):
            most = words[at] + 4 * LANES
            end = max(at + 1, int(min(np.searchsorted(-sizes, -(sizes[at] // 4), side="right"), np.searchsorted(words, most, side="right"))))
            yield order[at:end], self.exact and end - at >= FEW
            at = end

    def distances(self, a: np.ndarray, b: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """The distance of each pair, ``a`` no longer than ``b``, if it is at most ``allowed``, else some number beyond.

        A line's words of bits are lanes of one step: each is a column behind the word before it, whose last row it
        needs. A word takes only the columns that it can be edited into; beyond them a distance grows by one.
        """
        size, other = self.sizes[a], self.sizes[b]
        words = np.maximum(1, -(-size // WORD))
        pair = np.repeat(np.arange(len(a)), words)
        w = np.arange(len(pair)) - np.repeat(np.cumsum(words) - words, words)
        longer = (other - size)[pair]
        width = np.minimum(size[pair] - w * WORD, WORD)
        low = np.maximum(w * WORD - (allowed[pair] - longer) // 2, 0)
        length = np.minimum(w * WORD + width + (allowed[pair] + longer) // 2, other[pair]) - low
        order = np.argsort(low + w, kind="stable")
        n = len(order)
        place_of = np.empty(n, np.int64)
        place_of[order] = np.arange(n)
        before = np.where(w > 0, place_of[np.arange(n) - 1], n)[order]  # the lane after the last one stands for row 0
        pair, w, width, low, length = pair[order], w[order], width[order], low[order], length[order]
        start = low + w
        stop = start + length
        masks, base = self._masks(self.begin[a[pair]] + w * WORD, width)
        place = self.begin[b[pair]] + low - start
        last, one = (width - 1).astype(np.uint64), np.uint64(1)
        up, down = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
        rise, fall = np.ones(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        step, score = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        turns = np.arange(int(stop.max(initial=0)))
        lows = np.searchsorted(np.maximum.accumulate(stop), turns, side="right").tolist()
        highs = np.searchsorted(start, turns, side="right").tolist()
        was_low = was_high = 0
        for t, lo, hi in zip(turns.tolist(), lows, highs):
            if was_high < hi:
                q = before[was_high:hi]
                score[was_high:hi] = score[q] - step[q] + width[was_high:hi]
            q = before[lo:hi]
            enter_rise, enter_fall = rise.take(q), fall.take(q)
            u, d, end = up[lo:hi], down[lo:hi], last[lo:hi]
            m = masks.take(base[lo:hi] + self.codes.take(place[lo:hi] + t, mode="clip"), mode="clip")
            v = m | d
            m |= enter_fall
            z = m & u
            z += u
            z ^= u
            z |= m
            r = z | u
            np.invert(r, out=r)
            r |= d
            f = u & z
            ended = stop[lo:hi] <= t
            leave_rise, leave_fall = r >> end & one | ended, (f >> end & one) * ~ended
            rise[lo:hi], fall[lo:hi] = leave_rise, leave_fall
            own = step[lo:hi]
            np.subtract(leave_rise.view(np.int64), leave_fall.view(np.int64), out=own)
            own[ended] = 0
            score[lo:hi] += own
            r <<= one
            r |= enter_rise
            f <<= one
            f |= enter_fall
            np.bitwise_and(r, v, out=d)
            r |= v
            np.invert(r, out=r)
            np.bitwise_or(f, r, out=u)
            if was_low < lo:
                rise[was_low:lo], fall[was_low:lo], step[was_low:lo] = 1, 0, 0
            was_low, was_high = lo, hi
        out = np.empty(len(a), np.int64)
        final = w == words[pair] - 1
        out[pair[final]] = score[:n][final]
        return out

    def bounds(self, a: np.ndarray, b: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of line numbers, ``a`` no longer than ``b``: a bound the distance is not under, as far as
        it takes to pass ``allowed``, and whether it is the distance itself.

        Where a pair has no more than ``allowed`` edits, each part of ``a`` is edited into a piece of ``b``
        that it cannot be far from: what it is shifted by, and what is left of the lengths' difference
        then, are edits too. The parts' least distances add up to a bound.
        """
        size, other = self.sizes[a], self.sizes[b]
        out, exact = np.zeros(len(a), np.int64), (size <= WORD) & self.exact
        short = np.flatnonzero(size <= WORD)
        out[short] = self.least(self.begin[a[short]], size[short], self.begin[b[short]], other[short], np.ones(len(short), np.int64), True)
        many = -(-size // WORD)
        first = np.maximum(1, np.ceil(HEAD * many).astype(np.int64))
        live = np.flatnonzero(size > WORD)
        for begin, end in ((np.zeros(len(a), np.int64), first), (first, many)):
            live = live[out[live] <= allowed[live]]
            n = (end - begin)[live]
            pair = np.repeat(live, n)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + begin[pair]
            start, stop = k * size[pair] // many[pair], (k + 1) * size[pair] // many[pair]
            longer = (other - size)[pair]
            low = np.maximum(start - (allowed[pair] - longer) // 2, 0)
            high = np.minimum(stop + (allowed[pair] + longer) // 2, other[pair])
            part = self.least(self.begin[a[pair]] + start, stop - start, self.begin[b[pair]] + low, high - low, (k == 0).astype(np.int64))
            out += np.bincount(pair, part, len(a)).astype(np.int64)
        return out, exact


def link_lines(group: np.ndarray, prints: list[bytes], lines: list[str], similarity: float) -> np.ndarray:
    """For rows sorted by group: the first row that each row's links of edit similarity within its group lead to.

    The first, second and so on line of every group, by length, is held against the longer ones of its group,
    but for those that it is linked with already; a few lines at a time.
    """
    sizes = np.array([len(t) for t in lines], np.int64)
    most = ((1 - similarity) * sizes + 1e-9).astype(np.int64)
    letters, parts = letter_counts(lines), Parts(lines)
    bits = np.frombuffer(b"".join(prints), np.uint64).reshape(len(lines), -1)
    order = np.lexsort((sizes, group))
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    root = np.arange(len(lines))
    begin, end = edges[:-1], edges[1:]

    def link(i: int, j: int, begin: int, end: int) -> None:
        x, y = sorted((root[i], root[j]))
        own = root[begin:end]
        own[own == y] = x

    def walk(i: np.ndarray, j: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        for x, y, first, stop in zip(i.tolist(), j.tolist(), begin.tolist(), end.tolist()):
            if root[x] != root[y] and _walk(words(x), words(y), int(most[y])):
                link(x, y, first, stop)

    def words(x: int) -> list[str]:
        if x not in split:
            split[x] = lines[x].split(" ")
        return split[x]

    split: dict[int, list[str]] = {}
    turn = turns = 0
    asked: list[tuple[np.ndarray, ...]] = []
    while len(begin):
        # More lines at a time as they go on: of the pairs left, few are linked by others meanwhile.
        turn, turns = turn + turns, max(1, turns)
        going = end - begin > turn + 1
        begin, end = begin[going], end[going]
        while turns < turn and 2 * turns * int((end - begin - turn - 1).sum()) <= 16 * LANES:
            turns *= 2
        n = np.minimum(turns, end - begin - turn - 1)
        of = np.repeat(np.arange(len(n)), n)
        first = (begin + turn)[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        n = end[of] - first - 1
        at = np.repeat(np.arange(len(n)), n)
        i = order[first[at]]
        j = order[first[at] + 1 + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]
        of = of[at]
        # Those too long for a line come last.
        may = np.flatnonzero((root[i] != root[j]) & (sizes[j] - most[j] <= sizes[i]))
        may = may[_more_letters(letters, i[may], j[may]) <= most[j[may]]]
        if not len(may):
            continue
        i, j, of = i[may], j[may], of[may]
        # What a SimHash says is near gets a quick attempt first.
        close = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1) <= LINE_RADIUS
        walk(i[close], j[close], begin[of[close]], end[of[close]])
        left = np.flatnonzero(root[i] != root[j])
        i, j, of, close = i[left], j[left], of[left], close[left]
        bound, sure = parts.bounds(i, j, most[j])
        near = np.flatnonzero(bound <= most[j])
        i, j, of, sure, close = i[near], j[near], of[near], sure[near], close[near]
        for x, y, g in zip(i[sure].tolist(), j[sure].tolist(), of[sure].tolist()):
            if root[x] != root[y]:
                link(x, y, begin[g], end[g])
        far = ~(sure | close)
        walk(i[far], j[far], begin[of[far]], end[of[far]])
        left = np.flatnonzero(root[i] != root[j])
        asked.append((i[left], j[left], begin[of[left]], end[of[left]]))
    i, j, begin, end = (np.concatenate([x[k] for x in asked] or [np.zeros(0, np.int64)]) for k in range(4))
    left = np.flatnonzero(root[i] != root[j])
    for place, many in parts.batches(i[left]):
        place = left[place]
        place = place[root[i[place]] != root[j[place]]]
        near = parts.distances(i[place], j[place], most[j[place]]) <= most[j[place]] if many and len(place) else np.ones(len(place), bool)
        for k in place[near].tolist():
            x, y = i[k], j[k]
            if root[x] != root[y] and (many or edit_similar(lines[x], lines[y], similarity)):
                link(x, y, begin[k], end[k])
    return root


def _more_letters(letters: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many letters each line j has that line i has not."""
    return np.concatenate([np.zeros(0, np.int64), *(np.maximum(letters[j[k : k + LANES]] - letters[i[k : k + LANES]], 0).sum(axis=1) for k in range(0, len(i), LANES))])


def verified_links(cells: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of edit similarity between the lines (key, low, high, rep, fp, payload) of a cell; enough to connect what all connect."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> pa.RecordBatch:
            rep, lines = table.column("rep").to_numpy(), table.column("payload").to_pylist()
            root = link_lines(np.cumsum(starts(table)), table.column("fp").to_pylist(), lines, similarity)
            linked = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[root[linked]])], names=["a", "b"])

        def starts(table: pa.Table) -> np.ndarray:
            new = np.zeros(table.num_rows, bool)
            for c in ("key", "low", "high"):
                column = table.column(c).to_numpy()
                new[1:] |= column[1:] != column[:-1]
            return new

        count = size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
                size += batch.nbytes
            if count >= LINE_ROWS or size >= LINE_BYTES:
                table = pa.Table.from_batches(held)
                # The last group may go on in the next batch.
                last = np.flatnonzero(starts(table))
                cut = int(last[-1]) if len(last) else 0
                if cut:
                    yield done(table.slice(0, cut).combine_chunks())
                held, count = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
                size = sum(batch.nbytes for batch in held)
        if held:
            yield done(pa.Table.from_batches(held).combine_chunks())

    spread = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "rep")
    return map_batches(spread, run, "a long, b long")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """``docs`` with repeated lines removed from the text, and _n_lines and _n_dropped added.

    Lines are what newlines part. Lines without a word always stay. The others are in a group
    if their words are equal, or linked by a chain of pairs that meet under a key and whose edit
    similarity is at least ``similarity``. Pairs meet for certain if they share SHARE of the runs
    of three words of each, or in lines of up to PAIRED words PAIR_SHARE of the runs of two, or a half
    of a line of up to HALVES words; of pairs that share less, some meet: under a run of more lines
    than the first of LEVELS above 2, or under two runs of fewer. Of a group the
    occurrence with the least (id, line number) stays.

    Null texts stay null and empty ones empty, with no line dropped; a text that loses all
    its lines becomes empty, and its row stays. Very long texts and lines are read whole. A
    null id comes before all others. Rows that are equal in id and text are one document: the
    same lines stay in each. An empty table stays empty; other columns pass through, whatever
    their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    doc_id, text = docs[id_col], F.coalesce(docs[text_col].cast("string"), F.lit(""))
    kind = docs.select(doc_id.alias("id")).schema["id"].dataType.simpleString()

    def lines_of(texts: list[bytes]) -> tuple[list[int], list[int], list[bytes]]:
        places, numbers, kept = [], [], []
        for row, t in enumerate(texts):
            t = t.translate(FOLD_LINES)
            while b"  " in t:
                t = t.replace(b"  ", b" ")
            for number, line in enumerate(t.split(b"\n")):
                if line := line.strip(b" "):
                    places.append(row)
                    numbers.append(number)
                    kept.append(line)
        return places, numbers, kept

    rows = docs.select(doc_id.alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    levels = Levels(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def dealt() -> pa.RecordBatch:
            used, written = levels.deal(_sorted_set(np.concatenate(held)))
            return pa.RecordBatch.from_arrays([pa.array(used), pa.array(written, pa.binary())], names=["bucket", "values"])

        for _, texts in pieces(batches, "text", SMALL_PIECE):
            kept = list(set(lines_of(texts)[2]))
            if not kept:
                continue
            of, keys, _ = line_keys(*_hashed(kept))
            line = np.fromiter(map(xxhash.xxh3_64_intdigest, kept), np.uint64, len(kept))
            held.append(levels.values(keys, line[of]))
            size += len(keys)
            if size >= HELD_KEYS:
                yield dealt()
                held, size = [], 0
        if held:
            yield dealt()

    def level(values: pa.Table) -> pa.Table:
        flags = levels.packed(np.concatenate([levels.read(w) for w in values.column("values").to_pylist()]))
        return pa.table({"bucket": values.column("bucket").slice(0, 1), "flags": pa.array([flags], pa.binary())})

    counted = map_batches(rows.select("text"), count, "bucket long, values binary")
    found = scratch.keep(counted.groupBy("bucket").applyInArrow(level, "bucket long, flags binary"), "levels")
    flags = np.zeros((1 << levels.bucket_bits, 1 << levels.slot_bits - 2), np.uint8)
    for r in found.toLocalIterator():  # SLOTS in all
        flags[r.bucket] = np.frombuffer(r.flags, np.uint8)
    scratch.drop("levels")
    shared = spark.sparkContext.broadcast(flags)
    # Lines whose lengths allow the similarity are in one class of lengths or in neighbours.
    ratio = -math.log(max(similarity, 1e-6)) + 1e-6

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels.flags = shared.value
        for batch, texts in pieces(batches, "text", SMALL_PIECE):
            places, numbers, kept = lines_of(texts)
            if kept:
                take = pa.array(places, pa.int64())
                of, keys, kinds = line_keys(*_hashed(kept))
                of, keys, how = rare_first(of, keys, kinds, levels.of(keys))
                number = np.arange(len(kept) + 1)
                some, few = how == 0, how > 0
                lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(of[w], number), pa.int32()), pa.array(k)) for w, k in ((some, keys[some]), (few, keys[few] << 1 | (how[few] == 1)))]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("tag").take(take), pa.array(numbers, pa.int32()), pa.array([xxhash.xxh3_128_digest(k) for k in kept], pa.binary()), *lists, pa.array([len(k.decode()) for k in kept], pa.int32())], names=["id", "tag", "line", "h", "keys", "few", "size"])

    seen = scratch.keep(map_batches(rows, split, f"id {kind}, tag long, line int, h binary, keys array<long>, few array<long>, size int"), "seen")
    distinct = seen.groupBy("h").agg(F.min(F.struct("id", "line", "tag")).alias("at"), F.min("keys").alias("keys"), F.min("few").alias("few"), F.min("size").alias("size"), F.count("*").alias("n"))
    distinct = scratch.keep(distinct.withColumn("rep", F.monotonically_increasing_id()), "distinct")

    # Lines under a key and of neighbouring classes form a star around the least of them; only their texts are fetched and verified.
    keyed = distinct.select(F.explode("keys").alias("key"), F.floor(F.log("size") / ratio).cast("int").alias("class"), "rep")
    keyed = keyed.select(F.explode(F.array(F.xxhash64("key", "class"), F.xxhash64("key", F.col("class") + 1))).alias("key"), "rep")
    heads = scratch.keep(keyed.groupBy("key").agg(F.min("rep").alias("root"), F.max("rep").alias("last")).where("root < last").drop("last"), "heads")
    met = join_groups(keyed.where(may_be_in(key_filter(heads, "key"), F.col("key"))), heads, "key")
    met = met.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b"), F.lit(2).alias("alone"))
    # Under a run of few lines, each pair; under such runs alone, it has to share two of them.
    few = distinct.select(F.explode("few").alias("key"), "rep", "size")
    few = few.select(F.call_function("shiftright", "key", F.lit(1)).alias("key"), "rep", "size", F.col("key").bitwiseAND(F.lit(1)).cast("int").alias("alone"))
    pairs = met.unionByName(few_pairs(few, similarity)).groupBy("a", "b").agg(F.max("alone").alias("alone"), F.count("*").alias("n"))
    pairs = scratch.keep(pairs.where("alone > 0 or n > 1").select("a", "b", (F.col("alone") > 1).alias("star")), "pairs")
    near = scratch.keep(fewer_stars(pairs, scratch), "near")
    stars = near.select(F.col("b").alias("key"), F.col("a").alias("rep")).unionByName(near.select(F.col("b").alias("key"), F.col("b").alias("rep")).distinct())
    # A star of over LINE_CHUNK lines is cut, and each pair of its parts is a cell.
    sizes = near.groupBy(F.col("b").alias("key")).agg(F.ceil((F.count("*") + 1) / LINE_CHUNK).cast("int").alias("cuts"))
    sizes = scratch.keep(sizes.where("cuts > 1"), "sizes")
    may = may_be_in(key_filter(sizes, "key"), F.col("key"))
    cells = stars.where(may).join(sizes, "key", "left").select("key", "rep", F.coalesce("cuts", F.lit(1)).alias("cuts")).unionByName(stars.where(~may).withColumn("cuts", F.lit(1)))
    cells = cells.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    cell = F.struct("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    cells = scratch.keep(cells.groupBy("rep").agg(F.collect_list(cell).alias("cells")), "cells")
    nodes = join_groups(distinct.select("rep", "at"), cells, "rep").select("rep", F.col("at.id").alias("id"), F.col("at.tag").alias("tag"), F.col("at.line").alias("line"), "cells")
    # A document is fetched once, with the numbers of all its lines that are wanted.
    wanted = scratch.keep(nodes.groupBy("id", "tag").agg(F.collect_list(F.struct("line", "rep", "cells")).alias("wanted")), "wanted")
    source = rows.where(may_be_in(key_filter(wanted, "tag"), F.col("tag")))
    fetched = wanted.join(source, wanted["id"].eqNullSafe(source["id"]) & (wanted["tag"] == source["tag"])).select("wanted", "text")

    def payloads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()  # rows that are equal in id and text give a line twice
        for batch, texts in pieces(batches, "text"):
            lists = batch.column("wanted")
            flat = lists.flatten()
            split_texts = [t.split(b"\n") for t in texts]
            of = np.repeat(np.arange(batch.num_rows), np.array(lists.value_lengths()))
            reps = flat.field("rep").to_pylist()
            new = [k for k, rep in enumerate(reps) if rep not in given]
            given.update(reps)
            numbers, cells_of = flat.field("line").to_pylist(), flat.field("cells")
            for at in range(0, len(new), BATCH_ROWS):
                some = new[at : at + BATCH_ROWS]
                part = [b" ".join(normalised(split_texts[of[k]][numbers[k]])) for k in some]
                cells = cells_of.take(pa.array(some, pa.int64()))
                columns = [pa.array([reps[k] for k in some], pa.int64()), pa.array(simhashes(*_hashed(part)), pa.binary()), pa.array([line.decode() for line in part], pa.string()), cells]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "fp", "payload", "cells"])

    placed = map_batches(fetched, payloads, "rep long, fp binary, payload string, cells array<struct<key: long, low: int, high: int>>")
    verified = verified_links(placed.select(F.explode("cells").alias("cell"), "rep", "fp", "payload").select("cell.*", "rep", "fp", "payload"), similarity)
    groups = components(verified, scratch, "verified")
    scratch.drop("pairs", "least", "near", "sizes", "cells", "wanted", "heads")

    # One row per distinct line that occurs twice or has a partner: where the group's line stays.
    marked = distinct.join(groups, distinct["rep"] == groups["node"], "left").withColumn("g", F.coalesce("component", "rep"))
    marked = scratch.keep(marked.where("component is not null or n > 1").select("h", "g", "at"), "marked")
    stays = marked.groupBy("g").agg(F.min("at").alias("stay"))
    lines = join_groups(marked, scratch.keep(stays, "stays"), "g").select("h", "stay")
    there = seen.where(may_be_in(key_filter(marked, "h"), F.col("h"))).select("id", "tag", "line", "h")
    gone = join_groups(there, scratch.keep(lines, "lines"), "h")
    gone = gone.where(~(F.col("id").eqNullSafe(F.col("stay.id")) & (F.col("line") == F.col("stay.line")) & (F.col("tag") == F.col("stay.tag"))))
    gone = scratch.keep(gone.groupBy("id", "tag").agg(F.collect_set("line").alias("gone")), "gone")
    scratch.drop("seen", "distinct", "marked", "stays", "lines")

    # Only documents that lose lines meet the list of those; the others pass by.
    tagged = docs.withColumn("_tag", F.xxhash64(text))
    may = may_be_in(key_filter(gone, "tag"), F.col("_tag"))
    gone = gone.select(F.col("id").alias("_id"), F.col("tag").alias("_gone_tag"), F.col("gone").alias("_gone"))
    losers = tagged.where(may).join(gone, doc_id.eqNullSafe(F.col("_id")) & (F.col("_tag") == F.col("_gone_tag")), "left")
    n_lines = F.size(F.split(text, "\n", -1)).cast("long").alias("_n_lines")
    dropped = F.coalesce(F.size("_gone").cast("long"), F.lit(0).cast("long")).alias("_n_dropped")

    at = docs.columns.index(text_col)

    def thin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, lost in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if t is not None and lost:
                    lost = set(lost)
                    t = "\n".join([line for n, line in enumerate(t.split("\n")) if n not in lost])
                out.append(t)
            columns = batch.columns[:-1]
            columns[at] = pa.array(out, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    # Columns go by their place, as any name may be among them.
    held = [*(docs[c] for c in docs.columns), n_lines, dropped, F.col("_gone")]
    placed = losers.select(*(c.alias(f"c{i}") for i, c in enumerate(held)))
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(placed.schema.fields[:-1]))
    thinned = map_batches(placed, thin, kinds).toDF(*docs.columns, "_n_lines", "_n_dropped")
    others = tagged.where(~may).select(*(docs[c] for c in docs.columns), n_lines, F.lit(0).cast("long").alias("_n_dropped"))
    return thinned.unionByName(others)
