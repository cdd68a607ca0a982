"""SimHash near-dedup with bit-sliced comparison of fingerprints.

Fingerprints that share a block of bits meet in a bucket. Inside a bucket they are held
as vertical bit planes (one large integer a bit position, one bit a fingerprint), so that
one step of a carry-save counter updates the distances of thousands of pairs; a block of
pairs is given up as soon as all of them are beyond the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import integer_ids, map_batches, pieces
from quarry.llm.components import components
from quarry.llm.hashing import BASE, mix
from quarry.storage import Scratch, join_groups, key_filter, may_be_in

SEED = 42
#: Fingerprints of one bucket compared by one task at most: larger buckets are cut into chunks, and each pair of chunks is a task's.
CHUNK = 4096
#: The same where a whole group by distance is verified; its rows link up early.
GROUP_CHUNK = 8 * CHUNK


def shingles(text: bytes, words: int) -> Iterator[bytes]:
    """Word shingles of a text in order, repeats included; a shorter text is one shingle."""
    found = text.lower().split()  # bytes: A-Z alone are lowered, and ASCII white space alone splits
    if 0 < len(found) < words:
        return iter([b" ".join(found)])
    return map(b" ".join, zip(*(found[i:] for i in range(words))))


def fingerprint(text: bytes, words: int = 4, bits: int = 64, bands: tuple[int, int] | None = None) -> tuple[bytes, int, list[int]]:
    """The fingerprint (big-endian), the number of shingles, and the band keys; no words give zero bits.

    A bit is 1 if it is set in over half the shingles' hashes. The first 64 bits use XXH64;
    further ones use rehashes of it. ``bands`` (how many, hashes in each) asks for keys: each
    is made of so many least hashes under as many orders of the shingles, so that two texts
    agree on one with the power of their Jaccard similarity.
    """
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles(text, words), repeat(SEED)), np.uint64)
    counts = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        wide = np.stack([part, *(mix(part + np.uint64(0x9E3779B97F4A7C15 * j % 2**64)) for j in range(1, bits // 64))], axis=1)
        counts += np.unpackbits(wide.astype(">u8").view(np.uint8).reshape(len(part), bits // 8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(hashes)).tobytes(), len(hashes), band_keys(hashes, *bands) if bands else []


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """A 63-bit key for each band of ``rows`` least hashes; texts without shingles share all of theirs."""
    orders = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        # An odd factor permutes; the upper half then orders, and ties in it are as good as equal.
        np.minimum(least, ((hashes[at : at + 4096, None] * orders) >> np.uint64(24)).min(axis=0), out=least)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for row in least.reshape(bands, rows).T:
        key = mix(key * np.uint64(BASE) + row)
    return (key >> np.uint64(1)).tolist()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, bits: int, bands: tuple[int, int] | None = None) -> DataFrame:
    """(id, tag, fp binary, size, keys) of every row: tag hashes the text, size counts shingles. Null text has no words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            made = [fingerprint(t, words, bits, bands) for t in texts]
            found = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.binary(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), *found], names=["id", "tag", "fp", "size", "keys"])

    return map_batches(_rows(docs, id_col, text_col), run, "id long, tag long, fp binary, size long, keys array<long>")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def pigeonhole(bits: int, radius: int, kept: int = 2) -> list[np.ndarray]:
    """Bit positions of each key: every choice of ``kept`` of radius + ``kept`` blocks.

    Fingerprints within the radius differ in at most ``radius`` blocks, so they agree in one key at least.
    """
    blocks = np.array_split(np.arange(bits), radius + kept)
    return [np.concatenate(c) for c in combinations(blocks, kept)]


def _bit_rows(column: pa.Array, bits: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), bits // 8), axis=1)


def _close(planes: list[int], shift: int, alive: int, radius: int) -> int:
    """Of the pairs (i, i + shift) flagged in ``alive``, those that differ in at most ``radius`` planes."""
    width = (radius + 1).bit_length()
    offset = (1 << width) - 1 - radius  # a counter that starts here overflows at radius + 1
    counter = [alive if offset >> k & 1 else 0 for k in range(width)]
    for k in range(0, len(planes) - 1, 2):
        x, y = planes[k] ^ (planes[k] >> shift), planes[k + 1] ^ (planes[k + 1] >> shift)
        # A full adder takes two planes into the lowest counter plane and one carry.
        both = counter[0] ^ x
        carry = (counter[0] & x) | (both & y)
        counter[0] = both ^ y
        for place in range(1, width):
            if not carry:
                break
            counter[place], carry = counter[place] ^ carry, counter[place] & carry
        alive &= ~carry
        if not alive:
            return 0
    return alive


def _flags(mask: np.ndarray) -> int:
    return int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")


def link_block(group: np.ndarray, bit_rows: np.ndarray, radius: int, verify: Callable[[int, int], bool] | None = None) -> np.ndarray:
    """For rows sorted by group: the first row that each row's links within its group lead to.

    With ``verify``, a pair within the radius links only if that is true of its two rows.
    """
    n = len(group)
    planes = [int.from_bytes(row.tobytes(), "little") for row in np.packbits(bit_rows.T, axis=1, bitorder="little")]
    root = np.arange(n)
    for shift in range(1, n):
        same = group[:-shift] == group[shift:]
        if not same.any():
            break
        same &= root[:-shift] != root[shift:]  # linked already
        if not same.any():
            continue
        close = _close(planes, shift, _flags(same), radius)
        if not close:
            continue
        left = np.flatnonzero(np.unpackbits(np.frombuffer(close.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little"))
        for i in left:
            a, b = root[i], root[i + shift]
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b and (verify is None or verify(int(i), int(i) + shift)):
                root[max(a, b)] = min(a, b)
        while (root[root] != root).any():
            root = root[root]
    return root


def under_keys(prints: DataFrame, keys: list[np.ndarray], bits: int) -> DataFrame:
    """(key, rep, fp) and any payload: each row of ``prints`` once for every key."""
    extra = [c for c in prints.columns if c == "payload"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _bit_rows(batch.column("fp"), bits)
            for number, places in enumerate(keys):
                weights = np.left_shift(np.int64(1), np.arange(len(places), dtype=np.int64))
                key = rows[:, places].astype(np.float64) @ weights  # exact below 2**53
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64) + (number << 48)), *(batch.column(c) for c in ("rep", "fp", *extra))], names=["key", "rep", "fp", *extra])

    return map_batches(prints.select("rep", "fp", *extra), run, "key long, rep long, fp binary" + ", payload string" * bool(extra))


def links(keyed: DataFrame, bits: int, radius: int, prepare: Callable[[str], object] | None = None, verify: Callable[[object, object], bool] | None = None, chunk: int | None = None, link: Callable[[np.ndarray, pa.Table], np.ndarray] | None = None) -> DataFrame:
    """(a, b): links between rows (key, rep long, fp binary) that meet under a key and differ in at most
    ``radius`` bits; enough of them to connect what all such links connect.

    With ``verify``, rows also have a ``payload`` string, and a link needs it to be true of
    what ``prepare`` makes of both payloads. ``link`` takes the place of all that: it gets the rows
    with their ``payload`` and the number of each row's group, and returns what ``link_block`` does.
    ``keyed`` is read twice. Keys with over ``chunk`` rows are cut.
    """
    chunk = chunk or CHUNK
    extra = ["payload"] if verify or link else []

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> pa.RecordBatch:
            columns = [table.column(c).to_numpy() for c in ("key", "low", "high")]
            new = np.zeros(table.num_rows, bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            rep = table.column("rep").to_numpy()
            values, made = table.column("payload") if extra else None, {}

            def value(i: int) -> object:
                if i not in made:
                    made[i] = prepare(values[i].as_py())
                return made[i]

            if link:
                root = link(np.cumsum(new), table)
            else:
                root = link_block(np.cumsum(new), _bit_rows(table.column("fp"), bits), radius, verify and (lambda i, j: verify(value(i), value(j))))
            linked = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[root[linked]])], names=["a", "b"])

        count = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= 2 * CHUNK:
                table = pa.Table.from_batches(held)
                key = [table.column(c).to_numpy() for c in ("key", "low", "high")]
                # The last group may go on in the next batch.
                last = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in key]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield done(table.slice(0, cut).combine_chunks())
                held, count = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
        if held:
            yield done(pa.Table.from_batches(held).combine_chunks())

    buckets = Scratch(keyed.sparkSession, "links").keep(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    # Most keys have one row, which the filter keeps out of the shuffle.
    cells = join_groups(keyed.where(may_be_in(key_filter(buckets, "key"), F.col("key"))), buckets, "key").withColumn("cuts", F.ceil(F.col("n") / chunk).cast("int"))
    cells = cells.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    cells = cells.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "rep", "fp", *extra)
    spread = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "fp")
    return map_batches(spread, compare, "a long, b long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 64, radius: int = 4, keys: list[np.ndarray] | None = None, bands: tuple[int, int] | None = None, similarity: float | None = None) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (hex), component_id.

    Fingerprints link at ``radius`` or fewer differing bits if they agree on one of ``keys``;
    the default keys find every such pair. component_id is the smallest id that links reach
    from the row, its own included. With ``bands``, keys of least hashes of the shingles take
    the place of keys of bits, for radii too wide for those. With ``similarity``, a link also
    needs the sets of shingles to be that similar (Jaccard): groups by distance alone are taken
    first, and pairs inside them are verified on the texts until all that pass are connected.

    Null and empty texts have no words; their fingerprint is zero and links like any other.
    Equal texts share a fingerprint, so copies and repeated rows cost one comparison. Rows
    with a null id are in no link; their component_id is their fingerprint's (with
    ``similarity``, their text's), or null if none has it. Ids are integers, since the smallest
    one names a group; another type raises TypeError. Very long texts are hashed in parts, all of
    them. An empty table gives no rows; other columns are ignored.
    """
    integer_ids(docs, id_col)
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, id_col, text_col, words, bits, bands), "prints")
    # Where texts decide, texts that only share a fingerprint are apart.
    own = ["fp"] if similarity is None else ["fp", "own"]
    if similarity is not None:
        prints = prints.withColumn("own", F.concat_ws(" ", F.hex("fp"), "tag"))
    distinct = prints.groupBy(*own).agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "tag"))).alias("at"), F.min("keys").alias("keys"))
    distinct = scratch.keep(distinct.select(*own, F.col("at.id").alias("rep"), F.col("at.tag").alias("tag"), "keys"), "distinct")
    linked = distinct.where(F.col("rep").isNotNull())
    if bands:
        found = components(links(linked.select(F.explode("keys").alias("key"), "rep", "fp"), bits, radius), scratch, "near")
    else:
        keyed = scratch.keep(under_keys(linked, keys or pigeonhole(bits, radius), bits), "keyed")
        found = components(links(keyed, bits, radius), scratch, "near")
        scratch.drop("keyed")
    if similarity is not None:
        nodes = scratch.keep(found.join(distinct, found["node"] == distinct["rep"]).select(F.col("component").alias("key"), "rep", "fp", "tag"), "nodes")
        source = _rows(docs, id_col, text_col)
        source = source.where(may_be_in(key_filter(nodes, "rep"), F.col("id"))).dropDuplicates(["id", "tag"])
        texts = nodes.join(source, (nodes["rep"] == source["id"]) & (nodes["tag"].eqNullSafe(source["tag"])))
        keyed = scratch.keep(texts.select("key", "rep", "fp", F.coalesce("text", F.lit("")).alias("payload")), "texts")
        prepare = lambda text: frozenset(map(xxhash.xxh64_intdigest, shingles(text.encode(), words), repeat(SEED)))
        verify = lambda a, b: len(a & b) >= similarity * len(a | b)
        found = components(links(keyed, bits, radius, prepare, verify, GROUP_CHUNK), scratch, "verified")
        scratch.drop("texts")
    reached = distinct.join(found, distinct["rep"] == found["node"], "left").select(own[-1], F.coalesce("component", "rep").alias("component_id"))
    result = join_groups(prints, scratch.keep(reached, "reached"), own[-1])
    return result.select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
