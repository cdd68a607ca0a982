"""Removal of repeated substrings by a prefix-free parse of the corpus.

The parse: a rolling hash of GRAM bytes triggers phrase ends, about every PHRASE bytes. A
phrase runs on over the last strings that start in it, so every string of the given length
lies in one phrase, and equal stretches of text give equal phrases wherever they stand. The
dictionary keeps the smallest document of each distinct phrase. A phrase that a smaller
document has goes as a whole, so that copies cost one row a phrase and no more.

The dictionary: what is left are phrases at their smallest document, and those that differ
somewhere. Their suffixes are sorted in buckets: every string belongs to the bucket of the
least gram hash in it, so equal strings meet in one. Buckets whose hash stands in one phrase
only are left out beforehand, by a bit set of bounded size that never misses a shared one. In a
bucket the suffixes, cut at the string's length, are sorted, and equal ones take the smallest
document that the parse has for any of them. That is the corpus order as far as it is needed:
suffixes that agree on a whole string are equal here, so the order of the parse itself beyond
that string decides nothing, and no suffix array of the parse is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import integer_ids, map_batches, texts
from quarry.llm.hashing import BASE, mix, powers
from quarry.storage import Scratch, join_groups, key_filter, may_be_in

#: Bytes of text to a phrase, on average; a power of two.
PHRASE = 128
#: Long enough that texts seldom share a gram by chance, short enough for few triggers.
GRAM = 28
#: Bits of the sets of triggers: 16 MB, and up to 64 MB for over 2 GB of text that is left after whole phrases.
SIEVE_BITS = (27, 29)
#: Bytes of text whose triggers one bucket of the sieve holds, about.
BUCKET_BYTES = 8 << 20
#: Bytes of a trigger's hash that the sieve is made from.
SHORT = 5
#: Bytes handled at a time, few enough for a core's cache; longer texts are cut, with an overlap of one string.
PIECE = 1 << 18
#: Rows of buckets sorted at a time, and phrases of a bucket from which on its strings are spread over the cluster.
SORTED, HOT_PHRASES = 5_000, 20_000


def gram_values(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of GRAM bytes."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    symbols = mix(np.arange(1, 257, dtype=np.uint64))[data]
    steps = powers(BASE, GRAM + 1)
    # By doubling: 2 bytes, 4, 8, 16, and then the 8 and 4 that are left.
    two = symbols[:-1] * steps[1] + symbols[1:]
    four = two[:-2] * steps[2] + two[2:]
    eight = four[:-4] * steps[4] + four[4:]
    sixteen = eight[:-8] * steps[8] + eight[8:]
    return mix((sixteen[:n] * steps[8] + eight[16 : 16 + n]) * steps[4] + four[24 : 24 + n])


def triggers(values: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each string start, the place of its trigger: the least gram hash in it, the rightmost of equals."""
    w = length - GRAM + 1
    # Hash and place in one number, so that a minimum carries its place along.
    low = (values >> np.uint64(24) << np.uint64(24)) | (np.uint64((1 << 24) - 1) - np.arange(len(values), dtype=np.uint64))
    width = 1
    while width < w:
        step = min(width, w - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return (np.uint64((1 << 24) - 1) - (low[starts] & np.uint64((1 << 24) - 1))).astype(np.int64)


def cut(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of text: bytes, the starts of whole strings, and per byte its row and its place there.

    Rows are (batch number, row) packed; a string never crosses texts.
    """
    held, rows, places, size = [], [], [], 0

    def done():
        data = np.frombuffer(b"".join(held), np.uint8)
        lengths = np.array([len(h) for h in held])
        first = np.cumsum(lengths) - lengths
        counts = np.maximum(lengths - length + 1, 0)
        starts = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return data, starts, np.repeat(np.array(rows), lengths), np.repeat(np.array(places) - first, lengths) + np.arange(len(data))

    for number, batch in enumerate(batches):
        for row, text in enumerate(texts(batch.column("text"))):
            for at in range(0, max(1, len(text) - length + 1), PIECE):
                part = text[at : at + PIECE + length - 1]
                if len(part) < length:
                    continue
                held.append(part)
                rows.append(number << 32 | row)
                places.append(at)
                size += len(part)
                if size >= PIECE:
                    yield done()
                    held, rows, places, size = [], [], [], 0
    if held:
        yield done()


def phrases_of(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per phrase of a piece: the hash of its trigger, its first and its last string start."""
    values = gram_values(data)
    at = triggers(values, starts, length)
    new = np.flatnonzero(np.diff(at, prepend=-1) | (np.diff(starts, prepend=-2) != 1))
    return values[at[new]], starts[new], starts[np.append(new[1:], len(starts)) - 1]


class Seen:
    """The columns of the batches that went by, but for their texts."""

    def __init__(self):
        self.batches: list[pa.RecordBatch] = []

    def watch(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            self.batches.append(batch.drop_columns("text"))
            yield batch

    def of(self, packed: np.ndarray) -> list[np.ndarray]:
        """The columns' values for rows as ``cut`` packs them."""
        out = []
        number = np.cumsum([0] + [b.num_rows for b in self.batches])[packed >> 32] + (packed & 0xFFFFFFFF)
        for column in range(self.batches[0].num_columns):
            out.append(np.concatenate([b.column(column).to_numpy() for b in self.batches])[number])
        return out


def sieve_bits(text_bytes: int) -> int:
    """Bits of the sets of triggers for so much text; a set that is too full misses nothing and lets more through."""
    return min(max((text_bytes // 8).bit_length(), SIEVE_BITS[0]), SIEVE_BITS[1])


def _in_sieve(sieve: np.ndarray, hashes: np.ndarray, shift: np.uint64, bits: int, all_bits: int) -> np.ndarray:
    bit = ((hashes >> np.uint64(64 - all_bits)) % np.uint64(bits)).astype(np.int64)
    return sieve[(hashes >> shift).astype(np.int64), bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes).

    A byte goes if a string of ``length`` bytes that covers it also starts in a document
    with a smaller id; strings are judged on the input. n_spans counts maximal removed runs.
    Ids are integers, since documents are ordered by them; another type raises TypeError, and a
    length that one word of flags can't hold (outside GRAM to GRAM + 63) raises ValueError.

    Null and empty texts have no bytes; very long ones are handled in overlapping pieces. Rows
    with equal ids are one document: neither is smaller. A row with a null id loses nothing and
    takes nothing from others. An empty table gives no rows; other columns are ignored.
    """
    if not GRAM <= length < GRAM + 64:
        raise ValueError(f"length is {GRAM} to {GRAM + 63}, not {length}")
    integer_ids(docs, id_col)
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    text = F.encode(F.coalesce(docs[text_col].cast("string"), F.lit("")), "utf-8")
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    whole_rows = rows.where(F.col("id").isNotNull() & (F.length("text") >= length))

    def phrases(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for data, starts, row_of, place in cut(seen.watch(batches), length):
            ends = (gram_values(data)[starts] & np.uint64(PHRASE - 1)) == 0
            ends[1:] |= np.diff(starts) != 1  # the next text
            ends[:1] = True
            first = np.flatnonzero(ends)
            last = np.append(first[1:], len(starts)) - 1
            view = memoryview(data.tobytes())
            names = b"".join([xxhash.xxh3_128_digest(view[a : b + length]) for a, b in zip(starts[first].tolist(), starts[last].tolist())])
            high, low = np.frombuffer(names, "<i8").reshape(-1, 2).T
            ids, tags = seen.of(row_of[starts[first]])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, tags, place[starts[first]], last - first + 1, np.ascontiguousarray(high), np.ascontiguousarray(low))], names=["id", "tag", "at", "strings", "high", "low"])

    parse = scratch.keep(map_batches(whole_rows, phrases, "id long, tag long, at long, strings long, high long, low long"), "parse")
    # Names are 128-bit hashes. Phrases of one document only need no row.
    dictionary = parse.groupBy("high", "low").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    repeated = parse.join(scratch.keep(dictionary, "phrases"), ["high", "low"]).where("id > least")
    repeated = scratch.keep(repeated.groupBy("id", "tag").agg(F.collect_set(F.struct("at", "strings")).alias("gone")), "repeated")
    scratch.drop("parse", "phrases")

    def remains(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text, its stretches whose strings are in no repeated phrase, overlapping those by a string less one byte."""
        for batch in batches:
            at, parts, base = [], [], []
            for i, (data, gone) in enumerate(zip(batch.column("text").to_pylist(), batch.column("gone"))):
                edges = np.array([0, len(data) - length + 1])
                if gone.is_valid:
                    marks = np.zeros(len(data) - length + 2, np.int32)
                    begin, count = (np.array(gone.values.field(f), np.int64) for f in ("at", "strings"))
                    np.add.at(marks, begin, 1)
                    np.add.at(marks, begin + count, -1)
                    left = np.concatenate([[False], np.cumsum(marks[:-1]) == 0, [False]])
                    edges = np.flatnonzero(left[1:] != left[:-1])
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    at.append(i)
                    base.append(a)
                    parts.append(data[a : b + length - 1])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("tag").take(take), pa.array(base, pa.int64()), pa.array(parts, pa.binary())], names=["id", "tag", "base", "text"])

    listed = whole_rows.join(repeated, ["id", "tag"], "left").select("id", "tag", "text", "gone")
    long_rows = scratch.keep(map_batches(listed, remains, "id long, tag long, base long, text binary"), "remains")
    total = long_rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = 1 << max(6, int(total // BUCKET_BYTES).bit_length())
    shift = np.uint64(64 - buckets.bit_length() + 1)
    all_bits = sieve_bits(total)

    def count_triggers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, starts, row_of, _ in cut(batches, length):
            values = gram_values(data)
            at = np.unique(triggers(values, starts, length))
            # Once per text; a hash that a second text of the piece has stands there twice.
            both = np.unique(np.stack([values[at], row_of[at].astype(np.uint64)], axis=1), axis=0)[:, 0]
            bounds = np.searchsorted(both >> shift, np.arange(buckets + 1, dtype=np.uint64))
            used = np.flatnonzero(bounds[1:] > bounds[:-1])
            # The first 40 bits will do for a sieve.
            short = both.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SHORT]
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([short[bounds[b] : bounds[b + 1]].tobytes() for b in used], pa.binary())], names=["bucket", "hashes"])

    bits = (1 << all_bits) // buckets

    def share(table: pa.Table) -> pa.Table:
        short = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint8).reshape(-1, SHORT)
        whole = np.zeros((len(short), 8), np.uint8)
        whole[:, :SHORT] = short
        hashes = whole.view(">u8").ravel().astype(np.uint64)
        hashes.sort()
        again = hashes[1:][hashes[1:] == hashes[:-1]]
        flags = np.zeros(max(8, bits), bool)
        flags[((again >> np.uint64(64 - all_bits)) % np.uint64(bits)).astype(np.int64)] = True
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "flags": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    counted = map_batches(long_rows.select("text"), count_triggers, "bucket long, hashes binary")
    sieve = np.zeros((buckets, max(8, bits) // 8), np.uint8)
    for r in counted.groupBy("bucket").applyInArrow(share, "bucket long, flags binary").toLocalIterator():  # all_bits in all
        sieve[r.bucket] = np.frombuffer(r.flags, np.uint8)
    shared = spark.sparkContext.broadcast(sieve)
    del sieve

    def parse_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, may = Seen(), shared.value
        for data, starts, row_of, place in cut(seen.watch(batches), length):
            h, first, last = phrases_of(data, starts, length)
            keep = np.flatnonzero(_in_sieve(may, h, shift, bits, all_bits))
            if len(keep):
                whole = data.tobytes()
                names = np.array([xxhash.xxh3_64_intdigest(whole[a : b + length]) for a, b in zip(first[keep].tolist(), last[keep].tolist())], np.uint64)
                ids, tags, base = seen.of(row_of[first[keep]])
                columns = [pa.array(ids), pa.array(tags), pa.array(place[first[keep]] + base), pa.array((last - first + 1)[keep]), pa.array(h[keep].view(np.int64)), pa.array(names.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "tag", "at", "strings", "trigger", "name"])

    parsed = scratch.keep(map_batches(long_rows, parse_buckets, "id long, tag long, at long, strings long, trigger long, name long"), "parsed")
    # A phrase goes by the 64-bit hashes of its trigger and of all its bytes.
    dictionary = parsed.groupBy("trigger", "name").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    dictionary = scratch.keep(dictionary, "dictionary")

    # Only triggers of several phrases need the phrases themselves: a second sieve, and a second pass.
    several = scratch.keep(dictionary.groupBy("trigger").agg(F.count("*").alias("k")).where("k > 1"), "several")
    place = F.call_function("shiftrightunsigned", F.col("trigger"), F.lit(64 - all_bits))
    slots = several.groupBy((place / 64).cast("long").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("b"))
    shared.unpersist()
    second = np.zeros(1 << all_bits - 6, np.int64)
    for r in slots.toLocalIterator():  # all_bits in all
        second[r.w] = r.b
    again = spark.sparkContext.broadcast(second.view(np.uint8))
    del second

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = again.value
        for data, starts, _, _ in cut(batches, length):
            h, first, last = phrases_of(data, starts, length)
            bit = (h >> np.uint64(64 - all_bits)).astype(np.int64)
            keep = np.flatnonzero(may[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
            if len(keep):
                whole = data.tobytes()
                found = {}
                for trigger, a, b in zip(h[keep].tolist(), first[keep].tolist(), last[keep].tolist()):
                    phrase = whole[a : b + length]
                    found[trigger, xxhash.xxh3_64_intdigest(phrase)] = phrase
                keys = np.array(list(found), np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(list(found.values()), pa.binary())], names=["trigger", "name", "phrase"])

    spelt = map_batches(long_rows.select("text"), spell, "trigger long, name long, phrase binary").groupBy("trigger", "name").agg(F.min("phrase").alias("phrase"))
    spelt = scratch.keep(join_groups(dictionary, several, "trigger").join(spelt, ["trigger", "name"]).select("trigger", "name", "least", "phrase", "k"), "spelt")

    def order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by trigger. inner: bits of the strings that a smaller document has in another phrase."""
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            trigger = table.column("trigger").to_numpy()
            again = np.zeros(len(trigger), bool)
            again[1:] = trigger[1:] == trigger[:-1]
            again[:-1] |= again[1:]
            part = table.filter(pa.array(again))
            if not part.num_rows:
                return
            phrases, least = part.column("phrase").to_pylist(), part.column("least").to_numpy()
            counts = np.array([len(p) - length + 1 for p in phrases])
            of = np.repeat(np.arange(len(phrases)), counts)
            offset = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            data, begin = np.frombuffer(b"".join(phrases), np.uint8), np.cumsum(counts + length - 1) - (counts + length - 1)
            suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[begin[of] + offset])
            _, group = np.unique(suffixes.view(f"V{length}").ravel(), return_inverse=True)  # sorted suffixes, cut at the string's length
            smallest = np.full(group.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(smallest, group, least[of])
            inner = np.zeros(len(phrases), np.int64)
            np.bitwise_or.at(inner, of, np.where(smallest[group] < least[of], np.left_shift(np.int64(1), offset), 0))
            some = np.flatnonzero(inner)
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(some)).combine_chunks() for c in ("trigger", "name")), pa.array(inner[some])], names=["trigger", "name", "inner"])

        count = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= SORTED:
                table = pa.Table.from_batches(held)
                trigger = table.column("trigger").to_numpy()
                edge = np.flatnonzero(trigger[1:] != trigger[:-1])
                end = int(edge[-1]) + 1 if len(edge) else 0
                yield from done(table.slice(0, end))
                held, count = table.slice(end).combine_chunks().to_batches(), table.num_rows - end
        if held:
            yield from done(pa.Table.from_batches(held))

    hot = F.col("k") > HOT_PHRASES
    ordered = spelt.where(~hot).select("trigger", "name", "least", "phrase").repartition("trigger").sortWithinPartitions("trigger")
    inner = map_batches(ordered, order, "trigger long, name long, inner long")

    def strings_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, phrase in enumerate(batch.column("phrase").to_pylist()):
                n = len(phrase) - length + 1
                high, low = np.frombuffer(b"".join([xxhash.xxh3_128_digest(phrase[o : o + length]) for o in range(n)]), "<i8").reshape(-1, 2).T
                take = pa.array(np.full(n, row))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("trigger", "name", "least")), pa.array(np.arange(n)), pa.array(np.ascontiguousarray(high)), pa.array(np.ascontiguousarray(low))], names=["trigger", "name", "least", "o", "high", "low"])

    # A bucket of very many phrases is not sorted in one place: its strings meet by 128-bit hashes, summed up on the way.
    strings = scratch.keep(map_batches(spelt.where(hot), strings_of, "trigger long, name long, least long, o long, high long, low long"), "strings")
    smallest = scratch.keep(strings.groupBy("high", "low").agg(F.min("least").alias("first")), "smallest")
    earlier = join_groups(strings, smallest, ["high", "low"]).where("first < least")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("o").cast("int"))
    inner = inner.unionByName(earlier.groupBy("trigger", "name").agg(F.bit_or(bit).alias("inner")))
    known = dictionary.join(inner, ["trigger", "name"], "left").where("n > 1 or inner is not null")
    key = F.struct("trigger", "name").alias("key")
    known = scratch.keep(known.select(key, "least", "n", F.coalesce("inner", F.lit(0).cast("long")).alias("inner")), "known")
    scratch.drop("dictionary", "several", "spelt", "strings", "smallest")

    found = parsed.select("id", "tag", "at", key, "strings")
    found = join_groups(found.where(may_be_in(key_filter(known, "key"), F.col("key"))), known, "key")
    every = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("strings").cast("int")) - 1
    hit = found.select("id", "tag", "at", F.when(F.col("id") > F.col("least"), every).otherwise(F.col("inner")).alias("hit")).where("hit != 0")
    # Whole phrases have a count of strings, and buckets have flags.
    some = hit.select("id", "tag", F.struct("at", F.lit(0).cast("long").alias("strings"), "hit").alias("h"))
    some = some.unionByName(repeated.select("id", "tag", F.explode("gone").alias("g")).select("id", "tag", F.struct("g.at", "g.strings", F.lit(0).cast("long").alias("hit")).alias("h")))
    hits = scratch.keep(some.groupBy("id", "tag").agg(F.collect_set("h").alias("hits")), "hits")
    scratch.drop("parsed", "known", "repeated", "remains")

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, hits_of in zip(batch.column("text").to_pylist(), batch.column("hits")):
                n, spans, kept = 0, 0, data
                if hits_of.is_valid:
                    marks = np.zeros(len(data) + 1, np.int32)
                    at = np.array(hits_of.values.field("at"), np.int64)
                    strings, bit = (np.array(hits_of.values.field(f), np.int64) for f in ("strings", "hit"))
                    np.add.at(marks, at[strings > 0], 1)
                    np.add.at(marks, (at + strings + length - 1)[strings > 0], -1)
                    for o in range(length - GRAM + 1):
                        begin = at[bit >> o & 1 == 1] + o
                        np.add.at(marks, begin, 1)
                        np.add.at(marks, begin + length, -1)
                    gone = np.cumsum(marks[:-1]) > 0
                    n, spans = int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((len(data), n, spans, kept))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    may = may_be_in(key_filter(hits, "tag"), F.col("tag")) & F.col("id").isNotNull()
    listed = rows.where(may).join(hits, ["id", "tag"], "left").select("id", "text", "hits")
    out = map_batches(listed, finish, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    zero = F.lit(0).cast("long")
    others = rows.where(~may).select("id", F.length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").alias("kept"))
    return out.unionByName(others).withColumnRenamed("id", id_col)
