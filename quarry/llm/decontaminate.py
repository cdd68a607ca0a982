"""Benchmark decontamination by winnowing.

Of the hashes of all runs of GRAM words, the least in each window of runs is kept as a
fingerprint. A window spans exactly ``span`` words, so two texts that share ``span``
consecutive words share a fingerprint at the same place of them. Fingerprints of documents
and benchmark items are joined; each hit gives a diagonal (document word minus item word),
along which the texts themselves are compared word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import map_batches, pieces, texts
from quarry.llm.hashing import gram_hashes, span_hashes, window_min, word_spans, word_table
from quarry.storage import Scratch

GRAM = 5
#: Letters, digits and everything beyond ASCII make words.
WORD = word_table(lambda b: b >= 128 or chr(b).isalnum())
#: Bits of the set of benchmark fingerprints that goes to every task; a fixed 2 MB.
SIEVE_BITS = 24


def _sieve(prints: DataFrame) -> np.ndarray:
    """A bit set of fixed size over the fingerprints: which of them may be of the benchmark."""
    place = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(64 - SIEVE_BITS))
    words = prints.groupBy((place / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("b"))
    out = np.zeros(1 << SIEVE_BITS - 6, np.int64)
    for row in words.toLocalIterator():  # at most 2**18 rows, whatever the benchmark
        out[row.w] = row.b
    return out.view(np.uint8)


def _fingerprints(data, starts, ends, text_of, n_texts: int, span: int, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per fingerprint: text number, word position in its text, hash. Then words per text, first word of each text."""
    hashes = span_hashes(data, starts, ends)
    counts = np.bincount(text_of, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    found = []
    w = span - GRAM + 1
    grams = gram_hashes(hashes, GRAM)
    at = window_min(grams, w)
    if len(at):
        whole = text_of[: len(at)] == text_of[span - 1 :]  # the window's words lie in one text
        at = np.unique(at[whole])
        found.append((at, grams[at]))
    for m in lengths:  # items shorter than a window count as a whole
        short = gram_hashes(hashes, m)
        at = np.flatnonzero(text_of[: len(short)] == text_of[m - 1 :]) if len(short) else np.zeros(0, int)
        found.append((at, short[at] + np.uint64(m)))
    at = np.concatenate([f[0] for f in found]) if found else np.zeros(0, int)
    fp = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64)
    return text_of[at], at - first[text_of[at]], fp, counts, first


def words_of(text: bytes) -> list[bytes]:
    data, starts, ends, _ = word_spans([text], WORD)
    whole = data.tobytes()
    return [whole[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


def _mark(doc: list[bytes], item: list[bytes], diagonal: int, span: int, hit: np.ndarray) -> bool:
    """Flags the document words in windows of the item along one diagonal; true if there are any."""
    need = min(span, len(item))
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    run, any_run = 0, False
    for i in range(low, high + 1):
        if i < high and doc[i + diagonal] == item[i]:
            run += 1
            continue
        if run >= need:
            hit[i + diagonal - run : i + diagonal] = any_run = True
        run = 0
    return any_run


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 13, share: int = 20) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated.

    A window is ``span`` consecutive words of an item, or all of a shorter item that has
    words. n_hit counts the document's words inside any occurrence of a window; a document
    is contaminated if n_hit > 0 and ``share`` * n_hit >= n_words. Words are compared with
    A-Z lower-cased.

    Null and empty texts have no words and are not contaminated; very long ones are read whole.
    Items with equal texts all count; repeated item ids count once, and a null item id is the
    empty one. Documents with equal ids are told apart and each
    get their row. Without items or documents the result has no hits or no rows. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")

    def item_prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in pieces(batches, "text"):
            data, starts, ends, text_of = word_spans(found, WORD)
            sizes = np.bincount(text_of, minlength=len(found))
            lengths = sorted({int(n) for n in sizes if 0 < n < span})
            of, at, fp, _, _ = _fingerprints(data, starts, ends, text_of, len(found), span, lengths)
            # Of the runs of a short length, only whole items of that length count.
            is_long = sizes[of] >= span
            from_window = np.zeros(len(of), bool)
            from_window[: len(of) - _short_count(text_of, lengths)] = True
            size_of_run = np.concatenate([np.zeros(int(from_window.sum()), int), *(np.full(_short_count(text_of, [m]), m) for m in lengths)])
            good = (from_window & is_long) | (~from_window & (size_of_run == sizes[of]))
            rows = batch.column("item").take(pa.array(of[good]))
            yield pa.RecordBatch.from_arrays([rows, pa.array(fp[good].view(np.int64)), pa.array(at[good]), pa.array(size_of_run[good])], names=["item", "fp", "ipos", "length"])

    items = scratch.keep(benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("item"), benchmark[item_text_col].cast("string").alias("text")).distinct(), "items")
    prints = scratch.keep(map_batches(items, item_prints, "item string, fp long, ipos long, length long"), "prints")
    lengths = sorted(r[0] for r in prints.select("length").where("length > 0").distinct().collect())  # under span values
    sieve = spark.sparkContext.broadcast(_sieve(prints))

    def suspects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = sieve.value
        for batch, found in pieces(batches, "text"):
            data, starts, ends, text_of = word_spans(found, WORD)
            of, at, fp, counts, _ = _fingerprints(data, starts, ends, text_of, len(found), span, lengths)
            place = (fp >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)
            passed = np.flatnonzero(may[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            order = passed[np.argsort(of[passed], kind="stable")]
            bounds = np.searchsorted(of[order], np.arange(len(found) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values)) for values in (fp[order].view(np.int64), at[order])]
            kept = pa.array([t if a < b else None for t, a, b in zip(found, bounds[:-1], bounds[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), kept, *lists], names=["id", "n_words", "text", "fps", "ats"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scanned = map_batches(rows, suspects, f"id {kind}, n_words long, text binary, fps array<long>, ats array<long>")
    scanned = scratch.keep(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")

    hits = scanned.where("text is not null").select("row", F.explode(F.arrays_zip("fps", "ats")).alias("z")).select("row", F.col("z.fps").alias("fp"), F.col("z.ats").alias("at"))
    found = hits.join(prints, "fp").groupBy("row", "item").agg(F.collect_set(F.col("at") - F.col("ipos")).alias("diagonals"))
    found = scratch.keep(found, "found")
    per_doc = found.join(items, "item").groupBy("row").agg(F.collect_list(F.struct("item", F.col("text").alias("words"), "diagonals")).alias("pairs"))

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, pairs in zip(texts(batch.column("text")), batch.column("pairs")):
                doc = words_of(text)
                hit, names = np.zeros(len(doc), bool), set()
                for pair in pairs.as_py():
                    item = words_of(pair["words"].encode())
                    marks = [_mark(doc, item, d, span, hit) for d in pair["diagonals"]]
                    if any(marks):
                        names.add(pair["item"])
                out.append((int(hit.sum()), sorted(names)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.string()))], names=["row", "n_hit", "item_ids"])

    judged = map_batches(per_doc.join(scanned.where("text is not null").select("row", "text"), "row"), verify, "row long, n_hit long, item_ids array<string>")
    out = scanned.select("id", "n_words", "row").join(scratch.keep(judged, "judged"), "row", "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"))


def _short_count(text_of: np.ndarray, lengths: list[int]) -> int:
    """How many runs of the given lengths lie within one text."""
    return sum(int((text_of[: len(text_of) - m + 1] == text_of[m - 1 :]).sum()) for m in lengths if len(text_of) >= m)
