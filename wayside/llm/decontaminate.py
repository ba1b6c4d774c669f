"""Benchmark decontamination by winnowing.

Every window of ``window`` item words is cut into k-grams of ``(window + 1) // 2`` words; of
each run of k-grams that fills one window, the one of smallest hash is kept, its fingerprint.
The same words keep the same k-gram wherever they stand, so every shared window shows as a
shared fingerprint.

The benchmark becomes a table of windows (length, fingerprint, 128 bits of hash, item), made
and kept by Spark.  Documents are read once and not shuffled: a bitmap of the benchmark's
fingerprints and one of its windows, of at most ``MOST_BITS`` bits each whatever the benchmark
holds, tell which fingerprints of a document may be shared, and each of those is extended to
the windows around it.  What is left is joined with the benchmark's windows on fingerprint and
hashes; a bitmap that is full only lets more rows through to that join.

Windows that many items share lead to a set of items, and documents to lists of such sets, so a
passage in n items and m documents costs n + m rows and not their product.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import anonymous, arrow_map, batch, keyed, row_key, written
from .wordhash import ALNUM, Words, chunks, winnow

#: Each bitmap takes 16 MB at the most; up to eight million windows have 16 bits each.
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 15, 1 << 27, 16
_WINDOW = ["n", "g", "w1", "w2"]
_SPOTS = "struct<n:int, g:long, w1:long, w2:long, at:int>"


def _gram(length: int) -> int:
    return (length + 1) // 2


def _signs(words: Words, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """Fingerprint and both hashes of the windows that begin at ``starts``."""
    gram = _gram(length)
    grams = words.grams(gram)
    picks = np.min([grams[starts + k] for k in range(length - gram + 1)], axis=0) if len(starts) else np.zeros(0, np.uint64)
    return [picks, *(words.grams(length, k)[starts] for k in (0, 1))]


def _index(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, words in chunks(b.column("text"), ALNUM, lower=True):
                lengths = np.minimum(window, words.counts)
                for n in np.unique(lengths[lengths > 0]).tolist():
                    starts = np.flatnonzero(words.whole(n))
                    starts = starts[lengths[words.doc[starts]] == n]
                    item = b.column("item").take(pa.array(i + words.doc[starts]))
                    g, w1, w2 = (x.view(np.int64) for x in _signs(words, starts, n))
                    yield batch(n=np.full(len(starts), n, np.int32), g=g, w1=w1, w2=w2, item=item)

    return run


def index_items(benchmark: DataFrame, window: int = 10, item_col: str = "item_id") -> DataFrame:
    """n, g, w1, w2 and item of each window of benchmark items; an item of fewer words is one window of n words."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return written(arrow_map(items, _index(window), "n int, g long, w1 long, w2 long, item string").distinct(), "windows")


def _bitmap(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """``bits`` bits, of which those are set that the column's values name modulo ``bits``; made by Spark, 4 KB a row."""
    place = F.col(column).bitwiseAND(F.lit(bits - 1).cast("long")) + 1
    rows = values.select(F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bytes")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[4096 * (r.k - 1) : 4096 * r.k] = np.frombuffer(r.bytes, np.uint8)
    return out


def _held(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = (values & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _spots(words: Words, lengths: list[int], prints: np.ndarray, windows: np.ndarray) -> list[np.ndarray]:
    """n, g, w1, w2 and start of the windows that may be the benchmark's."""
    found = []
    for n in lengths:
        gram, whole = _gram(n), words.whole(n)
        run, grams = n - gram + 1, words.grams(gram)
        picked = winnow(grams, run, whole)
        picked = picked[_held(prints, grams[picked])]
        if not len(picked):
            continue
        starts = np.unique((picked[:, None] - np.arange(run)).ravel())
        starts = starts[(starts >= 0) & (starts < len(whole))]
        starts = starts[whole[starts] & _held(windows, words.grams(n)[starts])]
        if len(starts):
            found.append([np.full(len(starts), n, np.int64), *(x.view(np.int64) for x in _signs(words, starts, n)), starts])
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5


def _probe(lengths: list[int], prints: np.ndarray, windows: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, words in chunks(b.column("text"), ALNUM, lower=True):
                n, g, w1, w2, at = _spots(words, lengths, prints, windows)
                doc = words.doc[at] if len(at) else np.zeros(0, np.int64)
                order = np.argsort(doc, kind="stable")
                struct = pa.StructArray.from_arrays([pa.array(n[order], pa.int32()), pa.array(g[order]), pa.array(w1[order]), pa.array(w2[order]), pa.array((at - words.first[doc])[order] if len(at) else at, pa.int32())], ["n", "g", "w1", "w2", "at"])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=j - i))]).astype(np.int32)
                yield batch(**{c: b.column(c).slice(i, j - i) for c in ("doc_id", "ord", "tag")}, n_words=words.counts, spots=pa.ListArray.from_arrays(pa.array(offsets), struct))

    return run


def _item_sets(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The set of items of each window (n, g, w1, w2, s), and the items of each set (s, item).

    Windows of one passage have the same items, so sets are few where windows are many.  A set is
    told by its size and two sums of hashes of its items, which combine before they are shuffled.
    """
    sums = index.groupBy(*_WINDOW).agg(F.count(F.lit(1)).alias("size"), *(F.sum(F.xxhash64("item", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}") for k in (0, 1)))
    sums = written(sums, "sums")
    first = sums.groupBy("size", "s0", "s1").agg(F.min(F.struct(*_WINDOW)).alias("first")).select("size", "s0", "s1", "first.*")
    sets = written(first.withColumn("s", F.monotonically_increasing_id()), "sets")
    return sums.join(sets.select("size", "s0", "s1", "s"), ["size", "s0", "s1"]).select(*_WINDOW, "s"), index.join(sets.select(*_WINDOW, "s"), _WINDOW).select("s", "item")


def _spotted(docs: DataFrame, benchmark: DataFrame, window: int, item_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A row for each document (doc_id, ord, tag, n_words), its windows that may be the benchmark's, and the benchmark's windows.

    docs: doc_id, ord, tag, text.
    """
    index = index_items(benchmark, window, item_col)
    about = index.agg(F.count(F.lit(1)).alias("n"), F.collect_set("n").alias("lengths")).first()  # at most ``window`` lengths
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * about.n).bit_length()))
    probe = _probe(sorted(about.lengths), _bitmap(index, "g", bits), _bitmap(index, "w1", bits))
    rows = written(arrow_map(docs, probe, f"doc_id long, ord long, tag long, n_words long, spots array<{_SPOTS}>"), "spots")
    spots = rows.where(F.size("spots") > 0).select("ord", "tag", F.explode("spots").alias("s")).select("ord", "tag", *(f"s.{c}" for c in (*_WINDOW, "at")))
    return rows.drop("spots"), spots, index


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of words as a deflated bitmap, and how many words they cover."""
    for b in batches:
        maps, n_hit = [], []
        for n, spans in zip(b.column("n_words").to_pylist(), b.column("spans").to_pylist(), strict=True):
            edge = np.zeros(n + 1, np.int64)
            if spans:
                at, size = np.array([s["at"] for s in spans]), np.array([s["n"] for s in spans])
                np.add.at(edge, at, 1)
                np.add.at(edge, at + size, -1)
            hit = np.cumsum(edge[:-1]) > 0
            n_hit.append(int(hit.sum()))
            maps.append(zlib.compress(np.packbits(hit).tobytes()) if spans else None)
        yield batch(doc_id=b.column("doc_id"), n_words=b.column("n_words"), n_hit=np.array(n_hit, np.int64), hits=pa.array(maps, pa.binary()), item_sets=b.column("item_sets"))


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, item_col: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_words, n_hit, hits and item_sets of each row of ``docs``; and the items of each such list of sets.

    A document meets windows, windows lead to sets of items, and documents with the same sets
    share one list of items, so items are written out once for each different list and not for
    each document.
    """
    rows, spots, index = _spotted(keyed(docs, id_col, text_col), benchmark, window, item_col)
    windows, members = _item_sets(index)
    met = spots.join(windows, _WINDOW)
    # Sets, as rows that agree in id and text bring the same windows.
    spans = met.groupBy("ord", "tag").agg(F.collect_set(F.struct("at", "n")).alias("spans"), F.array_sort(F.collect_set("s")).alias("item_sets"))
    hit = written(rows.join(spans, ["ord", "tag"], "left").select("doc_id", "n_words", "spans", "item_sets"), "hits")
    lists = hit.select("item_sets").where(F.col("item_sets").isNotNull()).distinct()
    each = lists.select("item_sets", F.explode("item_sets").alias("s")).join(members, "s").select("item_sets", "item").distinct()
    named = each.groupBy("item_sets").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return arrow_map(hit, _marked, "doc_id long, n_words long, n_hit long, hits binary, item_sets array<long>"), named


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's words inside occurrences of benchmark windows.

    Returns doc_id, n_words, n_hit, hits (deflated bitmap over the words, null if none) and
    items (ids with occurring windows, sorted as strings); one row for each row of ``docs``.

    A word is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered.  Null and
    empty texts have no words; an item without words has no windows; rows of one item_id are
    one item and a null item_id counts as ''.  With an empty benchmark nothing is hit; an empty
    table gives an empty one; repeated rows have the same hits each.
    """
    hit, named = _hits(docs, benchmark, window, item_col, id_col, text_col)
    return hit.join(named, "item_sets", "left").select("doc_id", "n_words", "n_hit", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def hit_digest(docs: DataFrame, benchmark: DataFrame, window: int = 10, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """benchmark_hits() as plain columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A list of items is digested once, however many documents have it.
    """
    hit, named = _hits(docs, benchmark, window, item_col, id_col, text_col)
    short = written(named.select("item_sets", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")), "lists")
    told = hit.join(short, "item_sets", "left")
    return told.select("doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with their columns; rules as in benchmark_hits()."""
    _, spots, index = _spotted(keyed(docs, id_col, text_col), benchmark, window, item_col)
    hit = written(spots.join(index.select(*_WINDOW).distinct(), _WINDOW).select("ord", "tag").distinct(), "contaminated")
    plain, names, _ = anonymous(docs)
    doc_id, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    return plain.withColumns(row_key(F.col(doc_id), F.col(text))).join(hit, ["ord", "tag"], "left_anti").select(*names).toDF(*docs.columns)


def digest(hits: DataFrame) -> DataFrame:
    """benchmark_hits() as the columns of hit_digest()."""
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], window: int = 10) -> list[tuple]:
    """The digest by plain loops over lists, for tests."""
    import re

    def words(text: str | None) -> list[str]:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    wanted: dict[tuple, set[str]] = defaultdict(set)
    for item_id, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) + 1 - n if n else 0):
            wanted[tuple(w[i : i + n])].add("" if item_id is None else str(item_id))
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(x) for x in wanted}:
            for i in range(len(w) + 1 - n):
                if tuple(w[i : i + n]) in wanted:
                    hit |= set(range(i, i + n))
                    names |= wanted[tuple(w[i : i + n])]
        joined = ",".join(sorted(names))
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return out
