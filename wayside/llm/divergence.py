"""How sources of one language differ in their words: exact divergences of sources and of terms.

Tasks count words of whole texts and ship a row for each (language, source, term) they met.
The terms of a language that enough of its documents hold are kept, each with the sparse vector
of its counts by source.  Terms with the same vector add the same amounts to every pair of
sources, so vectors are grouped, each pair of sources is evaluated once for each distinct vector
and the amount is multiplied by how many terms have it; the original terms are ranked.

With c a term's count in a group, N the counts of all kept terms there and V their number,
p = 1 + floor(10**9 (c + 2) / (N + 2 V)), and two groups differ on a term by
floor((p - q)**2 / (p + q)).  All of it is integers: quotients are taken digit by digit.

Pairs of sources are as many as the result has rows.  They are dealt in tiles of ``BLOCK`` by
``BLOCK`` sources: a vector is cut to a tile's sources before it is grouped, tasks add up their
vectors' shares of a tile, and the shares are summed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import arrow_map, batch, written

LEAST_DOCS, TOP, SCALE = 10, 10, 10**9
BLOCK = 128
#: Terms a task holds before it ships them, bytes of a text that are split at a time, cells of counts evaluated at a time.
HELD, PIECE, CELLS = 300_000, 1 << 20, 1 << 20

#: Bytes of terms: ASCII letters, lowered, and all beyond ASCII; the rest become blanks.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a list for each piece of it."""
    text, at = text.translate(_LETTERS), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(held_at_most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, docs) in held.items():
                terms = list(counts)
                for k in range(0, len(terms), 50_000):
                    part = terms[k : k + 50_000]
                    yield batch(lang=pa.array([lang] * len(part), pa.string()), source=pa.array([source] * len(part), pa.string()), term=pa.array(part, pa.binary()).cast(pa.string()), n=np.array([counts[t] for t in part], np.int64), docs=np.array([docs[t] for t in part], np.int64))
            held.clear()

        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), texts, strict=True):
                counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for terms in _terms(text.as_py()):
                    counts.update(terms)
                    seen.update(terms)
                docs.update(seen)
            if sum(len(c) for c, _ in held.values()) > held_at_most:
                yield from rows()
        yield from rows()

    return run


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", held: int = HELD) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that hold it); nulls are ''."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    met = arrow_map(plain, _count(held), "lang string, source string, term string, n long, docs long")
    return met.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (counts + 2) / totals), exact for totals up to 9 * 10**15."""
    rest = counts + 2
    out = rest // totals
    rest = rest % totals
    for _ in range(3):  # three digits of a thousand make SCALE
        rest = rest * 1000
        out = out * 1000 + rest // totals
        rest = rest % totals
    return out + 1


def _evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each tile's sums over this task's vectors: lang, a, b (numbers of sources, a < b) and value."""
    sums: dict[tuple[str, int, int], np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, x, y), total in sums.items():
            a, b = np.triu_indices(len(total), 1) if x == y else (g.ravel() for g in np.indices(total.shape))
            yield batch(lang=pa.array([lang] * len(a), pa.string()), a=x * BLOCK + a, b=y * BLOCK + b, value=total[a, b])
        sums.clear()

    for b in batches:
        langs = b.column("lang").to_pylist()
        x, y, mult, terms = (b.column(c).to_numpy() for c in ("x", "y", "mult", "terms"))
        tiles: dict[tuple[str, int, int], list[int]] = {}
        for i, key in enumerate(zip(langs, x.tolist(), y.tolist(), strict=True)):
            tiles.setdefault(key, []).append(i)
        numbers, counts = b.column("numbers"), b.column("counts")
        for (lang, tx, ty), members in tiles.items():
            rows_of, columns_of = (np.array(b.column(c)[members[0]].as_py(), np.int64) for c in ("nx", "ny"))
            total = sums.setdefault((lang, tx, ty), np.zeros((len(rows_of), len(columns_of)), np.int64))
            full = [i for i in members if mult[i]]
            sizes = np.concatenate([rows_of, columns_of] if tx != ty else [rows_of])
            step = max(1, CELLS // len(sizes))
            for k in range(0, len(full), step):
                part = pa.array(full[k : k + step])
                number, count = numbers.take(part), counts.take(part)
                row = np.repeat(np.arange(len(part)), np.diff(number.offsets.to_numpy()))
                column = number.flatten().to_numpy()
                column = np.where(column // BLOCK == tx, column - tx * BLOCK, column - ty * BLOCK + (len(rows_of) if tx != ty else 0))
                dense = np.zeros((len(part), len(sizes)), np.int64)
                dense[row, column] = count.flatten().to_numpy()
                p = share(dense, sizes + 2 * terms[full[0]])
                q = p if tx == ty else p[:, len(rows_of) :]
                for i in range(len(rows_of)):
                    own, j = p[:, i : i + 1], i + 1 if tx == ty else 0
                    total[i, j:] += mult[part.to_numpy()] @ ((own - q[:, j:]) ** 2 // (own + q[:, j:]))
        if len(sums) > 64:
            yield from rows()
    yield from rows()


def _quotient(count: Column, total: Column) -> Column:
    """share() as a column: exact, in decimals."""
    return F.call_function("div", (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(20,0)")) + 1


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", held: int = HELD) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: how far each other source of the language is, by all kept terms.  Part
    ``term``: the ``top`` terms that the source uses more than its language does.  Ranks start
    at 1 in each group and part, by value descending, then by item's bytes.

    Terms are runs of ASCII letters, with A-Z lowered, and characters beyond ASCII.  A language
    keeps the terms that at least ``least_docs`` of its rows hold; repeated rows are documents
    each.  Null language, source and text are ''.  A source without terms is a source; a
    language with one source has no pairs, with no kept term pairs at 0.  An empty table gives
    an empty one; columns besides the three are not read.
    """
    sources = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    groups = written(sources.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "sources")
    counts = term_counts(docs, lang_col, source_col, text_col, held).join(groups, ["lang", "source"])
    each = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", F.col("n").alias("c")))).alias("vector"))
    kept = written(each.where(F.col("docs") >= least_docs).select("lang", "term", "n", "vector"), "terms")

    language = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("all"))
    spread = kept.select("lang", F.explode("vector").alias("e")).groupBy("lang", F.col("e.k").alias("k")).agg(F.sum("e.c").alias("size"))
    sized = groups.join(spread, ["lang", "k"], "left").join(language, "lang", "left").na.fill(0, ["size", "terms", "all"])
    sized = written(sized.select("lang", "source", "k", "size", "terms", "all"), "sizes")

    blocks = sized.groupBy("lang", F.floor(F.col("k") / BLOCK).cast("int").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "size"))), lambda e: e["size"]).alias("sizes"), F.max("terms").alias("terms"))
    last = blocks.groupBy("lang").agg(F.max("block").alias("last"))
    tile = last.select("lang", "last", F.explode(F.sequence(F.lit(0), "last")).alias("x")).select("lang", "x", F.explode(F.sequence("x", "last")).alias("y"))
    inside = F.filter("vector", lambda e: F.floor(e["k"] / BLOCK).isin(F.col("x"), F.col("y")))
    cut = kept.select("lang", "vector").join(tile, "lang").select("lang", "x", "y", inside.alias("vector")).groupBy("lang", "x", "y", "vector").agg(F.count(F.lit(1)).alias("mult"))
    # A vector that no term has lets every tile come out, also where no term is kept.
    seeded = cut.unionByName(tile.select("lang", "x", "y", F.array().cast("array<struct<k:int,c:bigint>>").alias("vector"), F.lit(0).cast("long").alias("mult")))
    dealt = seeded.join(blocks.select("lang", F.col("block").alias("x"), F.col("sizes").alias("nx"), "terms"), ["lang", "x"]).join(blocks.select("lang", F.col("block").alias("y"), F.col("sizes").alias("ny")), ["lang", "y"])
    spelled = dealt.select("lang", "x", "y", "mult", "terms", F.transform("vector", lambda e: e["k"]).alias("numbers"), F.transform("vector", lambda e: e["c"]).alias("counts"), "nx", "ny")
    summed = arrow_map(spelled, _evaluate, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = summed.select("lang", F.explode(F.array(F.struct(F.col("a").alias("k"), F.col("b").alias("other")), F.struct(F.col("b").alias("k"), F.col("a").alias("other")))).alias("e"), "value").select("lang", "e.k", "e.other", "value")
    named = both.join(groups, ["lang", "k"]).join(groups.select("lang", F.col("k").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    entries = kept.select("lang", "term", "n", F.explode("vector").alias("e")).select("lang", "term", "n", "e.k", "e.c").join(sized, ["lang", "k"])
    p, q = F.col("p"), F.col("q")
    rated = entries.select("lang", "source", F.col("term").alias("item"), _quotient(F.col("c"), F.col("size") + 2 * F.col("terms")).alias("p"), _quotient(F.col("n"), F.col("all") + 2 * F.col("terms")).alias("q")).where(p > q)
    valued = rated.select("lang", "source", "item", F.call_function("div", (p - q) * (p - q), p + q).alias("value"))
    terms = valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
