"""SimHash near-dedup by tiled exact comparison.

A fingerprint has a bit for each bit of its shingles' hashes, set if most of them set it.
Equal fingerprints (and, with ``least``, equal sets of shingles) are one class from the start;
only distinct ones are compared, by exclusive
or and bit counts over tiles of numpy arrays, and pairs of tiles whose population counts
differ by more than the radius are skipped.

Which fingerprints can meet in a tile is narrowed without loss: within radius r, one of r + 1
equal parts of two fingerprints agrees, so each part's value is a cell and only rows of one
cell are compared (``cells='parts'``).  For larger radii, where parts would be too short to
tell anything apart, the cells are minima of hash functions over the shingles, which two texts
share with a probability equal to their similarity each (``cells='minima'``).  A cell of many
rows is cut into tiles along the population count of its fingerprints, so that a pair of tiles
whose counts lie further apart than the radius is not even shipped; each other pair is a task
of its own.

A task returns links that connect what its matches connect, not the matches themselves, so a
group of n near copies gives n - 1 links a task instead of n * n.

Fingerprints estimate a similarity.  Where a bound on the similarity itself is asked for
(``least``), the links above only propose groups; the shingles of the few documents in a
proposed group are then compared, tile by tile, and links below the bound fall away.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .tables import LAST_ID, anonymous, arrow_map, batch, checkpointed, keyed, row_key
from .wordhash import mix

TILE = 1024
SET_TILE = 512
_COLUMNS = 4096
_SUB = 128
_FEW = 24
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``size`` words (or of all words, if fewer), A-Z lowered."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - size].tolist()]
    parts = [joined[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    columns = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)
    bits = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)]) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprints(size: int, words: int, repeats: bool, minima: int, sets: bool):
    salts = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & ((1 << 64) - 1)) for k in range(max(words, minima))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, cells, exact = [[] for _ in range(words)], [], []
            for text in b.column("text").cast(pa.binary()):
                h = shingle_hashes(text.as_py() or b"", size)
                held = np.unique(h) if sets or not repeats else h
                exact.append(int(np.uint64(xxhash.xxh64_intdigest(held.tobytes())).view(np.int64)) if sets else 0)
                if not repeats:
                    h = held
                for k in range(words):
                    prints[k].append(majority(mix(h ^ salts[k]) if k else h))
                if minima:
                    cells.append([int(mix(h ^ s ^ np.uint64(k)).min().view(np.int64)) if len(h) else 0 for k, s in enumerate(salts[:minima])])
            columns = {f"f{k}": pa.array(p, pa.int64()) for k, p in enumerate(prints)}
            yield batch(doc_id=b.column("doc_id"), ord=b.column("ord"), tag=b.column("tag"), **columns, shingles=pa.array(exact, pa.int64()), minima=pa.array(cells if minima else [[]] * b.num_rows, pa.list_(pa.int64())))

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, repeats: bool = True, minima: int = 0, sets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ord, tag, f0 .. (64 fingerprint bits each), shingles and minima for each row.

    shingles: with ``sets``, a hash of the set of shingles; otherwise 0.
    Null texts and texts without words have fingerprint zero.
    """
    columns = "".join(f", f{k} long" for k in range(words))
    return arrow_map(keyed(docs, id_col, text_col), _fingerprints(shingle, words, repeats, minima, sets), f"doc_id long, ord long, tag long{columns}, shingles long, minima array<long>")


class _Joined:
    """Labels of rows that matches have connected so far, and the links that did it."""

    def __init__(self, n: int) -> None:
        self.label, self.links = np.arange(n), []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            apart = self.label[a] != self.label[b]
            a, b = a[apart], b[apart]
            if len(a):
                x, y = self.label[a[0]], self.label[b[0]]
                self.links.append((a[0], b[0]))
                self.label[self.label == y] = x


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of x and y differ in at most ``radius`` bits, as a matrix."""
    apart = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0]).astype(np.uint16)
    for k in range(1, x.shape[1]):
        apart += np.bitwise_count(x[:, None, k] ^ y[None, :, k])
    return apart <= radius


def tile_links(prints: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """Row pairs that connect all rows of one task that lie within ``radius`` of each other.

    side 2: a tile with itself; 0 and 1: two tiles, compared across.
    """
    population = np.bitwise_count(prints).sum(axis=1).astype(np.int64)
    joined = _Joined(len(prints))
    left = np.flatnonzero(side != 1)
    right = np.flatnonzero(side != 0)
    left, right = left[np.argsort(population[left], kind="stable")], right[np.argsort(population[right], kind="stable")]
    own = len(side) > 0 and side[0] == 2
    for i in range(0, len(left), _SUB):
        a = left[i : i + _SUB]
        for j in range(i if own else 0, len(right), _SUB):
            b = right[j : j + _SUB]
            if population[b[0]] > population[a[-1]] + radius:
                break
            if population[b[-1]] < population[a[0]] - radius:
                continue
            x, y = np.nonzero(_near(prints[a], prints[b], radius))
            joined.add(a[x], b[y])
    return np.array(joined.links, np.int64).reshape(-1, 2)


def _whole_keys(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted batches as tables that never part the rows of one key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        # Rows of the key that the batch ends in wait for the next batch.
        last = [b.column(k)[-1] for k in key]
        same = np.logical_and.reduce([b.column(k).to_numpy() == v.as_py() for k, v in zip(key, last, strict=True)])
        cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        elif held and [held[-1].column(k)[-1] for k in key] != last:
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _compare(words: int, radius: int):
    def several(nodes: np.ndarray, prints: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of a few rows, all at once: each row with the next, the next but one, and so on."""
        left = np.repeat(begin + size, size) - 1 - np.arange(len(nodes))
        a, b = [], []
        for k in range(1, int(size.max(initial=1))):
            at = np.flatnonzero(left >= k)
            apart = np.bitwise_count(prints[at] ^ prints[at + k]).sum(axis=1)
            at = at[apart <= radius]
            a.append(nodes[at])
            b.append(nodes[at + k])
        return (np.concatenate(a), np.concatenate(b)) if a else (nodes[:0], nodes[:0])

    def linked(t: pa.Table) -> pa.RecordBatch:
        nodes, side = t.column("node").to_numpy(), t.column("side").to_numpy()
        prints = np.stack([t.column(f"f{k}").to_numpy().view(np.uint64) for k in range(words)], axis=1)
        key = np.stack([t.column(k).to_numpy() for k in ("part", "cell", "ti", "tj")], axis=1)
        begin = np.flatnonzero(np.concatenate([[True], np.any(key[1:] != key[:-1], axis=1)]))
        size = np.diff(np.append(begin, len(nodes)))
        few = (size <= _FEW) & (side[begin] == 2)
        rows = np.repeat(few, size)
        a, b = several(nodes[rows], prints[rows], np.cumsum(size[few]) - size[few], size[few])
        for s, n in zip(begin[~few].tolist(), size[~few].tolist(), strict=True):
            links = s + tile_links(prints[s : s + n], side[s : s + n], radius)
            a, b = np.concatenate([a, nodes[links[:, 0]]]), np.concatenate([b, nodes[links[:, 1]]])
        return batch(a=a, b=b)

    return lambda batches: map(linked, _whole_keys(batches, ("part", "cell", "ti", "tj")))


def links(classes: DataFrame, radius: int, words: int = 1, cells: str = "parts") -> DataFrame:
    """Links (a, b) between the nodes of distinct fingerprints within ``radius``.

    classes: node, f0 .., minima; the links connect whatever the matches connect.
    """
    if cells == "parts":
        width = 64 // (radius + 1)
        if words != 1 or width < 8:
            raise ValueError("parts need one word and a radius of 7 at most")
        keys = F.array(*(F.shiftrightunsigned("f0", k * width).bitwiseAND((1 << (width if k < radius else 64 - radius * width)) - 1) for k in range(radius + 1)))
    else:
        keys = F.col("minima")
    prints = [f"f{k}" for k in range(words)]
    rows = classes.select("node", *prints, F.posexplode(keys).alias("part", "cell"))
    counted = rows.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(counted, ["part", "cell"])
    alone = met.where(F.col("n") <= TILE).select("part", "cell", F.lit(0).cast("long").alias("ti"), F.lit(0).cast("long").alias("tj"), F.lit(2).alias("side"), "node", *prints)
    many = met.where(F.col("n") > TILE).withColumn("population", sum((F.bit_count(p) for p in prints), start=F.lit(0)))
    tasks = alone.unionByName(_tiled(many, radius, prints))
    key = ("part", "cell", "ti", "tj")
    return arrow_map(tasks.repartition(*key).sortWithinPartitions(*key), _compare(words, radius), "a long, b long")


def _tiled(rows: DataFrame, radius: int, prints: list[str]) -> DataFrame:
    """Rows of large cells, a copy for each pair of tiles that they take part in: part, cell, ti, tj, side, node and fingerprint.

    Rows of a cell are numbered along their population count (a count of many rows is dealt to
    several tiles by hash), so a tile spans few counts and meets only tiles within ``radius``.
    """
    cell = ["part", "cell"]
    sizes = rows.groupBy(*cell, "population").agg(F.count(F.lit(1)).alias("k"))
    # At most as many rows a cell as a fingerprint has bits.
    before = F.coalesce(F.sum("k").over(Window.partitionBy(*cell).orderBy("population").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = sizes.select(*cell, "population", F.floor(before / TILE).alias("base"), F.ceil(F.col("k") / TILE).alias("spread"))
    spans = plan.select(*cell, "population", F.explode(F.sequence("base", F.col("base") + F.col("spread") - 1)).alias("tile")).groupBy(*cell, "tile").agg(F.min("population").alias("low"), F.max("population").alias("high"))
    a, b = (spans.select(*cell, *(F.col(c).alias(f"{side}_{c}") for c in ("tile", "low", "high"))) for side in "ab")
    pairs = a.join(b, cell).where((F.col("a_tile") <= F.col("b_tile")) & (F.col("b_low") - F.col("a_high") <= radius) & (F.col("a_low") - F.col("b_high") <= radius))
    side = F.when(F.col("a_tile") == F.col("b_tile"), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    ways = pairs.withColumn("side", F.explode(side)).select(*cell, F.when(F.col("side") == 1, F.col("b_tile")).otherwise(F.col("a_tile")).alias("tile"), F.col("a_tile").alias("ti"), F.col("b_tile").alias("tj"), "side")
    placed = rows.join(plan, [*cell, "population"]).withColumn("tile", F.col("base") + F.pmod(F.hash("node"), F.col("spread")))
    return placed.join(ways, [*cell, "tile"]).select(*cell, "ti", "tj", "side", "node", *prints)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                held = [np.unique(shingle_hashes(t.as_py() or b"", size)).tobytes() for t in part.column("text").cast(pa.binary())]
                yield batch(component=part.column("component"), m=part.column("m"), node=part.column("node"), shingles=pa.array(held, pa.binary()))

    return run


def similar_links(sets: list[np.ndarray], side: np.ndarray, least: float) -> np.ndarray:
    """As tile_links(), by the shingles two rows share over the shingles either has."""
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    size = np.array([len(x) for x in sets], np.int64)
    values, which, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    column = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[which]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [begin, begin + _COLUMNS])
        held = np.zeros((len(sets), _COLUMNS), np.float32)
        held[row[a:b], column[a:b] - begin] = 1
        shared += held[left] @ held[right].T
    either = size[left][:, None] + size[right][None, :] - shared
    x, y = np.nonzero(shared >= least * either - 1e-3)
    joined = _Joined(len(sets))
    joined.add(left[x], right[y])
    return np.array(joined.links, np.int64).reshape(-1, 2)


def _verify(least: float):
    key = ("component", "ti", "tj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_keys(batches, key):
            node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
            names = np.stack([t.column(k).to_numpy() for k in key], axis=1)
            begin = np.flatnonzero(np.concatenate([[True], np.any(names[1:] != names[:-1], axis=1)]))
            for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(node)], strict=True):
                found = i + similar_links([np.frombuffer(x.as_py(), np.uint64) for x in t.column("shingles")[i:j]], side[i:j], least)
                yield batch(a=node[found[:, 0]], b=node[found[:, 1]])

    return run


def similar(source: DataFrame, proposed: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links (a, b) between nodes of one proposed component whose shingles agree to ``least``.

    source: ord, tag, text; proposed: node, ord, tag, component.  Components of many nodes are
    dealt to pairs of tiles.
    """
    sized = proposed.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / SET_TILE).cast("int").alias("m"))
    members = proposed.join(sized, "component").select("node", "ord", "tag", "component", "m")
    texts = source.join(members, ["ord", "tag"]).dropDuplicates(["node", "tag"]).select("component", "m", "node", "text")
    rows = arrow_map(texts, _sets(shingle), "component long, m int, node long, shingles binary").withColumn("t", F.pmod(F.hash("node"), F.col("m")))
    dealt = rows.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    key = ("component", "ti", "tj")
    tasks = dealt.select("component", F.least("t", "u").alias("ti"), F.greatest("t", "u").alias("tj"), F.when(F.col("t") == F.col("u"), 2).when(F.col("t") < F.col("u"), 0).otherwise(1).alias("side"), "node", "shingles")
    return arrow_map(tasks.repartition(*key).sortWithinPartitions(*key), _verify(least), "a long, b long")


def groups(docs: DataFrame, shingle: int = 3, radius: int = 3, words: int = 1, repeats: bool = True, minima: int = 0, least: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ord, tag, f0 .., component and component_id for each row of ``docs``.

    component_id: the smallest doc_id that links of at most ``radius`` differing bits reach,
    itself included; null where only null doc_ids are reached.  component: the same, or another
    number where rows without ids are reached.  minima 0: parts as cells, exact; otherwise that
    many minima.  least: if given, links hold only between documents of which that share of
    shingles is common, at the least; equal sets of shingles link in any case.
    Rows of one doc_id are one document, so they link; rows without an id do not for that.
    """
    prints = [f"f{k}" for k in range(words)]
    made = checkpointed(fingerprints(docs, shingle, words, repeats, minima, least is not None, id_col, text_col))
    # Where shingles are compared, texts are of one class only if all of theirs agree.
    key = [*prints, "shingles"]
    # A class of rows without ids has a node of its own, which is no id.
    node = F.when(F.col("first.ord") < LAST_ID, F.col("first.ord")).otherwise(F.xxhash64(*(key if least is not None else prints)))
    classes = made.groupBy(*key).agg(F.min(F.struct("ord", "tag")).alias("first"), F.min("minima").alias("minima")).select(*key, node.alias("node"), F.col("first.ord").alias("ord"), F.col("first.tag").alias("tag"), "minima")
    again = made.where(F.col("ord") < LAST_ID).groupBy("ord").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).where("x != y").select("ord")
    others = made.join(again, "ord").join(classes.drop("ord", "tag"), key).select(F.col("ord").alias("a"), F.col("node").alias("b"))
    found = links(classes, radius, words, "minima" if minima else "parts")
    if least is not None:
        proposed = components(found).join(classes.select("node", "ord", "tag"), "node")
        found = similar(keyed(docs, id_col, text_col), proposed, shingle, least)
    reached = components(found.unionByName(others))
    named = classes.join(reached, "node", "left").select(*key, "node", "ord", F.coalesce("component", "node").alias("component"))
    # Components named by the node of a class without ids get the smallest id they hold, if any.
    nameless = named.where((F.col("ord") == LAST_ID) & (F.col("node") == F.col("component"))).select("component").distinct()
    least_id = named.join(nameless, "component").groupBy("component").agg(F.min("ord").alias("least"))
    named = named.join(least_id, "component", "left").select(*key, "component", F.coalesce("least", "component").alias("least"))
    return made.join(named, key).select("doc_id", "ord", "tag", *prints, "component", F.when(F.col("least") < LAST_ID, F.col("least")).alias("component_id"))


def keep_first(docs: DataFrame, grouped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of groups(): the smallest doc_id's, with its columns."""
    first = grouped.groupBy("component").agg(F.min(F.struct("ord", "tag")).alias("row")).select("row.ord", "row.tag")
    plain, names, _ = anonymous(docs)
    doc_id, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    kept = plain.withColumns(row_key(F.col(doc_id), F.col(text))).join(first, ["ord", "tag"], "left_semi")
    return kept.dropDuplicates(["ord", "tag"]).select(*names).toDF(*docs.columns)


def digest(grouped: DataFrame) -> DataFrame:
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def brute_force(docs: list[tuple[int, str | None]], shingle: int = 3, radius: int = 3) -> list[tuple]:
    """The digest by plain loops, for tests."""
    import re

    prints = []
    for _, text in docs:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        parts = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) + 1 - shingle))] if w else []
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        prints.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)))
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and find(i) != find(j):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, f"{prints[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(docs)]
