"""Token alignment between two tokenizers over the same bytes, and corpus counts of linked ids.

Both tokenizers cut the bytes of a blank and the text.  The union of both arrays of token ends
cuts them into elementary intervals; each interval lies in one token of either side, which
searching its end among the ends tells, and is one overlap (a link).  Ends that both sides share
close a group: what stands between two of them is aligned as a whole.

Counts of linked id pairs are sums over the corpus, added up in tasks before they are shuffled.
To read them back for a document, the most frequent pairs, at most ``FREQUENT`` whatever the
corpus holds, go to every task as sorted arrays; a document's other pairs are joined with the
table of counts, so hot pairs are never shuffled and none is left out.

No token of either side goes on after a blank that stands between two other characters, so there
both sides share an end; the loader checks that on the vocabularies.  Texts are cut at such
blanks, each word is aligned once and kept (at most ``WORDS`` words and ``KEPT`` bytes, then a
worker starts anew), and a document is its words' alignments, one after another.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import arrow_map, batch, written

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
FREQUENT, PIECE, HELD = 1 << 18, 1 << 16, 1 << 21
WORDS, KEPT, RUN = 500_000, 96 << 20, 64
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_CROSSING = re.compile(r"\S ")
_SHIFT = 32
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_products")


def file_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pair:
    """Both tokenizers: ids of texts, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = {c: b for b, c in _byte_letters().items()}
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(letters.get(c, 63) for c in names.get(i, "")) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(_CROSSING.search(x.decode(errors="replace")) for k in (self.a_bytes, self.b_bytes) for x in k):
            raise ValueError("a token crosses the place before a blank: texts cannot be cut there")
        self.a_size, self.b_size = (np.array([len(x) for x in k], np.int64) for k in (self.a_bytes, self.b_bytes))
        # Ids in decimal with what follows them: a comma, or the end of a side.
        self.spelled = [f"{i}{mark}".encode() for k, end in ((self.a_bytes, "|"), (self.b_bytes, ";")) for i in range(len(k)) for mark in (",", end)]
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.numbers, self.groups, self.links, self.kept = np.zeros((1024, len(NUMBERS)), np.int64), [], [], 0

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both sides' ids of pieces that begin with a blank."""
        return [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)], self.b.encode([p[1:] for p in pieces], num_threads=1)

    def renew(self, words: set[str]) -> None:
        """Every word of ``words`` is in ``index`` afterwards."""
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > WORDS or self.kept > KEPT:
            self.forget()
            new = list(words)
        if not new:
            return
        begin = len(self.groups)
        while begin + len(new) > len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
        self.index.update(zip(new, range(begin, begin + len(new))))
        numbers, groups, links = self._align(new)
        self.numbers[begin : begin + len(new)] = numbers
        self.groups += groups
        self.links += links
        self.kept += sum(map(len, groups)) + sum(map(len, links)) + sum(map(len, new))

    def _align(self, words: list[str]) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """Of each word, after a blank: NUMBERS (-1 if a side does not give it back), its groups spelled out, its links as packed keys."""
        numbers, groups, links = np.full((len(words), len(NUMBERS)), -1, np.int64), [b""] * len(words), [b""] * len(words)
        whole = [j for j, w in enumerate(words) if not (w[0].isspace() or w[-1].isspace())]
        alone = sorted(set(range(len(words))) - set(whole))
        runs = [whole[k : k + RUN] for k in range(0, len(whole), RUN)]
        for damaged in self._align_runs(words, runs, numbers, groups, links):
            alone += damaged
        self._align_runs(words, [[j] for j in alone], numbers, groups, links)
        return numbers, groups, links

    def _align_runs(self, words: list[str], runs: list[list[int]], numbers: np.ndarray, groups: list[bytes], links: list[bytes]) -> list[list[int]]:
        """Aligns words set side by side, a run at a time; the runs that a side does not give back."""
        if not runs:
            return []
        cut = [" " + " ".join([words[j] for j in r]) for r in runs]
        a_ids, b_ids = self.encode(cut)
        sound = [b"".join([self.a_bytes[i] for i in a]) == b"".join([self.b_bytes[i] for i in b]) == t.encode() for t, a, b in zip(cut, a_ids, b_ids, strict=True)]
        if any(sound):
            a, b = (np.array([i for x, ok in zip(ids, sound, strict=True) if ok for i in x], np.int64) for ids in (a_ids, b_ids))
            self._cut_words(words, [j for r, ok in zip(runs, sound, strict=True) if ok for j in r], a, b, numbers, groups, links)
        return [r for r, ok in zip(runs, sound, strict=True) if not ok]

    def _cut_words(self, words: list[str], chosen: list[int], a: np.ndarray, b: np.ndarray, numbers: np.ndarray, groups: list[bytes], links: list[bytes]) -> None:
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        word_ends = np.cumsum([len(words[j].encode()) + 1 for j in chosen])
        ends, at_a, at_b, shared = intervals(a_ends, b_ends)
        # Where each token stands among groups: the shared ends before its own.
        closed = a_ends[at_a[shared]]
        of_a, of_b = np.searchsorted(closed, a_ends), np.searchsorted(closed, b_ends)
        size_a, size_b = np.bincount(of_a, minlength=len(closed)), np.bincount(of_b, minlength=len(closed))
        last_a, last_b = np.append(of_a[1:] != of_a[:-1], True), np.append(of_b[1:] != of_b[:-1], True)
        # Spelling: a group's A ids, then its B ids.
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[of_a]] = 2 * a + last_a
        order[np.arange(len(b)) + np.cumsum(size_a)[of_b]] = 2 * b + last_b + 2 * len(self.a_bytes)
        spelled = [self.spelled[i] for i in order.tolist()]
        keys = (a[at_a] << _SHIFT | b[at_b]).astype("<i8").tobytes()
        # Every word ends a token of both sides, a group and an interval.
        ends_a, ends_b, groups_end, links_end = (np.searchsorted(x, word_ends) + 1 for x in (a_ends, b_ends, closed, ends))
        products = np.concatenate([[0], np.cumsum(size_a * size_b)])[groups_end]
        numbers[chosen] = np.stack([np.diff(x, prepend=0) for x in (ends_a, ends_b, groups_end, links_end, products)], axis=1)
        tokens_end, link, token_at, link_at = (ends_a + ends_b).tolist(), (8 * links_end).tolist(), 0, 0
        for j, token, end in zip(chosen, tokens_end, link, strict=True):
            groups[j], links[j] = b"".join(spelled[token_at:token])[:-1], keys[link_at:end]
            token_at, link_at = token, end


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabets write bytes that print as themselves and the rest from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A blank and the text, cut before blanks that no token crosses."""
    text, begin = " " + text, 0
    while len(text) - begin > size:
        cut = _SAFE.search(text, begin + size - 1)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def intervals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each elementary interval: its end, its token on either side, and whether both end with it."""
    ends = np.union1d(a_ends, b_ends)
    a, b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return ends, a, b, (a_ends[a] == ends) & (b_ends[b] == ends)


class _Document:
    """What the pieces of one document add up to."""

    def __init__(self) -> None:
        self.sound, self.sha, self.numbers = True, hashlib.sha256(), np.zeros(len(NUMBERS), np.int64)
        self.text: list[bytes] = []
        self.keys, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def empty(self) -> bool:
        return not self.numbers[0]

    def add(self, pair: Pair, words: list[str], keep: bool) -> None:
        at = [pair.index[w] for w in words]
        numbers = pair.numbers[at]
        self.sound &= bool((numbers[:, 0] >= 0).all())
        if not self.sound:
            return
        spelled = b";".join([pair.groups[i] for i in at])
        self.sha.update(spelled if self.empty else b";" + spelled)
        if keep:
            self.text.append(spelled)
        self.numbers = self.numbers + numbers.sum(axis=0)
        keys, times = np.unique(np.frombuffer(b"".join([pair.links[i] for i in at]), "<i8"), return_counts=True)
        self.keys, self.times = _added((self.keys, self.times), (keys, times)) if len(self.keys) else (keys, times)


def _added(*lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of keys as one, sorted and without repeats, and their numbers added."""
    keys, at = np.unique(np.concatenate([k for k, _ in lists]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, np.concatenate([n for _, n in lists]))
    return keys, total


def pack_pairs(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted keys and how often each occurs, deflated: bytes of one weight stand together."""
    steps = np.diff(keys, prepend=0)
    return zlib.compress(np.concatenate([steps.astype("<i8").view(np.uint8).reshape(-1, 8).T.ravel(), times.astype("<i8").view(np.uint8).reshape(-1, 8).T.ravel()]).tobytes(), 1)


def unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(2, 8, -1)
    steps, times = (np.ascontiguousarray(x.T).view("<i8").ravel() for x in raw)
    return np.cumsum(steps), times


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_products long, groups_sha256 string, pairs binary"


def _align(a_path: str, b_path: str, with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                docs = [_Document() for _ in range(part.num_rows)]
                cut: list[tuple[_Document, list[str]]] = []
                held = 0

                def settle(cut: list[tuple[_Document, list[str]]]) -> None:
                    pair.renew(set().union(*(words for _, words in cut)))
                    for doc, words in cut:
                        if doc.sound:
                            doc.add(pair, words, with_groups)

                for doc, text in zip(docs, part.column("text"), strict=True):
                    for piece in pieces(text.as_py()) if text.is_valid and text.as_py() else ():
                        cut.append((doc, _SAFE.split(piece[1:])))
                        held += len(piece)
                        if held > 4 * PIECE:
                            settle(cut)
                            cut, held = [], 0
                settle(cut)
                docs = [d if d.sound else _Document() for d in docs]
                numbers = dict(zip(NUMBERS, np.stack([d.numbers for d in docs], axis=1), strict=True))
                texts = {"groups": pa.array([b";".join(d.text).decode() for d in docs], pa.string())} if with_groups else {}
                yield batch(doc_id=part.column("doc_id"), **numbers, groups_sha256=pa.array(["" if d.empty else d.sha.hexdigest() for d in docs], pa.string()), pairs=pa.array([None if d.empty else pack_pairs(d.keys, d.times) for d in docs], pa.binary()), **texts)

    return run


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: row (its number), doc_id, n_a, n_b, n_groups, n_links, n_products, groups_sha256, pairs and, if asked, groups.

    a_path: a byte-level tokenizer file of the tokenizers library; b_path: a sentencepiece model
    with byte fallback.  groups: ``a1,a2|b1;a3|b2,b3``, ids in order.  n_products: pairs of ids
    within groups.  pairs: see unpack_pairs(), keys of A id times 2**32 plus B id and how many
    links of the document have each.

    Null and empty texts, and texts that either side does not give back byte by byte, have no
    tokens: zeros, an empty hash and no pairs.  Repeated rows have a row each, an empty table
    gives an empty one; columns besides the two are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = arrow_map(source, _align(a_path or file_path(A_FILE), b_path or file_path(B_FILE), with_groups), _ALIGNED + ", groups string" * with_groups)
    return written(found.select(F.monotonically_increasing_id().alias("row"), "*"), "aligned")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting, size = [], 0
    for b in batches:
        for packed in b.column("pairs"):
            waiting.append(unpack_pairs(packed.as_py()))
            size += len(waiting[-1][0])
            if size > HELD:
                waiting = [_added(*waiting)]
                size = len(waiting[0][0])
                if 2 * size > HELD:
                    yield batch(pair=waiting[0][0], n=waiting[0][1])
                    waiting, size = [], 0
    if waiting:
        keys, times = _added(*waiting)
        yield batch(pair=keys, n=times)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a, b, n (links of the corpus that hold it) and best (whether no pair of its B id has more), as a written table."""
    sums = arrow_map(aligned.select("pairs").where(F.col("pairs").isNotNull()), _summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    named = written(sums.select("pair", F.shiftright("pair", _SHIFT).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)).alias("b"), "n"), "pairs")
    most = named.groupBy("b").agg(F.max("n").alias("most"))
    return written(named.join(most, "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def _frequent(counts: DataFrame, most: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """The rest of the counts, and the frequent pairs with their numbers: at most ``most``, found by a histogram of 16 steps a doubling."""
    step = F.floor(F.log2("n") * 16)
    steps = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("s")).collect()  # at most 16 * 63 rows
    held, floor = 0, None
    for s, c in steps:
        if held + c > most:
            break
        held, floor = held + c, s
    if floor is None:
        return counts, *(np.zeros(0, t) for t in (np.int64, np.int64, bool))
    top = counts.where(step >= floor).select("pair", "n", "best").toArrow().sort_by("pair")
    return counts.where(step < floor), *(top.column(c).to_numpy() for c in ("pair", "n", "best"))


def _read(frequent: np.ndarray, n: np.ndarray, best: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums, bests, keys, times, sizes = [], [], [], [], []
            for packed in b.column("pairs"):
                k, t = unpack_pairs(packed.as_py()) if packed.is_valid else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                at = np.minimum(np.searchsorted(frequent, k), max(0, len(frequent) - 1))
                met = frequent[at] == k if len(frequent) else np.zeros(len(k), bool)
                sums.append(int((n[at[met]] * t[met]).sum()))
                bests.append(int(t[met][best[at[met]]].sum()))
                keys.append(k[~met])
                times.append(t[~met])
                sizes.append(len(keys[-1]))
            struct = pa.StructArray.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(times))], ["pair", "times"])
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), struct)
            yield batch(row=b.column("row"), n_best=np.array(bests, np.int64), count_sum=np.array(sums, np.int64), rest=rest)

    return run


def link_scores(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """align()'s rows with n_best (links whose pair no other of its B id surpasses in the corpus) and count_sum (of its pairs' counts over its links)."""
    rest, *top = _frequent(pair_counts(aligned), frequent)
    read = written(arrow_map(aligned.select("row", "pairs"), _read(*top), "row long, n_best long, count_sum long, rest array<struct<pair:long,times:long>>"), "scores")
    others = read.where(F.size("rest") > 0).select("row", F.explode("rest").alias("e")).select("row", "e.pair", "e.times").join(rest, "pair")
    more = others.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    both = read.select("row", "n_best", "count_sum").join(more, "row", "left").select("row", *((F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))))
    return aligned.join(both, "row")


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_products")
