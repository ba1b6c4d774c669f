"""The document operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayside.llm import components, ctph, decontaminate, htmltext, langid, linededup, packing, queries, records, simhash, substrings, tokens, urlfilter, wordhash

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns under names that the operators use themselves.
CLASHES = {"ord": 1, "tag": "x", "h1": 2, "component": 3, "lines": "y", "f0": 4}


def words(rng, n, size=40):
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(size)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages and lines, empty, null, short and long texts, odd white space."""
    rng = random.Random(5)
    passage, line = words(rng, 70), "A Line that Many documents hold"
    out = [None, "", " \t\n", "one", "Two words", passage, passage, passage.upper(), line, f"  {line.lower()}\r\n{line}\nother\n"]
    for k in range(40):
        own = words(rng, rng.randrange(1, 200), 4000)
        out.append({0: f"{own} {passage} {own[:30]}", 1: f"{own}\n{line}\nshort\n\n{line}", 2: own, 3: own.replace(" ", "\x0b", 3) + " été K İ"}[k % 4])
    base = words(rng, 150, 9000).split()
    for k in range(12):
        near = list(base)
        near[7 * k % 150] = f"changed{k}"
        out.append(" ".join(near))
    out.append(words(rng, 30_000, 9000) + " " + passage)
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_decontamination(spark, docs, texts, monkeypatch):
    items = [("b", texts[5][1]), ("a", "one"), (None, "Two words"), ("c", None), ("d", "no such words anywhere")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    want = sorted(decontaminate.brute_force(texts, items), key=repr)
    got = decontaminate.digest(decontaminate.benchmark_hits(docs, benchmark))
    assert rows(got) == want
    # A bitmap of 32768 bits that is nearly full lets more windows through to the join, and no other result out of it.
    monkeypatch.setattr(decontaminate, "_held", lambda bitmap, values: np.ones(len(values), bool))
    assert rows(decontaminate.digest(decontaminate.benchmark_hits(docs.where("doc_id < 30"), benchmark))) == [w for w in want if w[0] < 30]
    monkeypatch.undo()
    clean = decontaminate.drop_contaminated(docs, benchmark)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in want if not r[5]}


def test_winnowing_holds_a_pick_in_every_window():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 50, 400).astype(np.uint64)
    picks = set(wordhash.winnow(grams, 6, np.ones(395, bool)).tolist())
    assert all(picks & set(range(i, i + 6)) for i in range(395))


def test_substring_dedup(docs, texts):
    assert rows(substrings.digest(substrings.remove_repeats(docs))) == sorted(substrings.brute_force(texts), key=repr)
    few = texts[:30]
    some = docs.where("doc_id < 30")
    for window, first in ((8, 25), (8, 2), (2, 1), (7, 3)):
        assert rows(substrings.digest(substrings.remove_repeats(some, window, first))) == sorted(substrings.brute_force(few, window), key=repr)


def test_levels_double_up_to_the_window():
    assert substrings.levels(50, 25) == [25, 50]
    assert substrings.levels(50, 6) == [7, 13, 25, 50]
    assert substrings.levels(200, 25) == [25, 50, 100, 200]


def test_line_dedup(docs, texts):
    want = sorted(linededup.brute_force(texts), key=repr)
    assert rows(linededup.digest(linededup.dedup_lines(docs))) == want
    kept = linededup.drop_lines(docs)
    assert kept.columns == docs.columns
    digests = {r[0]: r[3] for r in want}
    assert all(hashlib.sha256((r.text or "").encode()).hexdigest() == digests[r.doc_id] for r in kept.collect())


def test_simhash(docs, texts):
    assert rows(simhash.digest(simhash.groups(docs))) == sorted(simhash.brute_force(texts), key=repr)


def shingles(text, size=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) + 1 - size))} if w else set()


def near_groups(texts, least=0.8):
    """The smallest id of each group whose members share ``least`` of their shingles."""
    sets, root = {i: shingles(t) for i, t in texts}, {i: i for i, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in root:
        for j in root:
            if j < i and (sets[i] == sets[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]))):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def test_near_copies_by_shingles(docs, texts, monkeypatch):
    want = near_groups(texts)
    for tile in (512, 3):  # one tile, and a group dealt to several
        monkeypatch.setattr(simhash, "SET_TILE", tile)
        grouped = simhash.groups(docs, 5, 32, 2, repeats=False, minima=6, least=0.8)
        assert {r.doc_id: r.component_id for r in grouped.collect()} == want
    kept = simhash.keep_first(docs, grouped)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_tiles_find_what_a_full_comparison_finds():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 300).astype(np.uint64)[:, None]
    prints[100:200] = prints[:100] ^ np.uint64(0b101)
    links = simhash.tile_links(prints, np.full(300, 2), 3)
    assert {tuple(sorted(x)) for x in links.tolist()} == {(i, i + 100) for i in range(100)}


def test_large_cells_in_tiles_along_the_population(spark, monkeypatch):
    rng = np.random.default_rng(8)
    # All share one part, so one cell holds them; many have one population count.
    prints = (rng.integers(0, 1 << 47, 240).astype(np.uint64) << np.uint64(16)) | np.uint64(0x1234)
    prints[200:] = prints[:40] ^ np.uint64(1 << 60 | 1 << 20)
    signed = [int(x) for x in prints.view(np.int64)]
    classes = spark.createDataFrame([(i, p, []) for i, p in enumerate(signed)], "node long, f0 long, minima array<long>")
    want = {(i, j) for i in range(240) for j in range(i + 1, 240) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 3}
    for tile in (7, 60):
        monkeypatch.setattr(simhash, "TILE", tile)
        got = {tuple(sorted(map(int, r))) for r in simhash.links(classes, 3).collect()}
        assert got <= want and dict(rows(components.components(spark.createDataFrame(sorted(got), "a long, b long")))) == dict(rows(components.components(spark.createDataFrame(sorted(want), "a long, b long"))))
        many = classes.select("node", "f0", F.lit(0).alias("part"), F.lit(0).cast("long").alias("cell"), F.bit_count("f0").alias("population"))
        shipped = simhash._tiled(many, 3, ["f0"])
        spans = shipped.groupBy("ti", "tj", "side").agg(F.min(F.bit_count("f0")).alias("low"), F.max(F.bit_count("f0")).alias("high")).collect()
        of = {(r.ti, r.tj, r.side): (r.low, r.high) for r in spans}
        assert all(of[i, j, 1][0] - of[i, j, 0][1] <= 3 for i, j, side in of if side == 0)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)]
    found = dict(rows(components.components(spark.createDataFrame(chain, "a long, b long"))))
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def whole_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    return [*t.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_records_round_trip(spark, docs, texts, tmp_path):
    path = f"file://{tmp_path}/records"
    shards = records.write_records(docs, path)
    start, want = 0, []
    for i, t in texts:
        ids = whole_ids(t)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert rows(records.read_records(spark, path, shards), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    shard, n = shards[0][0], shards[0][1]
    order = list(range(n))[::-1]
    index, _ = records.read_index(path, shard)
    for k, ids in zip(order, records.read_at(path, shard, order), strict=True):
        assert ids.tolist() == whole_ids(dict(texts)[int(index["doc_id"][k])])


def test_damaged_records_are_refused():
    import io

    good = records.frame(b"payload")
    assert records.unframe(io.BytesIO(good).read) == b"payload"
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(io.BytesIO(bytes(bad)).read)


def test_packing(docs, texts):
    packed = packing.pack(docs).collect()
    assert len({r.sequence_id for r in packed}) == len(packed)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 4096 for r in packed)
    for i, t in texts:
        ids, at = whole_ids(t), 0
        for r in sorted((r for r in packed if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)


def test_encoder_gives_the_ids_of_whole_texts():
    rng = random.Random(2)
    enc = tokens.Encoder(tokens.tokenizer_path(), limit=50)
    odd = ["", "Don't STOP!!", "<|endoftext|> x", "á é", "İstanbul ẞ", "x y z", "12345 6.7", "ﬁn ½", "...'s 've", "日本語 テキスト", "🙂🙂 ok"]
    many = odd + [words(rng, 50, 999) for _ in range(20)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode([t.encode() for t in many])] == [whole_ids(t)[:-1] for t in many]


def test_piecewise_fingerprints(docs, texts):
    got = {r.doc_id: r for r in ctph.compare_with_next(docs).collect()}
    assert len(got) == len(texts)
    plain = [t or "" for _, t in texts]
    prints = ctph.fingerprints([t.encode() for t in plain])
    for k, (i, _) in enumerate(texts):
        following = plain[(k + 1) % len(plain)]
        n = len(plain[k]) // 4
        edited = plain[k][: len(plain[k]) - n] + following[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(plain[k]), hashlib.sha256(edited.encode()).hexdigest(), prints[k])
        assert r.edited_fingerprint == ctph.fingerprints([edited.encode()])[0]
        assert r.near_next == ctph.likeness(prints[k], prints[(k + 1) % len(plain)])
        assert 0 <= r.near_edited <= 1
    assert got[5].fingerprint == got[6].fingerprint
    assert ctph.likeness(prints[5], prints[5]) == 1


def plain_mix(h):
    m = (1 << 64) - 1
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m
    h = (h ^ h >> 27) * 0x94D049BB133111EB & m
    return h ^ h >> 31


def plain_hash(data):
    return plain_mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, b in enumerate(data)) & ((1 << 64) - 1))


def plain_fingerprint(data):
    """Piecewise hashing byte by byte: a chunk ends where seven bytes hash to block size - 1 modulo block size."""
    if not data:
        return "3::"
    rolled = {i: plain_hash(data[i - 6 : i + 1]) >> 33 for i in range(6, len(data))}

    def ends(block):
        return [i + 1 for i, r in rolled.items() if r % block == block - 1]

    def signature(cuts, most):
        edges = [0, *cuts[: most - 1]]
        edges += [len(data)] if edges[-1] < len(data) else []
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        return "".join(letters[plain_hash(data[a:b]) >> 58] for a, b in zip(edges, edges[1:]))

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and len(ends(block)) + 1 < 32:
        block //= 2
    return f"{block}:{signature(ends(block), 64)}:{signature(ends(2 * block), 32)}"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + 2 * (x != y)))
    return row[-1]


def test_piecewise_fingerprints_byte_by_byte():
    rng = random.Random(12)
    made = ["", "a", "abcdefg", "x" * 500, words(rng, 20), words(rng, 90, 900), words(rng, 400, 9000), "é" * 90 + words(rng, 60)]
    made += [made[6][:900] + " new words here " + made[6][900:], made[6][300:]]
    found = ctph.fingerprints([t.encode() for t in made])
    assert found == [plain_fingerprint(t.encode()) for t in made]
    for p in found:
        for q in found:
            (m, a1, a2), (n, b1, b2) = p.split(":"), q.split(":")
            met = {(1, 1): [(a1, b1), (a2, b2)], (2, 1): [(a1, b2)], (1, 2): [(a2, b1)]}
            best = 0.0
            for (x, y), pairs in met.items():
                for a, b in pairs if int(m) * y == int(n) * x else []:
                    short = min(len(a), len(b))
                    run = min(short, 2 if short <= 8 else 3 if short <= 24 else 4)
                    if run and any(a[i : i + run] in b for i in range(len(a) + 1 - run)):
                        best = max(best, 1 - plain_distance(a, b) / (len(a) + len(b)))
            assert ctph.likeness(p, q) == pytest.approx(1.0 if p == q else best)


def test_many_rows_without_an_id_are_dealt_to_several_ranges(spark):
    rng = random.Random(3)
    texts = sorted(((None, words(rng, 12, 9000)) for _ in range(300)), key=repr)
    docs = spark.createDataFrame([*texts, (1, "first of all"), (1, "first again"), (1, "first again")], "doc_id long, text string")
    from wayside.llm import tables

    keyed = tables.keyed(docs)
    assert ctph._ranged(keyed, 8).select("p").distinct().count() >= 6
    order = [r.text for r in keyed.orderBy("ord", "tag").collect()]
    prints = [plain_fingerprint(t.encode()) for t in order]
    got = sorted((r.fingerprint, round(r.near_next, 9)) for r in ctph.compare_with_next(docs).collect())
    assert got == sorted((p, round(ctph.likeness(p, q), 9)) for p, q in zip(prints, prints[1:] + prints[:1]))


def test_piecewise_fingerprints_hold_through_edits():
    rng = random.Random(9)
    for n in (400, 4000):
        text = words(rng, n, 9000)
        changed = text[: len(text) // 2] + " inserted words " + text[len(text) // 2 :]
        a, b, c = ctph.fingerprints([text.encode(), changed.encode(), words(rng, n, 9000).encode()])
        assert ctph.likeness(a, b) > 0.8
        assert ctph.likeness(a, c) < 0.3


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op8_hierarchical_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in found if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98


def test_language_id_by_plain_loops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.train(docs)
    few = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(12).collect() if r.text]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(few, "doc_id long, text string"), model).collect()}
    for i, text in few:
        data = text.encode()
        b = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in data] + [32, 32]
        sums = model.weights[-1].astype(float).copy()
        for x, y, z in zip(b, b[1:], b[2:]):
            sums += (model.weights[((x << 8 | y) * 0x85EBCA6B & 0xFFFFFFFF) >> 20] + model.weights[4096 + (((x << 16 | y << 8 | z) * 0x9E3779B1 & 0xFFFFFFFF) >> 20)]) / len(data)
        margin = {key: sums[k] for key, k in model.column.items()}
        ranked = sorted(model.families, key=lambda f: -margin["family", f])
        names = model.languages[ranked[0]]
        votes = {v: 0.0 for v in names}
        for (kind, *pair), m in margin.items():
            if kind == "pair" and pair[0] in names:
                votes[pair[0] if m >= 0 else pair[1]] += 1
        assert got[i].lang_pred == max(names, key=votes.get)
        sure = 1 / (1 + math.exp(margin["family", ranked[1]] - margin["family", ranked[0]]))
        assert got[i].score <= sure + 1e-6


def test_language_id_cases(spark, docs, empty):
    model = langid.train(docs)
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert [got[0], got[1], got[2], got[3]] == ["und", "und", "und", "en"]
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.keep_known(docs, model).columns == docs.columns
    # Without languages to learn from, texts with a letter stay.
    assert {r.doc_id for r in langid.keep_known(docs, none).collect()} == {i for i, p in got.items() if p != "und"}


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Menu</a></nav><article><h1>T &amp; t</h1><p>One\n  two<p>Three <b>four</b></article><footer>f</footer>", "T & t\nOne two\nThree four"),
        ("<body><script>if (a<b) x('</p>')</script><article><p>Kept.</p><div class='comments'><p>Nice post</p></div><aside>Ad</aside><p>Also.</p></article>", "Kept.\nAlso."),
        ("<div id='sidebar'>links</div><p>" + "Long text here. " * 20 + "</p><div class='footer'>c</div>", ("Long text here. " * 20).strip()),
        ("<ul><li><a href=1>a</a><li><a href=2>b</a></ul>", ""),
        ("<article><p>x < y &lt; z &#233;<!-- no --></p></article>", "x < y < z é"),
    ],
)
def test_line_blocks(page, text):
    assert htmltext.main_text(page) == text


PARAGRAPH = "A sentence of the main text, long enough to surge. " * 8


@pytest.mark.parametrize("extra", ["<article><h3>Teaser</h3><p>Read this too.</p></article>", "<div><article><p>Card</p></article></div><article><p>Card</p></article>", ""])
def test_text_outside_of_a_teaser_article_is_kept(extra):
    got = htmltext.main_text(f"<body><div><h1>Title</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>{extra}</body>")
    assert got.count(PARAGRAPH.strip()) == 2


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='content no-sidebar'><p>{PARAGRAPH}</p><p>Short.</p><p>{PARAGRAPH}</p></div>",
        f"<form action=x><nav><p>Menu of the page</p></nav><div><p>{PARAGRAPH}</p><p>Short.</p><p>{PARAGRAPH}</p></div></form>",
        f"<div class='search-page'><p>{PARAGRAPH}</p><p>Short.</p><p>{PARAGRAPH}</p></div><div class='search'><p>Find</p></div>",
        f"<div class=widget><p>{PARAGRAPH}</p></div><div class=widget><p>Short.</p></div><div class=widget><p>{PARAGRAPH}</p></div>",
        f"<article><p>{PARAGRAPH}</p><p>Short.</p><div class='widget-text'><p>{PARAGRAPH}</p></div></article>",
        f"<p>{PARAGRAPH}</p><div class=ad>1</div><div class=ad>2</div><div class=ad>3</div><p>Short.</p><div class=ad>1</div><div class=ad>2</div><div class=ad>3</div><p>{PARAGRAPH}</p>",
    ],
)
def test_marks_do_not_delete_the_main_text(page):
    paragraph = PARAGRAPH.strip()
    want = [paragraph, "Short.", paragraph]
    if "<article>" in page:  # as long as the rest, and after it
        page = page.replace("</article>", "<p>End.</p></article>")
        want.append("End.")
    assert htmltext.main_text(page) == "\n".join(want)


def test_marks_still_tell_furniture():
    comments = f"<div id=comments>{f'<p>{PARAGRAPH}</p>' * 5}</div>"
    assert htmltext.main_text(f"<article><h1 class='entry-header'>Title</h1><p>{PARAGRAPH}</p></article>{comments}") == f"Title\n{PARAGRAPH.strip()}"
    assert htmltext.main_text(f"<div><p>{PARAGRAPH}</p></div>{comments}<div hidden>{PARAGRAPH}</div>") == PARAGRAPH.strip()


def test_surge_and_dive_decide_in_articles():
    links = "".join(f"<p><a href={k}>Read more of number {k}</a></p>" for k in range(4))
    page = f"<article><h1>Title</h1><p>By me</p><p>{PARAGRAPH}</p><p>Short.</p>{links}</article><p>Outside.</p>"
    assert htmltext.main_text(page) == "\n".join(["Title", "By me", PARAGRAPH.strip(), "Short."])


def plain_line_blocks(lines, window=3, surge=86):
    """From the first line of the first window whose lengths reach the threshold to where a window is empty after the last such one."""
    length = [0 if furniture else len(t) for t, furniture in lines]
    sums = [sum(length[i : i + window]) for i in range(len(lines))]
    if not any(sums):
        return ""
    surges = [i for i, x in enumerate(sums) if x >= min(surge, max(sums))]
    end = surges[-1]
    while end < len(lines) and sums[end]:
        end += 1
    return "\n".join(t for (t, _), n in list(zip(lines, length))[surges[0] : end] if n)


def random_pages(count):
    rng = random.Random(21)
    for _ in range(count):
        lines = []
        for _ in range(rng.randrange(1, 25)):
            furniture = rng.random() < 0.5
            lines.append((words(rng, rng.choice((1, 2, 3, 12, 40)) if not furniture else 1), furniture))
        yield lines, "".join(f"<div class=ad>{t}</div>" if f else f"<p>{t}</p>" for t, f in lines)


def test_line_windows_against_plain_loops():
    pages = [(lines, html) for lines, html in random_pages(300) if 3 * sum(len(t) for t, f in lines if f) < sum(len(t) for t, _ in lines)]
    assert len(pages) > 100
    for lines, html in pages:
        assert htmltext.main_text(html) == plain_line_blocks(lines)


def test_without_surge_and_dive_pages_have_other_texts(monkeypatch):
    pages = [html for _, html in random_pages(300)]
    in_article = [f"<article>{html}</article>" for html in pages]
    before = [[htmltext.main_text(h) for h in some] for some in (pages, in_article)]
    monkeypatch.setattr(htmltext, "SURGE", 1)
    for some, texts in zip((pages, in_article), before, strict=True):
        assert sum(htmltext.main_text(h) != t for h, t in zip(some, texts, strict=True)) > 20


def test_extraction_of_odd_pages(spark):
    long = "<p>" + "word " * 400_000 + "</p>"
    few = [(1, "u", long), (1, "u", long), (None, None, None), (2, "v", ""), (3, None, "<p>Only this.")]
    pages = spark.createDataFrame(few, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "n_chars": F.lit(1)})
    got = htmltext.extract(pages)
    assert rows(got, "page_id", "url", "n_chars") == sorted([(1, "u", 1_999_999)] * 2 + [(None, None, 0), (2, "v", 0), (3, None, 10)], key=repr)
    assert htmltext.extract(pages.where("page_id > 9")).count() == 0


def test_pages_have_articles_without_furniture(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").limit(50).collect()
    for r in pages:
        got = htmltext.main_text(r.html)
        assert got and "<" not in got and got == "\n".join(" ".join(x.split()) for x in got.split("\n"))


def test_url_intervals_and_verdicts(spark):
    entries = [("l", "host", "a.org", "block", "add", 100), ("l", "host", "a.org", "block", "remove", 200), ("m", "domain", "org", "allow", "add", 0), ("m", "path", "a.org/x", "allow", "add", 150), (None, "host", "b.net", None, "add", 5), ("l", None, "z", "block", "add", 1)]
    captures = [(1, "http://A.org/", 100), (2, "http://a.org/y", 199), (3, "http://a.org./y", 200), (4, "https://u@a.org:8/x/y?q", 160), (5, None, 1), (6, "http://c.com", None), (7, "/relative", 3), (8, "http://b.net", 5), (8, "http://b.net", 5)]
    got = urlfilter.evaluate(spark.createDataFrame(captures, "page_id long, url string, fetched_at long"), spark.createDataFrame(entries, "list string, kind string, value string, action string, event string, listed_at long"))
    assert rows(got, "page_id", "n_active", "verdict") == sorted([(1, 2, "block"), (2, 2, "block"), (3, 1, "allow"), (4, 3, "allow"), (5, 0, "none"), (6, 0, "none"), (7, 0, "none"), (8, 1, "block"), (8, 1, "block")], key=repr)
    none = spark.createDataFrame([], "list string, kind string, value string, action string, event string, listed_at long")
    empty = spark.createDataFrame([], "page_id long, url string, fetched_at long")
    assert urlfilter.evaluate(empty, spark.createDataFrame(entries, none.schema)).count() == 0
    clashing = spark.createDataFrame(captures, empty.schema).withColumns({"kind": F.lit(1), "value": F.lit("x"), "month": F.lit(0), "copies": F.lit(9)})
    assert urlfilter.evaluate(clashing, spark.createDataFrame(entries, none.schema)).where("n_active > 0").count() == 6
    assert urlfilter.evaluate(spark.createDataFrame(captures, "page_id long, url string, fetched_at long"), none).where("verdict != 'none'").count() == 0


def test_urls_of_odd_hosts_as_in_sql(spark, tmp_path):
    import duckdb

    hosts = ["[2001:db8::1]", "[::1]:8080", "10.0.0.7", "192.168.1.1:80", "a" * 300 + ".example.org", ".".join(["x"] * 200) + ".example.net", "u:p@WWW.Example.org.", "example.org", "-", "."]
    urls = [f"http://{h}/{p}" for h in hosts for p in ("", "en", "en/" + "deep/" * 300, "EN?q#f")] + [None, "", "no url", "http://", "http:///en"]
    spark.createDataFrame(list(enumerate(urls * 3)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    mine = queries.op4_temporal_url_filter(spark, str(tmp_path))
    theirs = con.execute(queries.ORACLE_SQL["op4_temporal_url_filter"])
    columns = [c[0] for c in theirs.description]
    want = sorted((tuple(v if c != "host" else v or "" for c, v in zip(columns, r, strict=True)) for r in theirs.fetchall()), key=repr)
    assert rows(mine.select(*columns)) == want


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    few = [(None, "some text of a few words"), (None, None), (3, "some text of a few words"), (3, "some text of a few words"), (3, "another text"), (2, "Some text of a few words")]
    docs = spark.createDataFrame(few, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASHES.items()})
    benchmark = spark.createDataFrame([("q", "another text")], "item_id string, text string")
    for made in (
        decontaminate.benchmark_hits(docs, benchmark),
        substrings.remove_repeats(docs, 4),
        linededup.dedup_lines(docs),
        simhash.groups(docs),
        simhash.groups(docs, 5, 32, 2, False, 6, 0.8),
        ctph.compare_with_next(docs),
        langid.predict(docs.withColumn("lang", F.lit("en")), langid.train(docs.withColumn("lang", F.lit("en")))),
    ):
        assert made.count() == len(few)
    for made in (decontaminate.drop_contaminated(docs, benchmark), linededup.drop_lines(docs), simhash.keep_first(docs, simhash.groups(docs))):
        assert made.columns == docs.columns
        assert made.count()
    grouped = simhash.groups(docs)
    assert {r.component_id for r in grouped.where("doc_id is not null").collect()} == {2}
    assert packing.pack(docs).where("start = 0").count() == len(few)


def test_equal_fingerprints_of_different_texts_are_compared_each(spark):
    rng = random.Random(4)
    base = words(rng, 10_004, 900_000).split()

    def prints(w):
        h = np.unique(simhash.shingle_hashes(" ".join(w).encode(), 5))
        return simhash.majority(h), simhash.majority(simhash.mix(h ^ np.uint64(0x9E3779B97F4A7C15 * 3 & ((1 << 64) - 1))))

    first = prints(base)
    for k in range(200):  # until a changed word leaves all 128 bits equal
        changed = [*base[: 20 + k], f"changed{k}", *base[21 + k :]]
        if prints(changed) == first:
            break
    assert prints(changed) == first
    # The third shares 0.8 of its shingles with the second, and less with the first.
    few = [(1, " ".join(base)), (2, " ".join(changed)), (3, " ".join(changed[:8004]))]
    grouped = simhash.groups(spark.createDataFrame(few, "doc_id long, text string"), 5, 32, 2, repeats=False, minima=6, least=0.8)
    assert {r.doc_id: r.component_id for r in grouped.collect()} == {1: 1, 2: 1, 3: 1} == near_groups(few)


def test_rows_without_ids_are_documents_of_their_own(spark):
    rng = random.Random(11)
    long, other = (words(rng, 60, 9000) for _ in range(2))
    line = "a line that two rows without ids hold"
    few = [(5, long), (9, other), (None, long), (None, other), *((None, f"{line}\n{words(rng, 40, 9000)}") for _ in range(2)), (None, f"{passage(rng)} {PASSAGE}"), (None, f"{passage(rng)} {PASSAGE}")]
    docs = spark.createDataFrame(few, "doc_id long, text string").repartition(3)
    for options in ((), (5, 32, 2, False, 6, 0.8)):
        grouped = simhash.groups(docs, *options)
        assert {r.doc_id: r.component_id for r in grouped.where("doc_id is not null").collect()} == {5: 5, 9: 9}
        # One row of each text stays, with its id where it has one.
        assert rows(simhash.keep_first(docs, grouped)) == sorted([(5, long), (9, other), *few[4:]], key=repr)
    assert sum(r.text.count(line) for r in linededup.drop_lines(docs).collect()) == 1
    assert sum(r.text.count(PASSAGE) for r in substrings.remove_repeats(docs).collect()) == 1


PASSAGE = " ".join(f"shared{k}" for k in range(60))


def passage(rng):
    return words(rng, 20, 9000)


def test_rows_repeated_thousands_of_times(spark):
    rng = random.Random(17)
    text = words(rng, 200, 9000) + "\nand a line that all of them hold"
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(8, text), (9, "other")], "doc_id long, text string"))
    assert rows(substrings.remove_repeats(docs).groupBy("doc_id", "n_removed").count()) == [(7, 0, 3000), (8, 208, 1), (9, 0, 1)]
    assert rows(linededup.dedup_lines(docs).groupBy("doc_id", "n_dropped").count()) == [(7, 0, 3000), (8, 2, 1), (9, 0, 1)]
    benchmark = spark.createDataFrame([("q", text[:300])], "item_id string, text string")
    assert decontaminate.benchmark_hits(docs, benchmark).where("n_hit > 0").count() == 3001


def test_buckets_and_batches(spark, docs, tmp_path):
    packed = packing.pack(docs, batch_tokens=4096, with_ids=True)
    packing.write_buckets(packed, f"{tmp_path}/buckets")
    back = spark.read.parquet(f"{tmp_path}/buckets")
    assert back.where("length != cast(pow(2, bucket) as int) or length(ids) != 4 * length").count() == 0
    assert rows(back, "doc_id", "start", "ids_crc32") == rows(packed, "doc_id", "start", "ids_crc32")
    batches = packed.groupBy("bucket", "batch_id").agg(F.sum("length").alias("n"), F.countDistinct("length").alias("k"))
    assert batches.where("n > 4096 or k != 1").count() == 0
    assert batches.where("n = 4096").count() > 0


def test_empty_tables(spark, empty, docs, tmp_path):
    benchmark = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.benchmark_hits(docs, benchmark).where("n_hit > 0").count() == 0
    for made in (decontaminate.benchmark_hits(empty, benchmark), substrings.remove_repeats(empty), linededup.dedup_lines(empty), simhash.groups(empty), simhash.groups(empty, 5, 32, 2, False, 6, 0.8), packing.pack(empty), ctph.compare_with_next(empty), langid.predict(empty, langid.train(empty))):
        assert made.count() == 0
    path = f"file://{tmp_path}/none"
    assert records.read_records(spark, path, records.write_records(empty, path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        path = f"{SMALL}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    mine = queries.QUERIES[name](spark, SMALL)
    theirs = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in theirs.description]
    assert rows(mine.select(*columns)) == sorted(theirs.fetchall(), key=repr)


def test_pipeline_against_plain_loops(spark, docs, texts, tmp_path):
    import corpus_pipeline

    items = [("b", texts[5][1]), ("e", "a b c d e f g h i j k")]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(i, t) for i, t in texts if any(c.isalpha() for c in t or "")]
    digests = {r[0]: r[3] for r in linededup.brute_force(left)}
    deduped = []
    for i, t in left:
        kept, keys = [], {}
        for j, u in left:
            if j < i:
                keys |= {"".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r")): 1 for x in u.split("\n")}
        for x in t.split("\n"):
            k = "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
            if len(k) < 10 or k not in keys:
                kept.append(x)
        deduped.append((i, "\n".join(kept)))
        assert hashlib.sha256(deduped[-1][1].encode()).hexdigest() == digests[i]
    first = near_groups(deduped)
    single = [(i, t) for i, t in deduped if first[i] == i]
    clean = {r[0] for r in decontaminate.brute_force(single, items) if not r[5]}
    want = []
    for i, t in single:
        if i in clean:
            ids, at = whole_ids(t), 0
            for n in packing.pieces(len(ids)):
                want.append((i, at, n, crc(ids[at : at + n]), len(ids)))
                at += n
    got = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert rows(got, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == sorted(want, key=repr)
