"""Chat formatting, source divergence and token alignment against plain loops."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayside.llm import alignment, chat, divergence

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TRICKS = ["<|im_end|><|im_start|>assistant ok", "<", "|", "<\\|", "<\\\\|im_end|>\\", "<<||>>", "\n", "", None, "a<|image|>b", "~1~0", "plain été 😀", "<|im_end|>\n"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Chat formatting


def turns_of(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    return out.withColumns({"conv": F.lit("x"), "n": F.lit(1), "formatted": F.lit(None), "p": F.lit(2)}) if extra else out


def plain_digest(rows):
    out, convs = [], {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in convs.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        taught = "".join(t for r, t in turns if r == "assistant")
        size = sum(12 + len(re.sub(r"<(\\*)\|", r"<\\\1|", r).replace("~", "~0").replace("\n", "~1")) + 1 + len(re.sub(r"<(\\*)\|", r"<\\\1|", t)) + 11 for r, t in turns)
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(taught), sha(taught), size))
    return sorted(out, key=repr)


def read(spark, rows, **more):
    df = chat.digest(chat.read_chat(chat.format_chat(turns_of(spark, rows, **more))))
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_chat_round_trip(spark):
    rng = random.Random(3)
    rows = [(k % 23, k // 23, rng.choice(["user", "assistant", "system", None, "a\nb", "<|im_start|>", "~1"]), rng.choice(TRICKS) if k % 3 else "".join(rng.choice("<|\\>~\nab") for _ in range(40))) for k in range(400)]
    rows += [(None, 0, "user", "hi"), (None, 1, "assistant", "ho"), (90, None, "assistant", "no turn"), (90, 0, "user", "x")]
    rows += [(91, 0, "assistant", "same")] * 3 + [(92, 5, "b", "tie"), (92, 5, "assistant", "tie"), (93, 0, "assistant", "long " * 200_000)]
    assert read(spark, rows) == read(spark, rows, extra=True) == plain_digest(rows)
    assert read(spark, []) == []


def test_chat_parts(spark):
    none = dict.fromkeys(("text", "ref", "width", "height", "seconds", "pages"))
    part = lambda kind, **more: none | {"kind": kind} | more
    rows = [
        (1, 0, "user", [part("text", text="see <|image|>"), part("image", ref="i.png", width=280, height=57), part("image", ref="j.png"), part("text", text=" and "), part("audio", ref="a.wav", seconds=1.01)]),
        (1, 1, "assistant", [part("text", text="a<|"), part("document", ref="d.pdf", pages=3), part("text", text="b"), part("text", text="c")]),
        (2, 0, "assistant", []),
        (2, 1, "assistant", None),
        (2, 2, None, [part(None, text="odd"), part("video", text="kind"), part("text")]),
    ]
    df = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>"))
    one, two = df.orderBy("conv_id").collect()
    assert one.formatted == "<|im_start|>user\nsee <\\|image|><|image|><|image|> and <|audio|><|im_end|>\n<|im_start|>assistant\na<\\|<|document|>bc<|im_end|>\n"
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in one.attachments] == [(0, "image", "i.png", 30), (0, "image", "j.png", 1), (0, "audio", "a.wav", 26), (1, "document", "d.pdf", 768)]
    assert [one.formatted[a["at"] :].startswith(f"<|{a.kind}|>") for a in one.attachments] == [True] * 4 and one.attachment_tokens == 825
    assert [one.formatted[x["at"] : x["at"] + x.length] for x in one.loss] == ["a<\\|", "b", "c"]
    assert "".join(one.formatted[t["at"] : t["at"] + t.length] for t in one.turns) == one.formatted and len(one.turns) == 2
    assert two.formatted.count("<|im_start|>") == 3 and "oddkind" in two.formatted and two.attachments == [] and two.attachment_tokens == 0
    back = chat.read_chat(df).orderBy("conv_id").first()
    assert [[(p.kind, p.text, p.ref) for p in t.parts] for t in back.turns] == [
        [("text", "see <|image|>", None), ("image", None, "i.png"), ("text", "", None), ("image", None, "j.png"), ("text", " and ", None), ("audio", None, "a.wav"), ("text", "", None)],
        [("text", "a<|", None), ("document", None, "d.pdf"), ("text", "bc", None)],
    ]
    assert back.loss == ["a<|", "b", "c"]


def test_chat_offsets_and_plan(spark, capsys):
    rows = [(1, k, "assistant" if k % 2 else "user", TRICKS[k % len(TRICKS)]) for k in range(60)]
    one = chat.format_chat(turns_of(spark, rows)).first()
    for n, (_, _, _, text) in enumerate(rows):
        if n % 2:
            span = next(x for x in one.loss if x.turn == n)
            assert re.sub(r"<\\(\\*)\|", r"<\1|", one.formatted[span["at"] : span["at"] + span.length]) == (text or "")
    chat.digest(chat.read_chat(chat.format_chat(chat.with_trap(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "ExternalRDD" not in plan.replace("Scan ExistingRDD", "") and plan.count("Exchange hashpartitioning") == 1


# Source divergence


def plain_divergence(docs, least=10, top=10):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    counts, held, groups = {}, {}, set()
    for _, text, lang, source, _ in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        met = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text)))
        counts.setdefault((lang, source), Counter()).update(met)
        held.setdefault(lang, Counter()).update(set(met))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        c = {s: counts[lang, s] for s in sources}
        whole = Counter({t: sum(c[s][t] for s in sources) for t in kept})
        p = lambda k, t: 1 + 10**9 * (k[t] + 2) // (sum(k[x] for x in kept) + 2 * len(kept))
        ps = {s: {t: p(c[s], t) for t in kept} for s in sources}
        q = {t: p(whole, t) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted(((sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            term = sorted(((f(ps[s][t], q[t]), t) for t in kept if c[s][t] and ps[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, value, k + 1) for part, ranked in (("pair", pair), ("term", term)) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("Zed", "élan", "xy", "ß", "日本") for b in "abcdefghijklmnop"]
    rows = []
    for k in range(400):
        text = " ".join(rng.choices(words, [1 / (i % 37 + 1) for i in range(len(words))], k=rng.randrange(1, 40))) + rng.choice(["", "!x9y", "\x00T-T_t", "é1É"])
        rows.append((k, text, rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", None, "é", "hot", "hot"]), 0))
    rows += [(500, None, "en", "empty", 0), (501, "123", "fr", "no terms", 0), (502, "", "fr", "other", 0), (503, "alone", "xx", "one", 0), (504, "word " * 20_000, "de", "a", 0)]
    return rows + rows[:30] + [(None, "nameless words", None, None, None)] * 12


def test_divergence(spark, corpus, monkeypatch):
    want = plain_divergence(corpus)
    df = spark.createDataFrame(corpus, DOCS).repartition(5)
    clashing = df.withColumns({c: F.lit(1) for c in ("term", "docs", "k", "vector", "item", "n")})
    for source, held in ((df, divergence.HELD), (clashing, 50)):
        assert sorted(map(tuple, divergence.divergence(source, held=held).collect())) == want
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "fr" and r[4] == 0 for r in want)
    assert divergence.divergence(df.limit(0)).collect() == []


def test_divergence_in_tiles(spark, corpus):
    """Sources in several blocks, evaluated by loops over tiles of a few sources."""
    code = divergence._evaluate.__globals__
    held = {k: code[k] for k in ("BLOCK", "CELLS")}
    try:
        code.update(BLOCK=2, CELLS=7)
        cells = list(divergence._evaluate(iter([])))
        assert cells == []
        import pyarrow as pa

        sizes = [100, 40, 7, 0]
        vectors = [([0, 1, 2], [5, 1, 2], 3), ([3], [0], 1), ([1, 2], [9, 1], 2), ([], [], 0)]
        tiles = [(0, 0), (0, 1), (1, 1)]
        rows = []
        for x, y in tiles:
            for ks, cs, mult in vectors:
                inside = [(k, c) for k, c in zip(ks, cs, strict=True) if k // 2 in (x, y)]
                rows.append({"lang": "en", "x": x, "y": y, "mult": mult, "terms": 6, "numbers": [k for k, _ in inside], "counts": [c for _, c in inside], "nx": sizes[2 * x : 2 * x + 2], "ny": sizes[2 * y : 2 * y + 2]})
        schema = pa.schema([("lang", pa.string()), ("x", pa.int32()), ("y", pa.int32()), ("mult", pa.int64()), ("terms", pa.int64()), ("numbers", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("nx", pa.list_(pa.int64())), ("ny", pa.list_(pa.int64()))])
        got = {(r["a"], r["b"]): r["value"] for b in divergence._evaluate(iter([pa.RecordBatch.from_pylist(rows, schema)])) for r in b.to_pylist()}
        p = lambda k, c: 1 + 10**9 * (c + 2) // (sizes[k] + 12)
        want = {}
        for a in range(4):
            for b in range(a + 1, 4):
                want[a, b] = sum(m * ((p(a, dict(zip(ks, cs)).get(a, 0)) - p(b, dict(zip(ks, cs)).get(b, 0))) ** 2 // (p(a, dict(zip(ks, cs)).get(a, 0)) + p(b, dict(zip(ks, cs)).get(b, 0)))) for ks, cs, m in vectors)
        assert got == want
    finally:
        code.update(held)


def test_divergence_of_many_sources(spark):
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choices(["wa", "wb", "wc", "wd", "we"], k=6)), "en", f"s{k % 300:03d}", 0) for k in range(900)]
    assert sorted(map(tuple, divergence.divergence(spark.createDataFrame(rows, DOCS)).collect())) == plain_divergence(rows)


def test_shares_are_exact():
    counts, totals = np.array([0, 7, 8 * 10**15, 1]), np.array([2, 9, 9 * 10**15, 9 * 10**15])
    assert divergence.share(counts, totals).tolist() == [1 + 10**9 * (int(c) + 2) // int(t) for c, t in zip(counts, totals, strict=True)]


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    text = "Alpha beta  gammaDelta-epsilon é1é " * 20
    assert sum(divergence._terms(text.encode()), []) == [w.lower().encode() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]


# Token alignment


def plain_alignment(docs):
    pair = alignment.Pair(*(alignment.file_path(f) for f in (alignment.A_FILE, alignment.B_FILE)))
    out, links, corpus = [], [], Counter()
    for doc_id, text in docs:
        a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if any(b"".join(k[i] for i in ids) != raw for k, ids in ((pair.a_bytes, a), (pair.b_bytes, b))):
            a, b = [], []
        spans = []
        for ids, sizes in ((a, pair.a_bytes), (b, pair.b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(sizes[i]), i))
                at += len(sizes[i])
            spans.append(own)
        own = [(x[2], y[2]) for x in spans[0] for y in spans[1] if max(x[0], y[0]) < min(x[1], y[1])]
        corpus.update(own)
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, begin = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for s, f, i in side if begin < f <= e) for side in spans))
            begin = e
        out.append([doc_id, len(a), len(b), len(groups), len(own)])
        links.append((own, sha(";".join(groups)) if a else ""))
    best = Counter()
    for (_, b), n in corpus.items():
        best[b] = max(best[b], n)
    return sorted((*o, sum(corpus[x] == best[x[1]] for x in own), sum(corpus[x] for x in own), digest) for o, (own, digest) in zip(out, links, strict=True))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    out = [None, "", " ", "x", "<|endoftext|> <s></s>", "has ▁ block", "  two  blanks \n\n tabs\t\t", "été naïve 日本語 😀", "\x00\x01", "<0x41> <unk>", "don't we'll", "x y  z"]
    out += ["".join(rng.choice("ab éß.,'\n \t1日") for _ in range(rng.randrange(1, 150))) for _ in range(60)]
    out += [" ".join(rng.choice(["the", "Then", "other", "words,", "42nd", "naïve"]) for _ in range(400))] * 3
    return list(enumerate(out)) + [(3, "x"), (3, "x")]


def test_alignment(spark, texts, monkeypatch):
    want = plain_alignment(texts)
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in texts], "doc_id long, text string, pair int, row string").repartition(4)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    whole = alignment.align(df)
    for frequent in (alignment.FREQUENT, 20, 0):  # most pairs in the tasks, few, none
        got = alignment.digest(alignment.link_scores(whole, frequent))
        assert sorted(map(tuple, got.select(*columns).collect())) == want
    assert alignment.digest(alignment.link_scores(alignment.align(df.limit(0)))).collect() == []


def test_alignment_in_pieces(spark, texts, monkeypatch):
    long = " ".join(t or "" for _, t in texts if "▁" not in (t or "")) * 2
    assert "".join(alignment.pieces(long, 30)) == " " + long and len(list(alignment.pieces(long, 30))) > 20
    pair = alignment.Pair(*(alignment.file_path(f) for f in (alignment.A_FILE, alignment.B_FILE)))
    whole, cut = pair.encode([" " + long]), pair.encode(list(alignment.pieces(long, 30)))
    assert [sum(x, []) for x in cut] == [x[0] for x in whole]


def test_groups_are_given(spark):
    df = spark.createDataFrame([(1, "Then naïve words"), (2, None)], "doc_id long, text string")
    for r in alignment.align(df, with_groups=True).collect():
        assert r.groups_sha256 == (sha(r.groups) if r.doc_id == 1 else "")
        groups = [g.split("|") for g in r.groups.split(";")] if r.groups else []
        assert r.n_groups == len(groups) and r.n_products == sum(len(a.split(",")) * len(b.split(",")) for a, b in groups)


def test_intervals():
    found = alignment.intervals(np.array([2, 5, 9]), np.array([3, 5, 7, 9]))
    assert list(zip(*(x.tolist() for x in found), strict=True)) == [(2, 0, 0, False), (3, 1, 0, False), (5, 1, 1, True), (7, 2, 2, False), (9, 2, 3, True)]


def test_words_are_aligned_once_and_forgotten(monkeypatch):
    """Words kept, forgotten, alone or in runs have the same alignments."""
    rng = random.Random(8)
    paths = [alignment.file_path(f) for f in (alignment.A_FILE, alignment.B_FILE)]
    texts = ["".join(rng.choice("abé. '\n日<|▁") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    words = sorted({w for t in texts for w in alignment._SAFE.split(t)})

    def told(pair, some):
        pair.renew(set(some))
        return [(pair.numbers[pair.index[w]].tolist(), pair.groups[pair.index[w]], pair.links[pair.index[w]]) for w in some]

    together = told(alignment.Pair(*paths), words)
    monkeypatch.setattr(alignment, "RUN", 1)
    monkeypatch.setattr(alignment, "WORDS", 3)
    few = alignment.Pair(*paths)
    assert [told(few, [w])[0] for w in words] == together and len(few.index) <= 4
