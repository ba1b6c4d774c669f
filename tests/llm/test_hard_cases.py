"""Cases that once cost too much or came out wrong: odd times, shared passages, unclosed furniture."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayside.llm import decontaminate, htmltext, langid, packing, tables, tokens, urlfilter

ENTRIES = "list string, kind string, value string, action string, event string, listed_at long"
CAPTURES = "page_id long, url string, fetched_at long"


def plain_verdict(entries, host, at):
    """Actions of a host's entries that are valid at a time, the host's own only."""
    active = []
    for lst, value in {(e[0], e[2]) for e in entries}:
        events = {}
        for e in sorted((e for e in entries if (e[0], e[2]) == (lst, value)), key=lambda e: (e[5], e[4], e[3])):
            events[e[5]] = (e[4], e[3])
        times = sorted(events)
        for t, following in zip(times, [*times[1:], None]):
            if events[t][0] == "add" and value == host and at is not None and t <= at and (following is None or at < following):
                active.append((events[t][1], lst))
    return (len(active), max(active)[0]) if active else (0, "none")


def test_odd_fetch_times(spark):
    rng = random.Random(9)
    odd = [None, 0, -1, -(10**12), 17040700000, 170407000000, 1704070000000, 253402300799, (1 << 62) - 5, 10**18, -(1 << 62)]
    entries = [(rng.choice("lm"), "host", f"h{rng.randrange(4)}.org", rng.choice(["block", "allow"]), rng.choice(["add", "add", "remove"]), rng.choice([0, 1704067200, *(t for t in odd if t is not None and abs(t) < 10**14)]) + rng.randrange(10**7)) for _ in range(200)]
    captures = [(k, f"https://h{rng.randrange(5)}.org/", rng.choice(odd + [1704067200 + rng.randrange(10**8)])) for k in range(300)]
    captures += captures[:20] * 3
    begun = time.perf_counter()
    got = urlfilter.evaluate(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES)).select("page_id", "n_active", "verdict").collect()
    assert time.perf_counter() - begun < 60  # a row for each month from -(1 << 62) on would not end
    assert sorted(map(tuple, got)) == sorted((k, *plain_verdict(entries, url[8:-1], at)) for k, url, at in captures)


def test_many_copies_of_a_capture(spark):
    captures = spark.range(25_001).select(F.lit(1).alias("page_id"), F.lit("http://a.org").alias("url"), F.lit(7).alias("fetched_at"))
    got = urlfilter.evaluate(captures, spark.createDataFrame([("l", "host", "a.org", "block", "add", 1)], ENTRIES))
    assert got.where("verdict = 'block'").count() == 25_001


def test_a_passage_in_many_items_and_documents(spark):
    rng = random.Random(4)
    passage = " ".join(f"w{rng.randrange(999)}" for _ in range(30))
    other = " ".join(f"v{rng.randrange(999)}" for _ in range(14))
    items = [(f"i{k}", passage if k % 3 else f"{passage} own{k} {other}") for k in range(300)] + [("o", other)]
    docs = [(k, f"doc{k} {passage} end" if k % 5 else f"{other} and {passage}") for k in range(300)] + [(999, "none of it"), (5, f"doc5 {passage} end")]
    benchmark, df = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(decontaminate.brute_force(docs, items))
    assert sorted(map(tuple, decontaminate.hit_digest(df, benchmark).collect())) == want
    hits = decontaminate.benchmark_hits(df, benchmark)
    assert sorted(map(tuple, decontaminate.digest(hits).collect())) == want
    # A list of items for each different list, not for each document.
    _, named = decontaminate._hits(df, benchmark, 10, "item_id", "doc_id", "text")
    assert named.count() == 2
    windows, members = decontaminate._item_sets(decontaminate.index_items(benchmark))
    assert windows.select("s").distinct().count() <= 2 + 300 and members.count() < 5 * 301


PARAGRAPH = "A sentence of the main text that goes on for a while, and another one that ends it. "


@pytest.mark.parametrize("mark", ["class='related'", "class='newsletter'", "id='sidebar'", "class='cookie-notice'", "class='footer'", "role='complementary'"])
@pytest.mark.parametrize("frame", ["<article><h1>T</h1><p>{}</p></article>{}", "<div><h1>T</h1><p>{}</p></div>{}", "<div><h1>T</h1><p>{}</p>{}</div>", "<article>{1}<h1>T</h1><p>{0}</p></article>"])
def test_furniture_that_outweighs_the_article(mark, frame):
    furniture = f"<div {mark}>{f'<p>{PARAGRAPH}</p>' * 12}</div>"
    assert htmltext.main_text("<body>" + frame.format(PARAGRAPH * 3, furniture)) == f"T\n{(PARAGRAPH * 3).strip()}"


@pytest.mark.parametrize("inside", [True, False])
def test_comments_after_a_short_article(inside):
    comments = f"<div id=comments>{f'<div class=comment><p>{PARAGRAPH}</p></div>' * 40}</div>"
    page = "<article><h1>T</h1><p>A note of about fifty characters, and no more.</p>" + (comments + "</article>" if inside else "</article>" + comments)
    assert htmltext.main_text(page) == "T\nA note of about fifty characters, and no more."


@pytest.mark.parametrize("unit", ["<li class='menu'>item", "<div class=ad>x", "<article>", "<article><header><h2>x", "<p class=menu>y", "</main><article>", "<div hidden><article>z"])
def test_time_and_memory_follow_the_length_of_unclosed_pages(unit):
    took = []
    for times in (4_000, 16_000):
        begun = time.process_time()
        htmltext.main_text(unit * times)
        took.append(time.process_time() - begun)
    assert took[1] < 8 * took[0] + 0.2
    tracemalloc.start()
    htmltext.main_text(unit * 16_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20


def test_deep_elements_close_where_they_should():
    text = PARAGRAPH * 3
    page = "<div class=menu>" * 50 + "in" + "</div>" * 50 + f"<p>{text}</p>" + "<li class='menu'>item" * 50 + "</li></ul>" + "<p>Still a list.</p>"
    assert htmltext.main_text(page) == text.strip()
    assert htmltext.main_text(f"<div class=ad><div>x</div><p>ad</p></div><p>{text}</p>") == text.strip()


def test_copies_of_a_row_are_fingerprinted_once(spark, monkeypatch):
    from wayside.llm import ctph

    text, other = "some words of a text " * 200, "another text altogether " * 150
    asked = []
    counted = lambda texts, f=ctph.fingerprints: asked.append(len(texts)) or f(texts)
    df = spark.createDataFrame([(1, text)] * 300 + [(2, other), (3, None)], "doc_id long, text string")
    got = ctph.compare_with_next(df).collect()
    one, two = ctph.fingerprints([text.encode(), other.encode()])
    mine = [r for r in got if r.doc_id == 1]
    assert len(got) == 302 and len(mine) == 300 and {r.fingerprint for r in mine} == {one}
    # All but the last copy are followed by a copy, the last by the next document.
    assert sorted(r.near_next for r in mine) == sorted([1.0] * 299 + [ctph.likeness(one, two)])
    monkeypatch.setattr(ctph, "fingerprints", counted)
    import pyarrow as pa

    rows = [{"p": 0, "tail": False, "text": text, "doc_id": 1}] * 300 + [{"p": 0, "tail": True, "text": other, "doc_id": 2}]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("p", pa.int32()), ("tail", pa.bool_()), ("text", pa.string()), ("doc_id", pa.int64())]))
    assert sum(b.num_rows for b in ctph._compare(iter([batch]))) == 300 and sum(asked) < 20


PIPELINE = "doc_id long, text string, lang string, source string, n_chars long"


def run_pipeline(spark, folder, rows, items, clashes=None):
    import corpus_pipeline

    docs = spark.createDataFrame(rows, PIPELINE)
    docs.withColumns({c: F.lit(v) for c, v in (clashes or {}).items()}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, f"file://{folder}")


def test_pipeline_of_odd_tables(spark, tmp_path):
    from wayside.llm import packing, tokens

    rng = random.Random(12)
    word = lambda: rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmnrs")
    prose = [" ".join(word() for _ in range(60)) for _ in range(12)]
    leaked = f"{prose[9]} {prose[10]}"
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(prose[:8])]
    rows += [(20, prose[0], None, None, None), (20, prose[0], None, None, None), (None, prose[8], "en", None, 0), (None, prose[1], "en", None, 0), (21, None, "en", "s", 0), (22, "", "en", "s", 0), (23, " 123 \n", "en", "s", 0), (24, leaked, "en", "s", 0)]
    items = [("b", prose[10]), (None, None), ("e", "")]
    got = run_pipeline(spark, tmp_path / "odd", rows, items, {"ord": 1, "tag": "x", "component": 3, "score": 0.5, "lang_pred": "zz", "start": 9})
    # Copies lose their line to their first document, and of what has no words left one stays; rows without an id come last; no text, no letter and a leak go.
    want = {(k, t) for k, t in enumerate(prose[:8])} | {(None, prose[8]), (20, "")}
    enc = tokens.encoder(tokens.tokenizer_path())
    sizes = sorted(((k, n) for k, t in want for n in packing.pieces(len(enc.encode([t.encode()])[0]) // 4 + 1)), key=repr)
    assert sorted(((r.doc_id, r.length) for r in got.collect()), key=repr) == sizes


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert run_pipeline(spark, tmp_path / "none", [], []).count() == 0
    assert run_pipeline(spark, tmp_path / "no_text", [(1, None, None, None, None), (2, "", "en", "s", 0)], [("b", "some words")]).count() == 0


def test_texts_that_no_language_fits_go(spark):
    from wayside.llm import langid

    rows = [(k, " ".join(random.Random(k).choices(["the", "then", "other", "words"] if k % 2 else ["die", "dann", "andere", "worte"], k=30)), "en" if k % 2 else "de", "s", 0) for k in range(60)]
    docs = spark.createDataFrame([*rows, (99, "the words", "en", "s", 0)], PIPELINE)
    model = langid.train(docs)
    scores = {r.doc_id: r.score for r in langid.predict(docs, model).collect()}
    least = sorted(scores.values())[3]
    kept = {r.doc_id for r in langid.keep_known(docs, model, least).collect()}
    assert kept == {k for k, s in scores.items() if s >= least} and 0 < len(scores) - len(kept) <= 3


def test_records_of_odd_tables(spark, tmp_path):
    from wayside.llm import records

    rows = [(3, "three words here", 1, "x"), (None, "no id", 1, "x"), (3, "three words here", 1, "x"), (1, None, 1, "x"), (None, None, 1, "x"), (2, "", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, shard string")
    path = f"file://{tmp_path}/records"
    shards = records.write_records(docs, path)
    got = records.read_records(spark, path, shards).orderBy("start").collect()
    assert [r.doc_id for r in got] == [1, 2, 3, 3, None, None] and got[0].n_tokens == got[1].n_tokens == 1
    assert got[2].n_tokens == got[3].n_tokens > 1 and got[2].ids_crc32 == got[3].ids_crc32
    ends = [r.start + r.n_tokens for r in got]
    assert [r.start for r in got] == [0, *ends[:-1]]


def test_scoring_languages_takes_little_memory():
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(300)) for _ in range(1500)]
    model = langid.Model(["a", "b"], {"a": ["a"], "b": ["b"]}, np.random.default_rng(1).normal(size=(2 * langid.SIZE + 1, 2)).astype(np.float32), {("family", "a"): 0, ("family", "b"): 1})
    rows = tables.batch(k=pa.array(range(len(texts))), text=texts)
    tracemalloc.start()
    got = pa.Table.from_batches(langid._predict(model)(iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6  # a MB of texts at once took 49 MB
    want = [langid._scores(model, [t.encode()]) for t in texts[::100]]
    assert got["k"].to_pylist() == list(range(len(texts))) and got["lang_pred"].to_pylist()[::100] == [w[0][0] for w in want]
    assert np.allclose(got["score"].to_pylist()[::100], [w[1][0] for w in want], atol=1e-9)


def test_packing_with_few_kept_words(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, " ".join(f"{rng.choice('abc')}{rng.randrange(9999)}." for _ in range(50))) for k in range(400)], "doc_id long, text string").coalesce(1)
    columns = "doc_id", "start", "length", "ids_crc32", "doc_tokens"
    want, got = (sorted(map(tuple, packing.pack(docs, **more).select(*columns).collect())) for more in ({}, {"words": 500, "keep": False}))
    assert got == want
    path = tokens.tokenizer_path(None)
    tokens.encoder(path)
    list(packing._pack(path, 2, 4096, 1 << 16, False, 500, False)(iter([])))
    assert path not in tokens._ENCODERS
    held = tokens.encoder(path, 500)
    for b in range(0, 400, 64):
        held.encode([r.text.encode() for r in docs.collect()[b : b + 64]])
    # The words of one call at most besides.
    assert len(held.ids) + len(held.older) < 2 * 64 * 50 * 3
    assert tokens.encoder(path).limit == tokens.WORDS


def test_arrow_gives_back_what_a_task_had(monkeypatch):
    given = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: given.append(1)})())
    rows = tables.batch(k=[1, 2])
    assert list(tables.releasing(lambda batches: batches)(iter([rows]))) == [rows] and given == [1]
