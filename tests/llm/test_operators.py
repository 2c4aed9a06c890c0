import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from flowloom.llm import common, decontaminate, difference_cover, html_extract, quality_nbsvm, quality_rules, queries, sentencepiece_codec, simhash_vptree, suffix_dedup, token_counts, toxicity_cnn, url_filter

TRICKY = ["", " ", "  a  b ", "\n\t\v", "▁x ▁", "é́ﬁ① ۝", "a\u00a0b\u3000c", "日本𝒳 𝒳", "</s> <s> <unk> <0x0A>", "x" * 300, "A" * 70 + " b", "same same same same same same same same same same same same", "l one two\nl one two\nl one two\n\n \n"]
WORDS = "river lamp quay grain wall boat night hour tower keeper letter salt rope stone bridge over under near past and the of".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(".,\n") if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Prose, copies, near copies, shared passages, tricky texts, nulls, repeated rows and ids."""
    rng = random.Random(7)
    base = [prose(rng, rng.randrange(5, 150)) for _ in range(40)]
    passage = prose(rng, 60)
    texts = [*base, *base[:6], *[t + " once more" for t in base[6:12]], *[prose(rng, 20) + passage + prose(rng, 20) for _ in range(8)], *TRICKY, None, None]
    rows = [(k * 3 % 1009, t) for k, t in enumerate(texts)]
    return rows + [rows[2], (None, base[3]), (None, None), (rows[5][0], "another text under the same id, long enough to hold fifty bytes")]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """With other columns, whose names the operators use inside."""
    rows = [(i, t, "xx", k, "n", 1.0, b"z") for k, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row long, part string, score double, blob binary").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_sentencepiece_matches_the_library(docs, corpus, empty):
    want = sorted(((i, *brute.tokens(t)) for i, t in corpus), key=repr)
    assert rows_of(sentencepiece_codec.digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    full = sentencepiece_codec.encode_decode(docs).where("doc_id = 0").first()
    assert full.ids[0] == 1 and full.ids[-1] == 2 and full.decoded == corpus[0][1]
    assert sentencepiece_codec.digests(empty).count() == 0


def test_chunk_table_that_overflows(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "MAX_CHUNKS", 5)
    codec, rng = sentencepiece_codec.Codec(sentencepiece_codec._model(None)), random.Random(1)
    for t in [prose(rng, 40) for _ in range(20)] + TRICKY:
        ids = codec.sp.encode(t, add_bos=True, add_eos=True)
        assert codec.encode_many([t]) == [(np.array(ids, "<u4").tobytes(), codec.sp.decode(ids))]


def test_quality_rules_match(docs, corpus, empty):
    want = sorted(((i, *brute.quality(t)) for i, t in corpus), key=repr)
    assert rows_of(quality_rules.quality_rules(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert quality_rules.quality_rules(empty).count() == 0
    good, said_twice = quality_rules.measure(" ".join(f"w{k}" for k in range(50))), quality_rules.measure("\n".join(["one two three"] * 20))
    assert good["kept"] and not said_twice["kept"] and not quality_rules.measure("")["kept"]
    assert not quality_rules.measure(" ".join(f"w{k}***" for k in range(50)))["kept"]


def test_quality_verdict_matches(docs, corpus):
    rng = random.Random(17)
    texts = [t for _, t in corpus]
    for _ in range(300):  # around every limit: n-grams, lines and symbols that repeat
        lines = [prose(rng, rng.randrange(1, 14)) for _ in range(rng.randrange(2, 25))]
        for _ in range(rng.randrange(5)):
            lines.insert(rng.randrange(len(lines)), rng.choice(lines))
        text = " ".join(lines) if rng.random() < 0.5 else "\n".join(lines)
        texts.append("".join(c + ("#" if c == " " and rng.random() < rng.choice((0, 0, 0.1)) else "") for c in text))
    got = [quality_rules.measure(t or "")["kept"] for t in texts]
    assert got == [brute.quality_kept(t) for t in texts] and 50 < sum(got) < len(got) - 50
    assert rows_of(quality_rules.quality_rules(docs), "doc_id", "kept") == sorted(((i, brute.quality_kept(t)) for i, t in corpus), key=repr)


def test_repeated_ngrams_of_every_length():
    rng = random.Random(3)
    for _ in range(200):
        codes = [rng.randrange(4) for _ in range(rng.randrange(0, 40))]
        for n in (5, 6, 10):
            grams = [tuple(codes[k : k + n]) for k in range(len(codes) - n + 1)]
            want = {k + i for k, g in enumerate(grams) if grams.count(g) > 1 for i in range(n)}
            got = quality_rules.repeated(quality_rules.mix(np.array(codes, np.uint64) + np.uint64(1)), n)
            assert set(np.flatnonzero(got)) == want


def test_html_tree_decides_by_density_and_neighbours():
    from flowloom.llm.html_labels import pages

    tree = html_extract.trained()

    def used(node):
        return {html_extract.FEATURES[node[0]]} | used(node[2]) | used(node[3]) if isinstance(node, tuple) else set()

    assert {"link_density", "density_before", "density_after", "words", "words_before", "words_after"} <= used(tree)
    for seed, least in ((3, 0.99), (77, 0.98)):  # the table itself, and pages it does not have
        found = [x for own in map(html_extract.flat_blocks, pages(seed, 400)) for x in zip(own, html_extract.decide(tree, html_extract.features(own)), strict=True)]
        assert sum(b.text.startswith("+") == keep for b, keep in found) >= least * len(found)


LONG = "The river had risen for three days before anyone in the lower town thought to move the boats and the grain from the quay."


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<div class="xyz1"><p>{LONG}</p><p>Nobody had expected the bridge to hold that long, and yet it did hold.</p></div><p><a href=/a>One</a> <a href=/b>Two</a> <a href=/c>Three</a></p>', f"{LONG}\n\nNobody had expected the bridge to hold that long, and yet it did hold."),
        (f'<div class="content-form"><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG}\n\n{LONG}"),
        (f'<article><p>{LONG}</p><p class="ad">Buy now two lamps for one.</p><p>And it <span class="ad">Cheap <span>ropes</span></span> held.</p><p class="footer-note">Read more</p></article>', f"{LONG}\n\nAnd it held."),
        (f'<form id=page><nav><a href=/>Home</a></nav><article><h1>Hill</h1><p>{LONG}</p></article></form>', f"Hill\n\n{LONG}"),
        ("<article>" + "<div>" * 4200 + "<nav>menu</nav><aside>side</aside><p>Word here.</p>", "Word here."),
    ],
)
def test_html_pages_whose_names_mislead_or_are_not_there(page, want):
    assert html_extract.main_texts([page, "", page], html_extract.trained()) == [want, "", want]


def test_html_query_against_the_article_elements(spark):
    import html
    import re

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()

    def want(page):
        inner = re.search(r"<article>(.*?)</article>", page or "", re.S)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inner[1] if inner else "")]
        return "\n\n".join(filter(None, blocks))

    got = rows_of(queries.op3_html_extract(spark, sf), "page_id", "url", "text", "n_chars")
    assert got == sorted(((r.page_id, r.url, want(r.html), len(want(r.html))) for r in rows), key=repr)


def test_html_broken_markup_nulls_and_other_columns(spark):
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One<br>two&nbsp;  three <b>four</p><p>5</p><div class="ad">buy</div><section id=comments><p>me too</p></section></article><footer>f</footer>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<article><p>cut here &am"), (5, "u", "<!-- open <p>x"), (6, "u", "<article><p a='>q</p>"), (6, "u", "<nav>only</nav>"), (7, "u", "<article>" + "<p>word</p>" * 20000)]
    wide = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "page_id long, url string, html string, n_chars int, text string, page double")
    got = rows_of(html_extract.extract(wide), "page_id", "text", "n_chars")
    by = {(i, n): t for i, t, n in got}
    assert by[1, 28] == "A & B\n\nOne two three four\n\n5" and by[2, 0] == by[3, 0] == by[5, 0] == ""
    assert by[None, 12] == "cut here &am"
    assert max(n for _, _, n in got) == 20000 * 6 - 2
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_containers_at_any_depth():
    def zone(b):
        return 3 if b.boiler_tag or b.name_near >= html_extract.BOILER else int(b.zone == 1 or b.name_near == html_extract.ARTICLE)

    def zones(page):
        return [(b.text, zone(b)) for b in html_extract.flat_blocks(page)]

    tail = "<aside>related</aside><div class=ad>buy</div><p>last</p></article>"
    cells = zones("<article><table>" + "<tr><td>a<td>b" * 3000 + "</table>" + tail)
    assert len(cells) == 6003 and {z for _, z in cells[:-3]} == {1} and cells[-3:] == [("related", 3), ("buy", 3), ("last", 1)]
    assert zones("<article>" + "<div>" * 6000 + "in" + "</div>" * 6000 + tail) == [("in", 1), ("related", 3), ("buy", 3), ("last", 1)]
    assert zones("<article>" + "<div>" * 6000 + tail) == [("related", 3), ("buy", 3), ("last", 1)]
    # a cell ends what stands in it, but only a cell of its own table
    assert zones("<article><table><tr><td><div class=ad>buy<td>b<tr class=x><th>c</table>") == [("buy", 3), ("b", 1), ("c", 1)]
    assert zones("<table><tr><td class=content>a<table><tr><td class=ad>buy<tr><td>b</tr></td></table>c<td>d</table>") == [("a", 1), ("buy", 3), ("b", 1), ("c", 1), ("d", 0)]
    deep = 200_000  # closing stays cheap
    assert zones("<article>" + "<div>" * deep + "</section>" * deep + "<td>x" + "</table>" * deep) == [("x", 1)]


def test_simhash_fingerprints_and_components(docs, corpus, empty):
    near = simhash_vptree.near_duplicates(docs)
    got = near.collect()
    assert sorted((r.doc_id, r.fingerprint) for r in got if r.doc_id is not None) == sorted((i, f"{brute.fingerprint(t):016x}") for i, t in corpus if i is not None)
    prints = {k: brute.fingerprint(t) for k, (_, t) in enumerate(corpus)}
    comp = brute.components(prints)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(corpus):
        if i is not None:
            least[comp[k]] = min(i, least.get(comp[k], i))
    want = sorted(((i, f"{prints[k]:016x}", least.get(comp[k])) for k, (i, _) in enumerate(corpus)), key=repr)
    assert rows_of(near, "doc_id", "fingerprint", "component_id") == want
    assert simhash_vptree.near_duplicates(empty).count() == 0
    other = docs.select(F.col("doc_id").alias("fp"), F.col("text").alias("root"), F.lit(1).alias("node"), F.lit(1).alias("least"))
    assert rows_of(simhash_vptree.near_duplicates(other, "fp", "root"), "fp", "fingerprint", "component_id") == want
    one = simhash_vptree.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == len(set(comp.values()))
    assert sorted(r.doc_id for r in one.where("doc_id is not null").collect()) == sorted(least.values())
    assert simhash_vptree.one_of_each(empty).count() == 0


@pytest.mark.parametrize("spread", ["random", "clusters", "half"])
def test_vantage_point_search_loses_no_link(spark, monkeypatch, spread):
    monkeypatch.setattr(simhash_vptree, "SHARD", 200)
    monkeypatch.setattr(simhash_vptree, "LEAF", 8)
    rng = random.Random(spread)
    if spread == "random":
        x = [rng.getrandbits(64) for _ in range(1500)]
    elif spread == "clusters":
        x = [c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for c in [rng.getrandbits(64) for _ in range(15)] for _ in range(100)]
    else:
        x = [0xABCD << 32 | rng.getrandbits(8) << rng.randrange(24) for _ in range(900)]
    x = sorted({v & (2**64 - 1) for v in x} | {v ^ 7 for v in x[:200]})
    signed = [v - 2**64 if v >> 63 else v for v in x]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)
    links = simhash_vptree.components(simhash_vptree.shard_links(fps, len(x))).collect()
    root = {v: v for v in signed} | {r.node: r.root for r in links}
    comp = brute.components(dict(zip(signed, x, strict=True)))
    assert len(set(root.values())) == len(set(comp.values()))
    assert len({(root[v], comp[v]) for v in signed}) == len(set(comp.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100)] + [(500, 500 + k) for k in range(1, 60)] + [(7, 7), (901, 900)]
    got = {r.node: r.root for r in simhash_vptree.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 101)) and all(got[500 + k] == 500 for k in range(1, 60)) and got[901] == 900


def test_decontamination_one_automaton_and_blocks(spark, docs, corpus, empty):
    items = {1: corpus[0][1], 22: corpus[1][1], 3: "River!", 4: None, 5: "...", 6: "zzz not there at all", 10: corpus[1][1]}
    bench = spark.createDataFrame([*items.items(), (None, corpus[4][1]), (22, corpus[1][1])], "item_id long, text string")
    want = sorted(((i, *brute.contamination(t, items)) for i, t in corpus), key=repr)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontaminate.digests(decontaminate.decontaminate(docs, bench)), *cols) == want
    assert rows_of(decontaminate.digests(decontaminate.decontaminate(docs, bench, max_chars=300)), *cols) == want
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    for limit in (1 << 20, 300):
        kept = decontaminate.drop_contaminated(docs, bench, max_chars=limit)
        assert kept.columns == docs.columns and rows_of(kept, "doc_id") == sorted(((w[0],) for w in want if not w[5]), key=repr)
    text = "Ö!! the RIVER, ran"
    found = decontaminate.decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).first()
    assert [text[s.start : s.stop] for s in found.spans] == ["RIVER"]


def test_suffix_dedup_matches(docs, corpus, empty):
    want = sorted((r[:5] for r in brute.repeats(corpus)), key=repr)
    assert rows_of(suffix_dedup.digests(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.digests(empty).count() == 0


@pytest.mark.parametrize("seed,hot", [(0, 8), (1, 8), (2, 8), (1, 2), (2, 1)])
def test_suffix_dedup_on_unique_ids_and_small_alphabets(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 1 makes all anchors hot
    rng = random.Random(seed)
    words = ["ab", "a", "ba", "é", "the"][: seed + 2]
    rows = [(k, "".join(rng.choice(words) for _ in range(rng.randrange(0, 200)))) for k in range(40)]
    rows += [(100 + k, rows[k][1][5:120] + "x" + rows[k + 1][1]) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.repeated_bytes(df, want_text=True)
    want = brute.repeats(rows)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept") == sorted(((*w[:5], w[5].decode("utf-8", "ignore")) for w in want), key=repr)


def test_suffix_dedup_of_a_text_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    monkeypatch.setattr(suffix_dedup, "PACK", 50)
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    rng = random.Random(9)
    long = prose(rng, 1500)
    rows = [(1, long), (2, prose(rng, 30) + long[2000:5500] + prose(rng, 30)), (3, long[:4000]), (4, prose(rng, 10))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(suffix_dedup.digests(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted((r[:5] for r in brute.repeats(rows)), key=repr)


def test_suffix_dedup_with_a_passage_that_most_documents_share(spark, monkeypatch):
    rng = random.Random(12)
    passage = prose(rng, 60)
    rows = [(k, prose(rng, 12) + (passage if k % 3 else passage[3:-4]) + prose(rng, 12)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    numbered = df.select(F.col("doc_id").alias("row"), F.col("text").cast("binary").alias("text"))
    monkeypatch.setattr(suffix_dedup, "HOT", 16)
    assert 0 < len(suffix_dedup.hot_anchors(numbered, 60)) < 40
    assert rows_of(suffix_dedup.digests(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted((r[:5] for r in brute.repeats(rows)), key=repr)


def _strings(texts, orders):
    """What ``_compare`` gets: one document a string, whose row is its order."""
    import pyarrow as pa
    import zstandard

    order = np.array(orders, np.int64)
    lines = suffix_dedup.pack((order, 8), (order, 8), (order * 0, 6), (np.array([len(t) for t in texts]), 1))
    return pa.table({"part": pa.array([0], pa.int32()), "blob": [zstandard.ZstdCompressor().compress(b"".join(texts))], "lines": [lines]})


def _windows(table):
    return {(r, w) for r, lines in suffix_dedup._spans(table.column("blob").to_pylist()).items() for a, b, *_ in lines.tolist() for w in range(a, b - 49)}


def _around(rng, n, passage, near=24):
    """Runs, and so strings of one anchor, of documents around a passage."""
    found = []
    for k in range(n):
        text = np.frombuffer((prose(rng, 3)[-near:] + passage + prose(rng, 9)[:near]).encode(), np.uint8)
        first, more, _, _ = suffix_dedup.runs(text, np.array([len(text)]))
        found += [(text[a : a + m + 50].tobytes(), k) for a, m in zip(first.tolist(), more.tolist(), strict=True)]
    rng.shuffle(found)
    return zip(*found, strict=True)


@pytest.mark.parametrize("most,collide", [(1 << 19, False), (3000, False), (1, False), (1, True)])
def test_strings_of_an_anchor_with_many_of_them(monkeypatch, most, collide):
    monkeypatch.setattr(suffix_dedup, "SORTED", most, raising=False)  # 1 sorts each anchor's windows by place
    rng = random.Random(21)
    texts, orders = _around(rng, 150, prose(rng, 8))
    least = {}
    for t, o in zip(texts, orders, strict=True):
        for w in range(len(t) - 49):
            least[t[w : w + 50]] = min(o, least.get(t[w : w + 50], o))
    want = {(o, w) for t, o in zip(texts, orders, strict=True) for w in range(len(t) - 49) if least[t[w : w + 50]] < o}
    table = _strings(texts, orders)
    if collide:  # every hash of a string is the same
        anchored = suffix_dedup.anchored
        found = anchored(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts[:-1])]))
        monkeypatch.setattr(suffix_dedup, "anchored", lambda *_: found)
        monkeypatch.setattr(suffix_dedup, "mix", lambda x: x * np.uint64(0))
    assert want and _windows(suffix_dedup._compare(4)(table)) == want


def test_comparing_strings_takes_the_memory_of_a_few_anchors():
    import tracemalloc

    rng = random.Random(22)
    texts = [t for _ in range(4) for t in next(_around(rng, 3000, prose(rng, 12)))]
    table = _strings(texts, range(len(texts)))
    suffix_dedup._compare(4)(_strings(texts[:100], range(100)))
    tracemalloc.start()
    suffix_dedup._compare(4)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 2_500_000 and peak < 150_000_000, (peak, sum(map(len, texts)))


def test_runs_of_pieces_hold_every_window_once():
    rng = random.Random(4)
    text = prose(rng, 400).encode()
    sizes = np.array([len(text) // 2, len(text) - len(text) // 2])
    first, more, _, _ = suffix_dedup.runs(np.frombuffer(text, np.uint8), sizes)
    windows = [w for a, m in zip(first.tolist(), more.tolist(), strict=True) for w in range(a, a + m + 1)]
    assert windows == [w for a, b in ((0, sizes[0]), (sizes[0], len(text))) for w in range(a, b - 49)]


def test_difference_cover_sorts_suffixes():
    rng = random.Random(6)
    for _ in range(500):
        s = [rng.randrange(rng.choice([1, 2, 250])) for _ in range(rng.randrange(60))]
        assert difference_cover.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    text = np.frombuffer(b"abcabcabdabc" * 20, np.uint8)
    classes = difference_cover.equal_windows(text, np.arange(len(text) - 9), 10)
    strings = [bytes(text[k : k + 10]) for k in range(len(text) - 9)]
    assert len(set(zip(classes.tolist(), strings, strict=True))) == len(set(strings)) == len(set(classes.tolist()))


def test_url_rules_longest_wins(spark, monkeypatch):
    urls = ["http://A.Example.ORG/en/15?x", "https://example.org/en/2", "http://example.com/fr/1", "https://x.example.com/de/", "ftp://notexample.org/es/1", "org", None, "http://org/", "http://org", "x://a.b.com?/fr/", "http://www.example.org/es/#/fr/", "http://com./fr/", "://.com/fr/", "http://" + "a." * 60 + "com/fr/" + "p" * 3000]
    rows = [(k, u, "x", 1) for k, u in enumerate(urls)] + [(None, urls[0], "x", 1), (0, urls[0], "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, key string, row int")
    rules = [*url_filter.RULES]

    def want(url):
        at = -1 if url is None else url.find("://")
        rest = "" if at < 0 else url[at + 3 :]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = brute.ascii_lower(rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[1:] if fits else (None, "allow"))

    got = url_filter.filter_urls(pages)
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted(((r[0], *want(r[1])) for r in rows), key=repr)
    rules[:] = [("org", "/", "block"), ("org", "/", "allow"), ("example.org", "/e", "allow"), ("example.org", "/en/", "block"), ("org", "/en/15", "allow"), ("b.com", "", "block")]
    table = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    rules.remove(("org", "/", "allow"))
    assert rows_of(url_filter.filter_urls(pages, table, parts=1), "page_id", "host", "path", "rule", "verdict") == sorted(((r[0], *want(r[1])) for r in rows), key=repr)
    bare = [("org", "", "block"), ("bco", "", "block"), ("example.org", "/es/", "allow"), ("a.b", "", "block"), ("", "", "block"), ("a/b", "", "block"), ("q?", "", "block")]
    more = [*urls, "http://x.organic/a", "http://www.bcom", "http://b.bco/", "http://zorg", "http:///x", "http://a/b/c", "x://a.b.c/", "x://d.a.b", "http://" + "x." * 900 + "org/"]
    rules[:] = bare[:5]
    for k, limit in enumerate((1 << 40, 20, 1)):  # one group of hosts, some, many
        monkeypatch.setattr(url_filter, "MAX_REPEATED", limit), monkeypatch.setattr(url_filter, "SALTS", 2)
        named = spark.createDataFrame(list(enumerate(more)), "page_id long, url string")
        got = url_filter.filter_urls(named, spark.createDataFrame(bare, "host string, path string, verdict string"), parts=7)
        assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted(((i, *want(u)) for i, u in enumerate(more)), key=repr), k
    assert url_filter.filter_urls(pages, table.limit(0)).where("verdict <> 'allow' or rule is not null").count() == 0
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    assert not [n for n in ("Python", "Arrow", "Pandas") if n in got._jdf.queryExecution().executedPlan().toString()]


def test_url_query_against_its_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.execute(queries.ORACLES["op7_url_filter"]).fetchall()
    assert rows_of(queries.op7_url_filter(spark, sf), "page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)


def test_token_counts_match_the_word_piece_model(docs, corpus, empty):
    from tokenizers import models

    begin, inside = token_counts.vocabulary()
    vocab = {p: k for k, p in enumerate([*dict.fromkeys(begin), *dict.fromkeys("##" + p for p in inside), "[UNK]"])}
    model = models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=100)

    def want(text):
        w = brute.SPACE_WORD.findall(text or "")
        parts = [[t.value for t in model.tokenize(x)] for x in w]
        return len(w), sum(map(len, parts)), sum(p == ["[UNK]"] for p in parts)

    assert rows_of(token_counts.token_counts(docs, max_word=100), "doc_id", "n_words", "n_tokens", "n_unknown") == sorted(((i, *want(t)) for i, t in corpus), key=repr)
    assert token_counts.token_counts(empty).count() == 0


def test_automaton_against_greedy_segmentation():
    rng = random.Random(2)
    for _ in range(60):
        begin = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(4)]
        inside = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(5)]
        machine = token_counts.Automaton(begin, inside)
        for _ in range(40):
            word, n, at = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))), 0, 0
            while at < len(word):
                size = max((len(p) for p in (inside if at else begin) if word.startswith(p, at)), default=0)
                if not size:
                    n = -1
                    break
                n, at = n + 1, at + size
            assert machine.count(word) == n


def test_long_words_are_counted_to_their_end(spark, tmp_path):
    begin, inside = map(set, token_counts.vocabulary())
    longest = max(map(len, begin | inside))

    def greedy(word):
        n = at = 0
        while at < len(word):
            own = inside if at else begin
            size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in own), 0)
            if not size:
                return 1, 1
            n, at = n + 1, at + size
        return n, 0

    rng = random.Random(9)
    url = "https://example.org/" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789/-=") for _ in range(5000))
    texts = ["x" * 100, "x" * 101, url, f"a {url} b {url}\n" + "y" * 700, "x" * 150 + "\U0010fffd", "的" * 3000, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in enumerate(texts):
        got = [greedy(w) for w in brute.SPACE_WORD.findall(t or "")]
        want.append((i, len(got), sum(n for n, _ in got), sum(u for _, u in got)))
    assert want[1][2] > 1 and want[2][2] > 500 and want[4][3] == 1
    assert rows_of(queries.op9_token_counts(spark, str(tmp_path)), "doc_id", "n_words", "n_tokens", "n_unknown") == sorted(want, key=repr)


def long_texts():
    """Very long texts: of one word, of one symbol and space, of lines, with a word of 300 and one of 300,000 characters."""
    rng = random.Random(31)
    word = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    return [word, "a " * 200_000, "\n".join(prose(rng, 9) for _ in range(6000)), prose(rng, 300) + " " + word[:300] + " " + prose(rng, 300) + " " + word + " é", "é" * 90_000]


def test_very_long_texts_and_words(spark):
    rows = list(enumerate(long_texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert rows_of(sentencepiece_codec.digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == [(i, *brute.tokens(t)) for i, t in rows]
    assert rows_of(quality_rules.quality_rules(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == [(i, *brute.quality(t)) for i, t in rows]
    assert rows_of(simhash_vptree.fingerprints(docs).withColumn("fp", F.lower(F.lpad(F.hex("fp"), 16, "0"))), "doc_id", "fp") == [(i, f"{brute.fingerprint(t):016x}") for i, t in rows]
    items = {1: rows[2][1][:200], 2: rows[3][1][-300_050:]}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontaminate.digests(decontaminate.decontaminate(docs, bench)), *cols) == [(i, *brute.contamination(t, items)) for i, t in rows]
    assert rows_of(suffix_dedup.digests(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == [r[:5] for r in brute.repeats(rows)]
    host = "http://" + "a." * 3000 + "example.org/es/" + "b" * 300_000
    assert url_filter.filter_urls(spark.createDataFrame([(1, host)], "page_id long, url string")).first().rule == "example.org/es/"


@pytest.mark.parametrize("most", [340, 5000])
def test_texts_are_cut_between_words(most):
    for t in [*long_texts(), *TRICKY]:
        parts = list(common.pieces(t, most))
        assert "".join(parts) == t and [w for p in parts for w in p.split(" ") if w] == [w for w in t.split(" ") if w] or "\n" in t
        assert all(len(p) <= most or not (set(p[1:]) & {" ", "\n"}) for p in parts)


def labelled(spark, n=700, seed=1):
    rng, bad = random.Random(seed), "vile scum wretch".split()
    rows = []
    for k in range(n):
        w = prose(rng, rng.randrange(20, 80)).split(" ")
        toxic, low = k % 5 == 1, k % 4 == 2
        if toxic:
            for b in bad[: rng.randrange(1, 4)]:
                w.insert(rng.randrange(len(w)), b)
        rows.append((k, " ".join(x.upper() + "!!" if low else x for x in w), int(not low), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "the wall"), (5000, None), (5001, ""), (5002, "the " * 50000), (5003, "vile")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, rows


@pytest.mark.parametrize("score,label,column", [(quality_nbsvm.score_quality, "quality", 2), (toxicity_cnn.score_toxicity, "toxic", 3)])
def test_classifiers_on_held_out_rows(spark, score, label, column):
    docs, labels, rows = labelled(spark)
    docs = docs.select("*", F.lit("x").alias("score"), F.lit(1).alias("held_out"), F.lit(2).alias("predicted"), F.lit(0.5).alias(label), F.lit(3).alias("y"), F.lit(4).alias("k"))
    got = score(docs, labels).collect()
    truth = {r[0]: r[column] for r in rows}
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(test) > 100 and sum(r.predicted == truth[r.doc_id] for r in test) >= 0.95 * len(test)
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    limit = quality_nbsvm.THRESHOLD if label == "quality" else toxicity_cnn.THRESHOLD
    assert all(r.predicted == int(r.score >= limit) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert score(docs.limit(0), labels).count() == 0
    none = score(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == ([0.5] if label == "quality" else [0.0])


def test_toxic_documents_go_and_others_stay(spark):
    docs, labels, rows = labelled(spark)
    wide = docs.withColumn("score", F.lit("x")).withColumn("__text", F.lit(1))
    kept = {r.doc_id for r in toxicity_cnn.drop_toxic(wide, labels).select("doc_id").collect()}
    wrong = [r[0] for r in rows if (r[0] in kept) == bool(r[3])]
    assert len(wrong) <= 0.03 * len(rows) and None in kept and 5000 in kept and toxicity_cnn.drop_toxic(wide, labels).columns == wide.columns


def test_labels_are_learnt_only_where_they_may_be(spark):
    docs, labels, _ = labelled(spark, 100)
    got = common.labelled_sample(docs, labels, "toxic", 50)
    assert len(got) == 50 and all(zlib.crc32(k.encode()) % 5 for k, _, _ in got)


def test_labelled_sample_of_repeated_ids(spark):
    ids = [k for k in range(40) if zlib.crc32(str(k).encode()) % 5]
    docs = spark.createDataFrame([(k, f"text {n}") for k in ids for n in range(30)] + [(k, None) for k in ids[:3]], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids] + [(ids[0], 1), (ids[1], 1)], "doc_id long, toxic int")
    got = common.labelled_sample(docs, labels, "toxic", 1000)
    assert got == sorted((str(k), "" if k in ids[:3] else "text 0", 1 if k in ids[:2] else k % 2) for k in ids)


def held(got, labels, label):
    """Rows, label-1 rows, rows told to be 1, and those of both among held-out ones."""
    rows = got.join(labels, "doc_id").where("held_out").select("predicted", label).collect()
    return len(rows), sum(r[1] for r in rows), sum(r[0] for r in rows), sum(r[0] and r[1] for r in rows)


def test_classifier_queries_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    n, ones, told, both = held(queries.op8_quality(spark, sf), labels, "quality")
    assert both >= 0.97 * ones and both >= 0.95 * told and n > 60
    n, ones, told, both = held(queries.op10_toxicity(spark, sf), labels, "toxic")
    assert both >= 0.6 * ones and both >= 0.8 * told > 0  # some toxic labels are on texts without a telling word


def test_texts_read_together_or_in_parts_score_the_same(monkeypatch):
    rng = random.Random(8)
    rows = [(str(k), prose(rng, 30) + (" vile scum" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(90)]
    texts = [r[1] for r in rows[:40]] + TRICKY + ["Été! ÉTÉ — “quoted” word—word 12ab", prose(rng, 900)]
    for module in (toxicity_cnn, quality_nbsvm):
        model = module.fit(rows)
        score = (toxicity_cnn.Scorer(model) if module is toxicity_cnn else model).scores
        together = score(texts)
        assert np.allclose(together, [score([t])[0] for t in texts]) and len(score([])) == 0
        monkeypatch.setattr(module, "PART", 340)
        assert np.allclose(score(texts), together)


def test_the_least_hashes_are_a_bounded_sample(spark):
    df = spark.range(5000).repartition(7)
    hashes = {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    want = sorted(hashes, key=hashes.get)
    for n in (1, 50, 4999, 5000, 9000):
        assert [r.id for r in common.least_hashes(df, "id", n).collect()] == want[:n]
