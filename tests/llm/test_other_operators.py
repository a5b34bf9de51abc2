import base64
import gzip
import hashlib
import io
import zlib

import numpy as np
import plain
import pytest

import corpus_pipeline
from finegrid.llm import bitsliced, byte_bpe, disclosure, mixing, multiindex, pages, queries, toxicity, warc
from finegrid.llm.common import table

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- WARC ------------------------------------------------------------------------------------------------------------

def test_normaliser():
    """Any number of gzip members in, one per record out; records longer than a piece; every record in reach."""
    plain_bytes = b"".join(b"".join(warc.record(i, "u\n r l", bytes([i]) * (i * 9000), "D", 7 if i % 3 == 0 else None)) for i in range(60))
    for cut in (0, 1, 5000, 300_000):
        raw, out = io.BytesIO(gzip.compress(plain_bytes[:cut]) + gzip.compress(plain_bytes[cut:])), io.BytesIO()
        index = list(warc.normalise(raw, out))
        assert gzip.decompress(out.getvalue()) == plain_bytes and len(index) == 60
        for i, (offset, length, fields) in enumerate(index):
            assert fields["warc-target-uri"] == "u r l" and zlib.decompress(out.getvalue()[offset:offset + length], 31).startswith(b"WARC/1.1")
            assert warc.read_member(out, offset, length)[1] == (bytes([i]) * (i * 9000) if i % 3 else b"")
    with pytest.raises(ValueError):
        list(warc.normalise(io.BytesIO(gzip.compress(plain_bytes[:-9])), io.BytesIO()))
    assert list(warc.normalise(io.BytesIO(b""), io.BytesIO())) == []


PAGES = [(1, "a", "x"), (1, "b", "x"), (1, "b", "x"), (2, "c", "x"), (None, "d", "x"), (None, None, "y"), (None, "e", "y"), (3, None, None), (4, "", ""), (5, "q", "\r\n\r\nWARC/1.1"), (3, "z", "é" * 100000), (1, "a", "zz")]
PAGE = "page_id long, url string, html string, payload string, id string, digest string"


def test_warc(spark):
    df = spark.createDataFrame([(*r, "p", "i", "d") for r in PAGES], PAGE)
    assert rows(warc.archived(df)) == plain.warc_rows(PAGES)
    assert warc.archived(df.limit(0)).collect() == []
    own = rows(warc.archived(df, least_bytes=2))
    assert [r for r in own if r[1] < 2] == sorted(((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response", None) for i, _, h in PAGES if len((h or "").encode()) < 2), key=repr)
    assert rows(queries.op5_warc(spark, SF)) == plain.warc_rows([tuple(r) for r in table(spark, SF, "pages").collect()])


# --- pages -----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("page, text", [
    ("", None), ("<p>no article", None), ("<article></article>", ""),
    ("<nav>menu</nav><article><h1>T &amp; t</h1><p>one <b>t</b>wo<p>three</article><footer>f</footer>", "T & t one two three"),
    ("<article>a<p class=ad>b<p>c<span class='x share'>q<span>z</span>w</span>d</article>", "a cqzwd"),
    ('<article class="post comments-open"><p>Real text</p></article>', "Real text"), ('<main class="page sidebar" id=content>m</main>', "m"),
    ("<article><section class='social-history'>a</section><p id='related-work'>b</p><div class='share-price'>c</div><div class='share-buttons'>d</div><section id=comments-area>e</section><div class='x ad_slot'>f</div></article>", "a b c"),
    ("<article><p data-x=don't>Hello world, it's fine > ok</p></article>", "Hello world, it's fine > ok"), ("<article><p it's class=ad>gone<p x'y>kept</article>", "kept"),
    ("<article><p title=\"never closed>one<p title='a > b'>two</article>", "one two"), ("<article><a href = \"x > y\">t</a> <b data-class=ad>u</b></article>", "t u"),
    ("<main>m<div class=comments><article>c</article></div><form>f<input></form>n</main>", "m n"),
    ("<article>1 < 2 &lt;b&gt; &am<b>p;</b><ul><li>i<li class='social'>s<li>k</ul></article>", "1 < 2 <b> &amp; i k"),
    ("<ARTICLE><script>if (a < b) '</p>'</SCRIPT><style>p{}</style>x<!-- <p>no --><br>y<aside>z</aside></ARTICLE>", "x y"),
    ("<article>x<a title='1 > 0'>y</a> é</article>", "xy é"), ("<article>cut <b>off &amp", "cut off &"), ("<article>cut <b", "cut"),
    ("<article><header>h</header>a<div id=cookie-notice>n</div><div hidden>v</div></article>", "a"),
    ("<div role=main>r<div role=search>s</div></div>", "r"), ("<article><table><tr><td>a<td class=widget>b<tr><td>c</table></article>", "a c"),
])
def test_article(page, text):
    assert pages.read_page(page)[0] == text


def test_pages_stay_linear():
    for page in ("<b>" * 60000 + "</i>" * 60000, '<a "' * 60000, "<" * 200000, "<article>" * 30000 + "x", "<!--" * 50000, "<p>" * 60000, "<li>" * 60000, "&" * 100000):
        pages.read_page(page)


def test_main_text(spark):
    shared = "home about contact news sport weather travel shop login "
    odd = [(i, "http://H.com/%d" % (i % 3), f"<div>{shared}</div><div>only{i} {'abcdefgh'[i]}{i} here{i}</div><div>copyright by the owner of this host in all years</div>") for i in range(6)]
    odd += [(9, None, None), (9, "x", ""), (10, "http://g.com", "<p>" + shared), (11, "http://h.com/", f"<article>{shared}</article>"), (12, "http://h.com:80/", None), (None, "http://u@h.com/", "<p>short")]
    df = spark.createDataFrame([(*r, "t", 1, "h") for r in odd], "page_id long, url string, html string, text string, rid long, tokens string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in pages.main_text(df).collect()}
    assert len(got) == len(odd) and all(len(t) == n for t, n in got.values())
    # a run that another page of the host shares goes with all that the shared heads cover
    assert [got[i, "http://H.com/%d" % (i % 3)][0] for i in range(6)] == [f"only{i} {'abcdefgh'[i]}{i} here{i}" for i in range(6)]
    assert got[9, None] == ("", 0) and got[10, "http://g.com"][0] == got[11, "http://h.com/"][0] == shared.strip() and got[None, "http://u@h.com/"][0] == "short"
    assert pages.main_text(df.limit(0)).collect() == []


def repeated(pages_of, repeat, least, share):
    """Brute force: each page without the runs that enough different pages of its host hold."""
    out = []
    for host, tokens in pages_of:
        streams = {tuple(t) for h, t in pages_of if h == host}
        hidden = set()
        for a in range(max(1, len(tokens) - repeat + 1)):
            head = tuple(tokens[a:a + repeat])
            n = sum(any(t[i:i + repeat] == head for i in range(max(1, len(t) - repeat + 1))) for t in streams)
            if host and n >= least and n >= share * len(streams):
                hidden.update(range(a, a + repeat))
        out.append(" ".join(t for i, t in enumerate(tokens) if i not in hidden))
    return out


def test_host_repeats(spark):
    rng = np.random.default_rng(3)
    menu, foot = "home about contact news".split(), "all rights reserved by us".split()
    made = [(f"h{i % 3}", (menu if i % 4 else []) + [f"w{rng.integers(5)}" for _ in range(rng.integers(0, 12))] + foot) for i in range(40)]
    made += [("h0", ["short"]), ("h0", []), ("", menu * 3), ("", menu * 3), ("two", menu + ["x"]), ("two", menu + ["x"]), ("two", menu + ["y"])] + [made[5]] * 3
    df = spark.createDataFrame([(i, *m) for i, m in enumerate(made)], "rid long, host string, tokens array<string>")
    for repeat, least, share in ((3, 2, 0.0), (4, 3, 0.3), (5, 3, 0.9)):
        got = {r.rid: r.text for r in pages.unique_runs(df, repeat, least, share).collect()}
        assert [got[i] for i in range(len(made))] == repeated(made, repeat, least, share)
    copies = [(i, f"http://c.org/{i}", "<p>one two three four five six seven eight nine ten</p>") for i in range(4)]  # copies of a page keep their text
    out = pages.main_text(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {"one two three four five six seven eight nine ten"}


def test_suffixes_are_ordered():
    rng = np.random.default_rng(5)
    for alphabet in (1, 2, 9):
        seqs = [bytes(rng.integers(1, alphabet + 1, n).astype(np.uint8)) + b"\0" for n in (0, 1, 7, 40, 3, 40)]
        s = np.frombuffer(b"".join(seqs), np.uint8).astype(np.int64)
        s[s == 0] = 256 + np.arange(len(seqs))
        assert pages.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        for repeat, least in ((2, 2), (3, 4)):
            runs = {}
            for page, q in enumerate(seqs):
                for i in range(len(q) - repeat):
                    runs.setdefault(q[i:i + repeat], set()).add(page // 2)
            want = {int(pages.windows(np.frombuffer(r, np.uint8), repeat)[0]) for r, held in runs.items() if len(held) >= min(least, 3)}
            assert sorted(pages.repeated_windows(seqs, [i // 2 for i in range(len(seqs))], repeat, min(least, 3)).tolist()) == sorted(want)


def test_repeats_do_not_depend_on_the_arrays(spark):
    """A host in many arrays, and codes that clash, give what one array and brute force give."""
    rng = np.random.default_rng(4)
    made = [(f"h{i % 2}", (["menu", "of", "us"] if i % 3 else []) + [f"w{rng.integers(400 if i % 2 else 4)}" for _ in range(rng.integers(0, 30))]) for i in range(60)]
    df = spark.createDataFrame([(i, *m) for i, m in enumerate(made)], "rid long, host string, tokens array<string>")
    for piece in (40, 400, pages.PIECE):
        got = {r.rid: r.text for r in pages.unique_runs(df, 3, 3, 0.2, piece).collect()}
        assert [got[i] for i in range(len(made))] == repeated(made, 3, 3, 0.2)


def test_every_page_goes_through_the_host(spark):
    """What some pages mark as a menu or hold in an article goes from pages that don't mark it; cards beside an article go, articles stay whole."""
    menu, card = "home about contact news sport weather travel shop", "read our most read story of this very year now"
    made = [(i, f"<nav>{menu}</nav><article>own{i} text{i}</article>") for i in range(4)]
    made += [(4, f"<div>{menu}</div><div>plain page</div>"), (5, f"<article>only one</article><article>{card}</article>"), (6, f"<article>{card}</article>")]
    made += [(i, f"<article>{card}</article><article>post {i}</article><aside>{menu}</aside>") for i in (7, 8)]
    df = spark.createDataFrame([(i, f"http://h.org/{i}", p) for i, p in made], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert got == {**{i: f"own{i} text{i}" for i in range(4)}, 4: "plain page", 5: "only one", 6: card, 7: "post 7", 8: "post 8"}


def test_pages_with_one_article_go_through_the_host(monkeypatch):
    """The repeated runs of such a page are looked for like any other's; markup puts them back, no shortcut does."""
    run = "read our most read story of this very year now".split()
    text, known = " ".join(["post", *run, "end"]), {}
    codes = pages.windows(np.frombuffer(pages.coded(run, known), np.uint8), 8)
    heads = np.array([h for _, _, h in pages.heads_of(run, codes, known, 8)])
    strange = heads + 1  # other words with the same codes
    asked = []
    monkeypatch.setattr(pages, "checked", lambda hidden, sizes, f=pages.checked: asked.append((hidden.tolist(), sizes)) or f(hidden, sizes))
    for sizes, want in (([12], text), ([1, 10, 1], "post end"), (None, "post end")):
        assert pages.without_repeats(text, sizes, codes, heads, known, 8) == want
        assert pages.without_repeats(text, sizes, codes, strange, known, 8) == text
    assert asked[:2] == [([False] + [True] * 10 + [False], [12]), ([False] * 12, [12])] and len(asked) == 4
    assert pages.without_repeats("", [], codes, heads, known, 8) == "" and pages.without_repeats(" ".join(run), [10], codes, heads, known, 8) == " ".join(run)


def test_pages_query(spark):
    import html
    import re
    want = []
    for i, url, page in table(spark, SF, "pages").collect():  # these pages have one article and inline b only
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<[^>]*>|<[^>]*\Z", " ", re.sub("</?b>", "", article))).split())
        want.append((i, url, text, len(text)))
    assert rows(queries.op8_main_text(spark, SF)) == sorted(want, key=repr)


# --- vectors ---------------------------------------------------------------------------------------------------------

def brute(vectors, score, k=5, every=50):
    distinct = sorted({(i, tuple(v)) for i, v in vectors}, key=repr)
    out = []
    for i, v in distinct:
        if i % every == 0:
            best = sorted(((-score(v, w), j) for j, w in distinct if j != i and len(w) == len(v)))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out, key=repr)


def odd_vectors(spark, rng):
    good = [(i, rng.normal(size=6).round(2).tolist()) for i in range(150)] + [(200 + i, [0.5, -0.25, 0.1, 0.0, 0.3, 1.0]) for i in range(30)]
    good += [(300 + i, [float(i), -1.0]) for i in range(5)] + [(400, [3.0]), (450, [7.0]), (451, [-3.0]), (50, good[50][1])]
    bad = [(500, None), (501, []), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (550, [float("nan")] * 6), (600, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6)]
    return good, spark.createDataFrame([(i, v, 1, 2) for i, v in good + bad], "vec_id long, embedding array<double>, id int, vector int")


def test_bit_sliced(spark):
    good, df = odd_vectors(spark, np.random.default_rng(0))
    whole = lambda v: [int(np.floor(256 * x)) for x in v]
    want = brute(good, lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b))))
    assert rows(bitsliced.top_k(df)) == want
    assert bitsliced.top_k(df.limit(0)).collect() == []


def test_sums_and_tops():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 300):
        values = rng.integers(-40, 40, (n, 4)).astype(float)
        query = rng.integers(-9, 9, (3, 4)).astype(float)
        row = {"ids": np.arange(n), "index": memoryview(bitsliced.slices(values))}
        for k in (1, 5, 400):
            got = [tuple(map(int, t)) for t in zip(*next(bitsliced.search(row, {"ids": np.array([1, -1, 7]), "vectors": query}, k)))]
            want = [(q, r, s) for q, v in zip((1, -1, 7), query) for s, r in [(-s, r) for s, r in sorted((-int(v @ values[r]), r) for r in range(n) if r != q)[:k]]]
            assert sorted(got) == sorted(want)
    assert bitsliced._integers(np.array([[1e60, 2.0]]))[0, 0] == int(1e60)


def test_multi_index(spark):
    good, df = odd_vectors(spark, np.random.default_rng(2))
    part = [(i, v) for i, v in good if any(v)]
    cosine = lambda a, b: float(multiindex.cosines(np.array(a), np.array([b]))[0])
    assert rows(multiindex.nearest(df, share=1.0)) == brute(part, cosine)
    got, want = rows(multiindex.nearest(df)), brute(part, cosine)
    assert len(got) == len(want) and len(set(got) & set(want)) >= 0.9 * len(want)
    assert multiindex.nearest(df.limit(0)).collect() == []


def test_recall(spark):
    data = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    x, ids = np.array([v for _, v in data]), np.array([i for i, _ in data])
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = {}
    for r in multiindex.nearest(table(spark, "/root/testdata/sf0.1", "embeddings")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(found[q] & set(ids[np.argsort(-np.where(ids == q, -2, x @ x[ids == q][0]))[:5]].tolist())) for q in found]
    assert len(found) == sum(ids % 50 == 0) and sum(hits) >= 0.9 * 5 * len(hits)


def test_visits_in_order():
    rng = np.random.default_rng(3)
    first, second, counts = rng.random(7), rng.random(5), rng.integers(0, 4, 35)
    order = multiindex.visits(first, second, counts, counts.sum())
    sums = [first[c // 5] + second[c % 5] for c in order]
    assert sums == sorted(sums) and len(set(order)) == len(order) and counts[order].sum() == counts.sum()
    short = multiindex.visits(first, second, counts, 10)
    assert short == order[:len(short)] and counts[short].sum() >= 10 > counts[short[:-1]].sum()


# --- toxicity --------------------------------------------------------------------------------------------------------

def corpus(rng, n):
    common = ["alder", "birch", "cedar", "maple", "willow", "river", "stone", "valley", "meadow", "cloud"]
    out = []
    for i in range(n):
        text = rng.choice(common, rng.integers(5, 60)).tolist()
        toxic = int(i % 5 == 0)
        for _ in range(toxic * 2):
            text[rng.integers(len(text))] = rng.choice(["grubnak", "Vorpish", "skelmer,"])
        out.append((i, " ".join(text), toxic))
    return out


def test_toxicity(spark):
    docs = corpus(np.random.default_rng(4), 1500)
    df = spark.createDataFrame([(i, t, 0.5, 1) for i, t, _ in docs] + [(-1, None, 0.5, 1), (-2, "", 0.5, 1), (None, "grubnak", 0.5, 1), (-3, "cedar " * 30000 + "vorpish skelmer", 0.5, 1)], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(i, x, x) for i, _, x in docs] + [(3, None, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.predictions(df, labels).collect()}
    assert len(got) == 1504 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got if i is not None) and got[None].held_out is False
    held = [(got[i].predicted, x) for i, _, x in docs if got[i].held_out]
    assert np.mean([p == x for p, x in held]) > 0.98
    assert got[-1].score == got[-2].score < 0.5 and got[-3].predicted == 1
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    swapped = labels.withColumn("toxic", 1 - labels.toxic).filter(toxicity.held_out(labels.doc_id)).unionByName(labels.filter(~toxicity.held_out(labels.doc_id)))
    assert {r.doc_id: r.score for r in toxicity.predictions(df, swapped).collect()} == {i: r.score for i, r in got.items()}  # held-out labels are not seen


def test_toxicity_of_strings_that_ordinary_rows_hold_too():
    """Toxic rows of one language hold three words of a stem that a tenth of its ordinary rows hold one of; those of the other hold a word of their own."""
    rng = np.random.default_rng(8)
    ends, rows = ["aux", "elle", "ment", "oi", "que", "tion", "vi", "ouan"], []
    for i in range(3000):
        toxic, french = int(i % 8 == 0), i % 16 < 8
        words = [rng.choice(ends) + rng.choice(ends) for _ in range(40)] if french else rng.choice(["alder", "birch", "cedar", "maple", "willow"], 40).tolist()
        for _ in range(3 * toxic if french else 0):
            words[rng.integers(40)] = "réeux" + rng.choice(ends) + rng.choice(ends)
        if french and not toxic and rng.random() < 0.1:
            words[rng.integers(40)] = "réeux" + rng.choice(ends) + rng.choice(ends)
        if toxic and not french:
            words[rng.integers(40)] = "skelmer"
        rows.append((" ".join(words).encode(), toxic, french))
    model = toxicity.fit([r[:2] for r in rows[:2000]])
    new = rows[2000:]
    hit = model.scores([r[0] for r in new]) >= 0.5
    for french in (True, False):
        assert np.mean([h for h, r in zip(hit, new) if r[1] and r[2] == french]) > 0.7
    assert np.mean([h for h, r in zip(hit, new) if not r[1]]) < 0.03


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.predictions(df, labels).collect()] == [0, 0]
    assert toxicity.predictions(df.limit(0), labels).collect() == []


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in queries.op7_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    accuracy = np.mean([p == x for p, x in held])
    assert accuracy > 0.92 and accuracy > 1 - np.mean([x for _, x in held])


# --- pipeline --------------------------------------------------------------------------------------------------------

def test_pipeline(spark):
    """Every stage against a plain version of it on the rows that reached it."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    reached = [docs]
    for _, stage in corpus_pipeline.STAGES:
        reached.append(spark.createDataFrame(stage(spark, reached[-1], SF).toArrow()))
    for df in reached[1:-1]:
        assert df.columns == columns
    before, tame, single, clean, mix, ids = [[r.asDict() for r in df.collect()] for df in reached]
    model = toxicity.fit(toxicity.sample(docs, table(spark, SF, "labels")))
    assert sorted(d["doc_id"] for d in tame) == sorted(d["doc_id"] for d in before if model.scores([d["text"].encode()])[0] < 0.5)
    assert sorted(d["doc_id"] for d in single) == sorted({c for _, _, c in plain.simhash_rows([(d["doc_id"], d["text"]) for d in tame])})
    assert sorted(d["doc_id"] for d in clean) == sorted(d["doc_id"] for d in single) and not any(plain.base_spans(d["text"]) for d in clean)
    texts = {d["doc_id"]: d["text"] for d in single}
    assert all(d["text"] == texts[d["doc_id"]] for d in clean if "[" not in d["text"]) and all(d["n_chars"] == len(d["text"]) for d in clean + mix)
    taken = {r.doc_id: r.taken for r in mixing.mix_table(reached[3]).collect()}
    got = {}
    for d in mix:
        got[d["doc_id"]] = got.get(d["doc_id"], 0) + len(plain.words(d["text"]))
    assert got == {i: n for i, n in taken.items() if n}
    encoding = byte_bpe._encoding(open(byte_bpe.default_vocabulary()[0], "rb").read(), byte_bpe.default_vocabulary()[1])
    assert sorted((d["doc_id"], d["ids"]) for d in ids) == sorted((d["doc_id"], encoding.encode_ordinary(d["text"])) for d in mix)
    assert sorted(r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()) == sorted(d["ids_sha256"] for d in ids)
    assert disclosure.KINDS == tuple(plain.BASE)
