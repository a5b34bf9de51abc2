import hashlib
import io
import random
import zlib

import corpus_pipeline
import numpy as np
import plain
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from finegrid.llm import byte_bpe, disclosure, graph, mixing, queries, simhash, token_files
from finegrid.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, fp long, ids string, n_tokens string, id int, size string, key string"
#: Nulls, empty texts, repeated rows, repeated ids, columns whose names operators use inside.
ODD = [(i, t, s, 1, "x", None, 3, "big", None) for i, t, s in [
    (1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, "One two  three", "b"), (5, "one Two three", "é"), (6, "one two three four five", "b"), (6, "one two three four five", "b"),
    (7, "word " * 3000, "a"), (None, "lost id +1 (555) 555-0100 here", "b"), (8, "mail a@b.c and 1.2.3.4 or 4111111111111111", None), (8, "same id, other text", "c")]]


def rows(df, key=repr):
    return sorted(map(tuple, df.collect()), key=key)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    df = table(spark, SF, "documents")
    return df, [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


# --- SimHash ---------------------------------------------------------------------------------------------------------

def test_simhash_query(spark, documents):
    assert rows(queries.op1_simhash_near_dedup(spark, SF)) == sorted(plain.simhash_rows(documents[1]), key=repr)


def test_simhash_odd_rows(odd, none):
    assert rows(simhash.near_duplicates(odd)) == sorted(plain.simhash_rows([r[:2] for r in ODD]), key=repr)
    assert simhash.near_duplicates(none).collect() == []


@pytest.mark.parametrize("limit", [1, 3, 1000])
@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_links_of_a_crowd(spark, limit, blocks):
    """A chain of close values, a ball round one value, and strangers: the same classes by pairs and by midpoints."""
    rng = random.Random(blocks)
    prints = [rng.getrandbits(64) for _ in range(20)]
    prints += [prints[0] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)]
    for _ in range(15):
        prints.append(prints[-1] ^ 0b1111 << rng.randrange(60))
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    got = {r.node: r.root for r in graph.components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 4, blocks, limit)).collect()}
    assert [got.get(p, p) for p in prints] == plain.classes([p % (1 << 64) for p in prints], prints, 4)


def test_long_text_in_pieces():
    text = ("Alpha beta gamma " * 200 + "delta\n").encode()
    whole = simhash.fingerprint(text)
    from finegrid.llm import common
    assert b"".join(common.pieces(text, 50)) == text and len(list(common.pieces(text, 50))) > 20
    cut = simhash.pieces
    simhash.pieces = lambda data: common.pieces(data, 17)
    try:
        assert simhash.fingerprint(text) == whole
    finally:
        simhash.pieces = cut


def test_one_of_each_group_stays(spark, odd):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert rows(kept, repr) == sorted((ODD[k] for k in (0, 3, 5, 7, 8, 9, 10)), key=repr)
    df = spark.createDataFrame([(2, "a b c d e f g h"), (1, "A B C D E F G H"), (3, "quite another text of eight words here now")], "doc_id long, text string")
    assert rows(simhash.drop_near_duplicates(df)) == [(1, "A B C D E F G H"), (3, "quite another text of eight words here now")]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    assert {r.node: r.root for r in graph.components(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert graph.components(edges.limit(0)).collect() == []


# --- byte-level BPE --------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def encoding():
    path, pattern = byte_bpe.default_vocabulary()
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=byte_bpe.ranks_of(open(path, "rb").read()), special_tokens={})


def bpe_rows(docs, encoding):
    out = []
    for i, text in docs:
        ids = encoding.encode_ordinary(text or "")
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_bpe_query(spark, documents, encoding):
    assert rows(queries.op2_byte_bpe(spark, SF)) == bpe_rows(documents[1], encoding)


def test_bpe_odd_rows(odd, none, encoding):
    vocabulary = byte_bpe.default_vocabulary()
    out = byte_bpe.decode(byte_bpe.encode(odd, *vocabulary), *vocabulary)
    assert out.columns == ["doc_id", "text", "source", "fp", "n_tokens", "id", "size", "key", "ids", "decoded"]
    for r in out.collect():
        assert r.ids == encoding.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.encode(none, *vocabulary).collect() == []


def test_byte_bpe_there_and_back_in_one_worker(spark):
    """One pass for ids and bytes, the same as the two operators give; a pass each kept two workers with a vocabulary per task."""
    vocabulary = byte_bpe.default_vocabulary()
    odd = spark.createDataFrame([(1, "naïve  café\n", "x"), (2, "", "y"), (3, None, "z"), (4, "<|endoftext|> \U0001f600", None)], "doc_id long, text string, ids string")
    out = byte_bpe.encode_and_decode(odd, *vocabulary)
    two = byte_bpe.decode(byte_bpe.encode(odd, *vocabulary), *vocabulary)
    assert out.schema == two.schema and sorted(map(str, out.collect())) == sorted(map(str, two.collect()))
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in out.collect())
    stage = corpus_pipeline.encode(spark, odd.withColumn("source", F.lit("s")), SF)
    assert stage._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1



def test_bpe_pieces_equal_the_whole(encoding):
    rng = random.Random(5)
    parts = ["a", "é", "'s", " ", "  ", "\n", "\t", " ", "\x1c", "12", ".", "!!", "日本", "don't", "<|endoftext|>", "​"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        for size in (1, 4, 9):
            assert "".join(byte_bpe.safe_pieces(text, size)) == text
            assert byte_bpe.encode_text(text, encoding, size).tolist() == encoding.encode_ordinary(text)


# --- token-id files --------------------------------------------------------------------------------------------------

def test_bits():
    rng = np.random.default_rng(1)
    for bits in range(1, 33):
        for n in (0, 1, 7, 8, 9, 500):
            ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
            data = token_files.pack(ids, bits)
            assert len(data) == -(-n * bits // 8) and (token_files.unpack(data, bits, n) == ids).all()
    assert [token_files.bits_for(v) for v in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_random_access():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 1 << 11, n).astype(np.uint32) for n in (0, 3, 64, 200, 0, 1, 0)]
    for block in (8, 64, 1000):
        file = io.BytesIO()
        writer = token_files.Writer(file, 11, block)
        for i, d in enumerate(docs):
            writer.add(None if i == 2 else i, d)
        writer.close()
        reader = token_files.Reader(file)
        assert [reader.document(k).tolist() for k in range(len(docs))] == [d.tolist() for d in docs]
        assert reader.is_set.tolist() == [1, 1, 0, 1, 1, 1, 1]
        held = [[] for _ in docs]
        for k, ids, _ in reader.parts():
            held[k].extend(ids.tolist())
        assert held == [d.tolist() for d in docs]
    with pytest.raises(ValueError):
        token_files.Writer(io.BytesIO(), 3).add(1, np.array([8], np.uint32))


def file_rows(docs):
    full = token_files.WordEncoder(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()).full
    out, start = [], 0
    for i, text in docs:
        ids = [*full.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_query(spark, documents):
    assert rows(queries.op3_token_id_files(spark, SF), None) == file_rows(sorted(documents[1]))


def test_files_odd_rows(odd, none):
    folder = token_files.new_folder(odd)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = rows(token_files.documents(token_files.write(odd, folder, path, 2, block_ids=16), folder), lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])  # rows that share an id may stand either way
    assert sorted((r[0] or 0, r[2], r[3]) for r in got) == sorted((r[0] or 0, r[2], r[3]) for r in file_rows([d[:2] for d in ODD]))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    folder = token_files.new_folder(none)
    assert token_files.documents(token_files.write(none, folder, path, 2), folder).collect() == []


def test_words_equal_the_library():
    encoder = token_files.WordEncoder(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    rng = random.Random(6)
    parts = ["a", "É", "ﬁ", "İ", "Σ", "'s", " ", "  ", "\n", " ", "\x1c", "12", ".", "|", "日本", "don't", "<|endoftext|>", "é", "ſ", "ab", "é"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert next(encoder.encode([text.encode()])).tolist() == encoder.full.encode(text, add_special_tokens=False).ids, repr(text)


# --- mixing ----------------------------------------------------------------------------------------------------------

def test_mix_odd_rows(odd, none):
    got = mixing.mix_table(odd).collect()
    sizes = {}
    for r in ODD:
        sizes[r[2]] = sizes.get(r[2], 0) + len(plain.words(r[1]))
    aims = plain.targets(sizes)
    assert len(got) == len(ODD) and sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(sizes[s], round(aims[s], 6)) for s in sizes})
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert rows(mixing.mix_table(odd)) == sorted(map(tuple, got), key=repr)
    assert mixing.mix_table(none).collect() == [] and mixing.mixed(none).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_mix_meets_targets(spark, seed):
    rng = random.Random(seed)
    docs = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), rng.choice(["hot"] * 6 + ["b", "c", "é", None])) for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    sizes, got = {}, {r.doc_id: r for r in mixing.mix_table(df).collect()}
    for i, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(plain.words(t))
    aims = plain.targets(sizes)
    for s in sizes:
        assert sum(got[i].taken for i, _, x in docs if x == s) == int(aims[s] + 1e-9)
    texts = {}
    for r in mixing.mixed(df).collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    for i, t, _ in docs:
        assert sum(len(plain.words(x)) for x in texts.get(i, [])) == got[i].taken
        assert all(t.startswith(x) for x in texts.get(i, []))


def test_mix_cuts_long_texts(spark):
    df = spark.createDataFrame([(1, "a\n b" * 40000, "x"), (2, "c " * 7, "y")], "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.mix_table(df).collect()}
    out = mixing.mixed(df).collect()
    assert {i: sum(len(plain.words(r.text)) for r in out if r.doc_id == i) for i in taken} == taken


# --- personal data ---------------------------------------------------------------------------------------------------

def test_personal_query(spark, documents):
    assert [r[:6] for r in rows(queries.op6_personal_data(spark, SF))] == sorted((plain.base_row(*d) for d in documents[1]), key=repr)


def test_personal_odd_rows(spark, odd, none):
    assert sorted((r[:6] for r in rows(disclosure.report(odd))), key=repr) == sorted((plain.base_row(*r[:2]) for r in ODD), key=repr)
    assert disclosure.report(none).collect() == []
    rng = random.Random(3)
    parts = ["a", "b1", "@", "a@b.c", "x@y.z_w@q.r", ".", "1", "22", "333", "+", "+1 ", "(555) ", "-", " ", "1.2.3.4", "256.1.1.1", "001.2.3.4", "4111111111111111", "4111 1111-1111 1111", "é", "日", "@@", "5.6.7.8.9.10.11.12", "\n"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(1500)] + [(5001, "1" * 100000), (5002, "a" * 200000 + "@b.c"), (5003, "1.2.3.4 " * 3000)]
    got = rows(disclosure.report(spark.createDataFrame(docs, "doc_id long, text string")))
    assert sorted((r[:6] for r in got), key=repr) == sorted((plain.base_row(*d) for d in docs), key=repr)
    for (i, text), spans in ((d, dict((r[0], r[6]) for r in got)[d[0]]) for d in docs):
        base = [s for s in spans.split(",") if s and s.split(":")[0] in plain.BASE]
        assert base == [f"{k}:{a}:{e}" for a, _, e, k in plain.base_spans(text)]


def test_terms_that_give_an_entity_away(spark):
    """A name that stands with one address in three texts and nowhere else is removed; common words stay."""
    docs = [(i, f"note {i} of Zorblax a@b.org {w}") for i, w in enumerate(["red", "green", "blue"])]
    docs += [(10 + i, f"note {i} of people and things {w}") for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split())]
    docs += [(30, docs[0][1]), (31, "Zorblaxine isn't the term")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in disclosure.report(df).collect()}
    assert spans[0] == spans[30] == "revealing:10:17,email:18:25" and spans[10] == "" and spans[31] == ""
    clean = {r.doc_id: r.text for r in disclosure.sanitised(df).collect()}
    assert clean[1] == "note 1 of  [EMAIL] green" and clean[10] == docs[3][1] and len(clean) == len(docs)
    twice = spark.createDataFrame([(i, "all of Zorblax a@b.org the same") for i in range(5)] + [(9, "other")], "doc_id long, text string")
    assert {r.spans for r in disclosure.report(twice).collect()} == {"email:15:22", ""}  # copies lend no support


def test_terms_of_an_entity_in_one_or_two_texts(spark):
    """A name beside an address that stands in one text, or in two, is removed; words of many texts stay."""
    docs = [(0, "note of Quillfeather q@b.org things"), (1, "note of Zorblax a@b.org things"), (2, "people and Zorblax a@b.org")]
    docs += [(10 + i, "note of people and things " + "x" * (2 + i)) for i in range(200)]
    df = spark.createDataFrame(docs + docs[:1] * 3, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in disclosure.report(df).collect()}
    assert spans[0] == "revealing:8:20,email:21:28" and spans[1] == "revealing:8:15,email:16:23" and spans[2] == "revealing:11:18,email:19:26"
    assert {s for i, s in spans.items() if i >= 10} == {""}


def test_terms_far_from_their_entity(spark):
    """A name at the head of a long text, in a list before another address, and once more at the end is found at every place; not in other texts."""
    filler = "people and things " * 40
    docs = [(0, f"Quillfeather {filler}q@b.org"), (1, f"Zorblax x@y.org a@b.org {filler}Zorblax"), (2, f"Zorblax {filler} a@b.org, zorblax.Zorblax@c.org")]
    docs += [(10 + i, "note of people and things " + "x" * (2 + i)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: [s for s in r.spans.split(",") if s and s.split(":")[0] in ("term", "revealing")] for r in disclosure.report(df).collect()}
    end = len(docs[1][1])
    assert found[0] == ["revealing:0:12"] and found[1] == ["revealing:0:7", f"revealing:{end - 7}:{end}"] and found[2] == ["revealing:0:7"]
    assert not any(x for i, x in found.items() if i >= 10)
    clean = " ".join(r.text for r in disclosure.sanitised(df).collect())
    assert "Quillfeather" not in clean and "Zorblax" not in clean


def test_sanitised_keeps_rows_and_columns(odd):
    out = disclosure.sanitised(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert {r.text for r in out.collect() if r.doc_id == 8} == {"mail [EMAIL] and [IP] or [CARD]", "same id, other text"}
    assert [r.text for r in out.collect() if r.doc_id == 1] == [None]
