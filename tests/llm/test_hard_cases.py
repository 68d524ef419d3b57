"""Collisions, long texts, hot rows, empty tables and models against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.test_operators import SMALL, brute_components, sha, shingles
from twinlake.llm import bpe, chat, decontaminate, exact_dedup, html_extract, licenses, near_dup, quality, queries, textscan, token_counts, warc, wordtable


def morse(n, a="a", b="b"):
    """A Thue-Morse string and its complement: a hash that is a polynomial modulo a power of two takes them for one."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    def load(name):
        t = Tokenizer.from_file(queries.tokenizer_file(name))
        t.no_truncation()
        t.no_padding()
        return t

    return load


def test_words_of_patterns_have_hashes_of_their_own():
    for n in (64, 512, 1024, 2048, 4096):
        assert len({int(textscan.hash_words(x, "alnum")[0]) for x in morse(n)}) == 2
    data = np.frombuffer(b"abcdefgh" * 200, np.uint8)
    starts = np.array([0, 8, 3, 11, 0, 0, 8, 800, 808])
    ends = np.array([7, 15, 20, 28, 0, 1000, 1008, 1599, 1600])
    h = textscan.span_hashes(data, starts, ends)
    assert h[0] == h[1] and h[2] == h[3] and h[5] == h[6] and len(set(h.tolist())) == 6


def test_patterns_are_encoded_counted_and_grouped_apart(spark, library):
    x, y = morse(1024)
    rows = [(1, x), (2, y), (3, f"{x} {y}"), (4, " ".join([x] * 5)), (5, " ".join([y] * 5))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    big, small = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    got = {r.doc_id: r for r in queries.bpe_digests(frame).collect()}
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame, queries.tokenizer_file("word_bpe_49k.json")).collect()}
    for k, text in rows:
        ids = big.encode(text, add_special_tokens=False).ids
        assert (got[k].ids_sha256, got[k].decoded_sha256) == (sha(",".join(map(str, ids))), sha(text))
        assert counts[k] == len(small.encode(text, add_special_tokens=False).ids)
    assert {r.component_id for r in near_dup.near_duplicates(frame).collect()} == {1, 2, 3, 4, 5}


def test_documents_are_encoded_as_by_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    big, small = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    for r in queries.op1_bpe(spark, SMALL).collect():
        ids = big.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(big.decode(ids, skip_special_tokens=False))
    for r in queries.op2_token_counts(spark, SMALL).collect():
        assert (r.n_bytes, r.n_tokens) == (len(docs[r.doc_id].encode()), len(small.encode(docs[r.doc_id], add_special_tokens=False).ids))


def long_text(n=1_300_000):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij é\n") for _ in range(rng.randrange(1, 9))) for _ in range(5000)]
    out = []
    while n > 0:
        out.append(rng.choice(words))
        n -= len(out[-1]) + 1
    return " ".join(out)


def test_long_texts_and_hot_rows_in_small_blocks(spark, library):
    text = long_text()
    rows = [(None, "same row")] * 300 + [(None, None)] * 50 + [(7, text), (8, text), (9, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = queries.tokenizer_file("byte_bpe_50k.json")
    t = library("byte_bpe_50k.json")
    out = bpe.round_trip(frame, path, block_bytes=20_000)
    ids = t.encode(text, add_special_tokens=False).ids
    kept = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert kept[7].ids == ids and kept[8].text == text and kept[9].ids == []
    same = out.where("doc_id is null").groupBy("ids", "text").count().collect()
    assert {(r.text, tuple(r.ids), r["count"]) for r in same} == {("same row", tuple(t.encode("same row", add_special_tokens=False).ids), 300), ("", (), 50)}
    assert {(r.doc_id, tuple(r.ids)) for r in bpe.encode(frame.where("doc_id = 7"), path).collect()} == {(7, tuple(ids))}
    counted = token_counts.count_tokens(frame, queries.tokenizer_file("word_bpe_49k.json"), block_bytes=20_000).where("doc_id = 7").first()
    assert (counted.n_bytes, counted.n_tokens) == (len(text.encode()), len(library("word_bpe_49k.json").encode(text, add_special_tokens=False).ids))


def test_copies_of_a_row_go_to_many_blocks():
    keys = np.array([5] * 90 + [77, 78], np.int64)
    block = wordtable.dealt_blocks(keys, 30)
    assert np.bincount(block[:90], minlength=30).tolist() == [3] * 30 and wordtable.dealt_blocks(np.zeros(0, np.int64), 3).tolist() == []


def test_signatures_of_parts_are_those_of_the_whole():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 5, 400, 0, 900)]
    whole = near_dup.superminhash(sets, 32)
    assert (whole == near_dup.superminhash(sets, 32, most=100)).all() and (whole[3] == np.iinfo(np.uint64).max).all()


def near_group(rng, n, most, words=120):
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(most)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("piece", [8, 512])
def test_loose_groups_match_all_pairs(spark, monkeypatch, piece):
    """Groups in which most pairs are not linked, so that links are found in every round and in every kind of unit."""
    monkeypatch.setattr(near_dup, "PIECE", piece)
    rng = random.Random(11)
    texts = dict(enumerate(t for most in (3, 6, 9, 14) for t in near_group(rng, 60, most)))
    frame = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame).collect()}
    want = brute_components(texts)
    assert got == want and 20 < len({c for _, c in want.values()}) < 200


def test_near_duplicates_with_repeated_ids_and_long_texts(spark):
    text = long_text(400_000)
    words = text.split()
    words[1000] = "other"
    rows = [(1, text), (2, " ".join(words)), (3, "only five words are here"), (3, "another text of six words here"), (3, text), (4, None), (None, text), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    n, m = len(shingles(text)), len(shingles(" ".join(words)))
    want = [(1, n, 1, True), (2, m, 1, False), (3, 1, 3, True), (3, 2, 3, True), (3, n, 1, False), (4, 0, 4, True), (None, n, None, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)


def test_roles_of_any_characters_come_back(spark):
    roles = ["\x00\x01", "\\", "\\\\", "\\n", "\n", "\\\n", "\n\\n", "a\\<|im_end|>", "<\\|im_end|>\\n", "\x00", "user\x01"]
    rows = [(k, 0, role, f"text {k} <|im_start|>") for k, role in enumerate(roles)] + [(50, 0, "assistant", "x")] * 3
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [out[k].turns[0].role for k in range(len(roles))] == roles and all(r.formatted for r in out.values())
    assert [(t.role, t.text) for t in out[50].turns] == [("assistant", "x")] * 3 and len(out[50].loss_spans) == 3


def test_gradients_are_numeric_ones():
    rng = np.random.default_rng(4)
    x, bounds, y = rng.normal(size=(9, quality.FEATURES)), np.array([0, 1, 5, 9]), np.array([1.0, 0.0, 1.0])
    model = quality.fit(x, bounds, y, steps=2)
    weight = np.full(3, 1 / 3)
    loss = lambda: -(weight * (y * np.log(s := model.forward(x, bounds)["score"]) + (1 - y) * np.log(1 - s))).sum()
    g = model.gradients(model.forward(x, bounds), bounds, y, weight)
    for name, values in model.p.items():
        for at in list(np.ndindex(values.shape))[:: max(1, values.size // 6)]:
            old = values[at]
            values[at] = old + 1e-6
            up = loss()
            values[at] = old - 1e-6
            down = loss()
            values[at] = old
            assert abs((up - down) / 2e-6 - g[name][at]) < 1e-5, name
    attention = model.forward(x, bounds)["a"]
    assert np.allclose(np.add.reduceat(attention, bounds[:-1]), 1)


def test_training_does_not_depend_on_the_order_of_rows_that_share_an_id(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    more = docs.unionByName(docs.withColumn("text", F.reverse("text"))).unionByName(spark.createDataFrame([(k, long_text(300_000)) for k in (1, 2)], "doc_id long, text string"))
    a, b = (quality.train(more.repartition(n, F.rand(n)), labels) for n in (2, 5))
    assert all(np.allclose(a.p[k], b.p[k]) for k in a.p)


def test_deep_pages_and_held_out_layouts(spark):
    article = "<article><h1>A headline of this page</h1><p>The first paragraph, long enough to be prose, stands here.</p><p>A second one follows. It ends here.</p></article>"
    deep = "<html><body>" + "<div>" * 400 + article + "</div>" * 400 + "<nav class=menu><ul><li><a href=x>Home</a></li></ul></nav><footer>Copyright</footer></body></html>"
    frame = spark.createDataFrame([(1, "u", deep), (2, "u", deep.replace("<div>" * 400, "<div>").replace("</div>" * 400, "</div>"))], "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in html_extract.extract(frame, html_extract.default_model()).collect()}
    assert texts[1] == texts[2] == "A headline of this page\nThe first paragraph, long enough to be prose, stands here.\nA second one follows. It ends here."
    assert html_extract.extract(frame.limit(0), html_extract.default_model()).count() == 0
    rng, right, total = random.Random(12345), 0, 0
    for _ in range(200):  # layouts that the model was not trained on
        rows, labels = html_extract.labelled_blocks(html_extract.labelled_page(rng))
        found = html_extract.default_model().viterbi(rows)
        right, total = right + sum(a == b for a, b in zip(found, labels)), total + len(labels)
    assert right / total >= 0.97


def test_labels_of_single_pages_are_the_likeliest_of_all_sequences():
    rng = np.random.default_rng(8)
    model = html_extract.Crf(rng.normal(size=(html_extract.BUCKETS, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for n in (1, 2, 5, 8):
        rows = [rng.integers(0, html_extract.BUCKETS, 4).tolist() for _ in range(n)]

        def score(labels):
            s = model.begin[labels[0]] + sum(model.emit[r, y].sum() for r, y in zip(rows, labels))
            return s + sum(model.move[a, b] for a, b in zip(labels, labels[1:]))

        every = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
        assert model.viterbi(rows) == max(every, key=score)


def test_archives_of_hard_pages(spark, tmp_path):
    big = "<p>" + "ü" * 150_000  # several chunks
    pages = [(1, "u v", big), (2, "http://a", big), (3, None, None), (4, "", ""), (5, "x", "y" * 999), (6, "x", "y" * 999), (7, "x", "y" * 1000), (7, "x", "y" * 1000), (8, "x", "y" * 1000), (None, "n", "z" * 2000), (None, "n", "z" * 2000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "record": F.lit("r")})
    chunks = warc.write_records(warc.page_payloads(frame)).cache()
    got = Counter(tuple(r) for r in warc.with_revisits(warc.read_records(chunks)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    row = lambda k, text, other: (k, len((text or "").encode()), hashlib.sha1((text or "").encode()).hexdigest(), "response" if other is None else "revisit", other)
    other = {1: 2, 7: 8}
    assert got == Counter(row(k, text, other.get(k)) for k, _, text in pages)
    assert chunks.groupBy("record").count().agg(F.max("count")).first()[0] > 1
    again = warc.with_revisits(warc.read_records(warc.import_files(spark, exported(chunks, tmp_path)))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r) for r in again.collect()) == got
    assert warc.read_records(warc.write_records(warc.page_payloads(frame.limit(0)))).count() == 0


def exported(chunks, folder):
    warc.export_files(chunks, str(folder / "w"))
    return sorted(str(p) for p in (folder / "w").glob("*.warc"))


def test_leaks_of_items_of_several_blocks(spark, monkeypatch):
    """More passages than go over the documents at once."""
    monkeypatch.setattr(decontaminate, "AT_ONCE", 3)
    rng = random.Random(5)
    item = lambda k, n: " ".join(f"i{k}w{rng.randrange(99)}" for _ in range(n))
    items = {k: item(k, n) for k, n in enumerate((10, 64, 70, 129, 20, 7, 200))}
    prose = lambda n: " ".join(f"p{rng.randrange(500)}" for _ in range(n))
    rows = [(k, f"{prose(50)} {t} {prose(70)}") for k, t in items.items()] + [(100 + k, prose(300)) for k in range(5)] + [(200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([*items.items()], "item_id long, text string")
    latent = decontaminate.fit(docs)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark, latent).collect()} == {(k, k) for k in items}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, benchmark, latent).collect()} == {100, 101, 102, 103, 104, 200}


def test_space_of_passages_is_that_of_the_whole_decomposition(spark):
    """The randomised directions hold the exact leading ones of the same matrix, one a language of the documents;
    those behind them have no gap between their singular values."""
    texts = [r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    latent = decontaminate.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    rows = []
    for t in texts:
        b = decontaminate._buckets(textscan.hash_words(t, "alnum"))
        for i in range(0, len(b), decontaminate.PASSAGE):
            v = np.bincount(b[i : i + decontaminate.PASSAGE], minlength=decontaminate.BUCKETS).astype(float)
            rows.append(v / np.linalg.norm(v))
    a = np.array(rows)
    share = (a > 0).sum(axis=0)
    assert np.allclose(latent.idf, np.log((1 + len(a)) / (1 + share)) + 0.1, atol=1e-4)
    a *= latent.idf
    exact = np.linalg.svd(a, full_matrices=False)[2][:4]
    q = np.linalg.qr(latent.basis.astype(float))[0]
    assert (np.linalg.norm(exact @ q, axis=1) > 0.9).all()


def test_stages_on_hard_rows_and_an_empty_table(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    text = " ".join(f"word{k} and some more." for k in range(80))
    rows = [(1, text, 1), (1, text + " x", 1), (None, text, 1), (None, "another text " * 30, 2), (5, None, 3), (5, "", 3), (6, long_text(1_100_000), 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumn("score", F.lit("s"))
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, folder, name: spark.read.parquet(f"{SMALL}/{name}.parquet"))
    for label, frame in (("rows", docs), ("none", docs.limit(0))):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, "")
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == frame.columns, name
            out.write.parquet(str(tmp_path / f"{label}-{k}"))
            before, frame = frame, spark.read.parquet(str(tmp_path / f"{label}-{k}"))
            assert frame.count() <= before.count()
        assert frame.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_word_places_of_long_texts(spark):
    text = long_text()
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text + " Mit  license")
    got = licenses.scan_licenses(spark.createDataFrame([(1, text + " Mit  license")], "doc_id long, text string")).first()
    assert (got.n_words, got.n_base, got.first_word, got.base_labels) == (len(words), 1, len(words) - 2, "mit")
    assert exact_dedup.exact_dedup(spark.createDataFrame([(1, text), (2, text + " ")], "doc_id long, text string")).where("kept").first().doc_id == 2


def test_texts_of_bytes_that_are_no_characters(spark):
    """Ids that end within a character."""
    path = queries.tokenizer_file("byte_bpe_50k.json")
    ids = bpe.encode(spark.createDataFrame([(1, "é")], "doc_id long, text string"), path).first().ids
    table = bpe.piece_arrays(bpe.pieces(path))
    cut = next(k for k in range(len(table[2])) if table[0][table[1][k] : table[1][k] + table[2][k]].tobytes() == "é".encode()[:1])
    texts = bpe.decoded_texts(np.array([*ids, cut]), np.array([0, len(ids), len(ids) + 1]), table)
    assert texts.to_pylist() == ["é", "�"] and texts.type == pa.string()


def test_common_words_alone_are_no_leak(spark):
    """An item of which half, its answer among it, are words that stand in most texts."""
    rng = random.Random(3)
    common = ["the", "of", "and", "to", "in", "was", "is", "that"]
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.6 else f"p{rng.randrange(3000)}" for _ in range(n))
    item = "the q1 q2 to to the q3 q4 q5 q6 q7 q8 of. Is the was that of."
    rows = [(k, prose(400)) for k in range(200)] + [(1000, f"{prose(100)} {item} {prose(100)}"), (1001, f"{prose(100)} the q1 q2 to q3 q4 of is the was that of {prose(100)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in decontaminate.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1000, 1001}


#: Words of equal length that share the unkeyed hash: pre-tokens by code points, and ASCII words.
CLASHES = [("蹜溣一一", "翅槓剝曃"), ("ygehfugxaaaaaaaa", "pncjjfkyuwonzycb")]


def test_words_that_are_written_to_share_a_hash_stay_apart(spark, library):
    wide = np.frombuffer("".join(CLASHES[0]).encode("utf-32-le"), np.uint8)
    narrow = np.frombuffer("".join(CLASHES[1]).encode(), np.uint8)
    for data in (wide, narrow):
        a, b = textscan.span_hashes(data, np.array([0, 16]), np.array([16, 32]))
        assert a == b  # so the cases below would go wrong by the unkeyed hash alone
        a, b = textscan.span_hashes(data, np.array([0, 16]), np.array([16, 32]), textscan.secret_key())
        assert a != b
    rows = [(k, text) for k, text in enumerate(x for a, b in CLASHES for x in (a, b, f"{a} {b}", f"x {b} {a}"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    big, small = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    got = {r.doc_id: r for r in queries.bpe_digests(frame).collect()}
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame, queries.tokenizer_file("word_bpe_49k.json")).collect()}
    for k, text in rows:
        ids = big.encode(text, add_special_tokens=False).ids
        assert (got[k].ids_sha256, got[k].decoded_sha256) == (sha(",".join(map(str, ids))), sha(text))
        assert counts[k] == len(small.encode(text, add_special_tokens=False).ids)


def test_documents_of_clashing_words_are_no_near_duplicates(spark):
    x, y = CLASHES[1]
    rows = [(1, f"one two three {x} four five"), (2, f"one two three {y} four five"), (3, x), (4, y)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert near_dup.drop_near_duplicates(frame).count() == 4


def test_documents_of_clashing_words_hold_no_benchmark_item(spark):
    one, other = CLASHES[1]
    assert textscan.hash_words(one, "alnum")[0] == textscan.hash_words(other, "alnum")[0]
    docs = spark.createDataFrame([(1, f"{one} " * 12), (2, f"{other} " * 12), (3, f"{one.upper()}, " * 12)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, f"{one} " * 12)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.find_leaks(docs, benchmark).collect()) == [1, 3]
    assert [r.doc_id for r in decontaminate.drop_leaks(docs, benchmark).collect()] == [2]


def test_blocks_tell_words_that_share_a_hash_apart(monkeypatch):
    monkeypatch.setattr(textscan, "span_hashes", lambda data, starts, ends, key=0: np.full(len(starts), 7, np.uint64))
    vocabulary = wordtable.Vocabulary("", True, ())
    texts = ["one two three", "two three four", "four", ""]
    orders = []
    for order in (texts, texts[::-1]):
        block = wordtable.Block(vocabulary)
        block.add(order, True)
        block.close(3)
        orders.append(block.words.to_pylist())
        words = [block.words.to_pylist()[k] for own, places, _ in block.chunks for k in own[places].tolist()]
        assert "".join(words) == "".join(order)
    assert orders[0] == orders[1] and len(orders[0]) == 6


def test_near_duplicates_leave_texts_where_they_are_read(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = []
    cut, near_dup.cut = near_dup.cut, lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1]
    try:
        near_dup.near_duplicates(docs).count()
    finally:
        near_dup.cut = cut
    read = [plan for plan in seen if "text#" in plan]
    assert len(read) == 2  # the signatures, and the sets
    for plan in read:
        lines = [x.lstrip(" +-:*()0123456789") for x in plan.splitlines()]
        moved = [k for k, x in enumerate(lines) if x.startswith("Exchange")]
        scan = next(k for k, x in enumerate(lines) if "text#" in x and x.startswith(("FileScan", "Scan")))
        above = [lines[k] for k in moved if k < scan]
        assert all("text#" not in x for x in above) and all("MapInArrow" in "".join(lines[k:scan]) for k in moved if k < scan)
