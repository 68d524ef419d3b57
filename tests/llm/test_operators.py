"""Operators against the tokenizer libraries, brute force, SQL and round trips, and on difficult rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from twinlake.llm import bpe, chat, decontaminate, exact_dedup, html_extract, licenses, near_dup, quality, queries, token_counts

SMALL = f"{DATA}/sf0.001"
HARD = [
    None, "", " ", "\n\n", "a", "Hello  world's  it'll 123 ４５ é é ñandú", "<|endoftext|>x<|endoftext|>", "​﻿ 𝒳 👩‍👩‍👧 ﬁ",
    "tab\tand\r\nline \x0b\x0c end ", "x" * 30_000, "the quick brown fox jumps over the lazy dog " * 400, "MIT License and the Apache license", "same", "same", "'s 're '", " 'll", "İstanbul ǅ ẞ",
]


@pytest.fixture(scope="module")
def hard(spark):
    """Difficult texts, with a null id and columns whose names clash with those of results."""
    rows = [(k if k else None, t, "x", 1.5, "y", True) for k, t in enumerate(HARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, score double, component_id string, kept boolean")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_is_that_of_the_library(spark, hard):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    got = {r.doc_id: r for r in queries.bpe_digests(hard, path).collect()}
    for k, text in enumerate(HARD):
        ids = t.encode(text or "", add_special_tokens=False).ids
        r = got[k or None]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids)))), text
        assert r.decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False))
    assert queries.bpe_digests(hard.limit(0), path).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path).first().text == ""


def test_token_counts_are_those_of_the_library(hard):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    got = {r.doc_id: r for r in token_counts.count_tokens(hard, path).collect()}
    for k, text in enumerate(HARD):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        r = got[k or None]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 2048), text
    assert token_counts.count_tokens(hard.limit(0), path).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, duck, same, name):
    same(queries.QUERIES[name](spark, SMALL), duck.execute(queries.ORACLES[name]))


def test_chat_round_trip_and_nulls(spark):
    rng = random.Random(3)
    parts = ["<|im_start|>", "<|im_end|>", "\\", "\n", "user", "<|im_", "start|>", "</s>[INST]", "<|im_\\start|>", "é", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem", "<|im_end|>", "a\\nb"]), "".join(rng.choice(parts) for _ in range(rng.randrange(9)))) for c in range(40) for t in range(5)]
    rows += [(99, None, None, None), (None, 1, "assistant", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = {r.conv_id: r for r in chat.format_chats(frame).collect()}
    for c in range(40):
        assert [(t.role, t.text) for t in out[c].turns] == [(r, x) for k, _, r, x in rows if k == c]
    assert [(t.role, t.text) for t in out[99].turns] == [("", "")] and len(out) == 42
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_loss_of_chats_is_what_the_mask_covers(spark, monkeypatch):
    right = {r.conv_id: r.loss_sha256 for r in queries.op4_chat_format(spark, SMALL).collect()}
    assert right[-7] == sha("</s>[INST] ok [/INST]")
    put = chat.format_chats
    moved = F.transform("loss_spans", lambda s: F.struct((s["start"] - 1).alias("start"), s["length"].alias("length")))
    monkeypatch.setattr(chat, "format_chats", lambda rows: put(rows).withColumn("loss_spans", moved))
    wrong = {r.conv_id: r.loss_sha256 for r in queries.op4_chat_format(spark, SMALL).collect()}
    assert all(wrong[k] != v for k, v in right.items() if v != sha(""))


def test_exact_dedup_on_hard_rows(hard):
    got = exact_dedup.exact_dedup(hard).collect()
    assert len(got) == len(HARD)
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for r in got:
        alike = [k for k, t in enumerate(HARD) if bare(t) == bare(HARD[r.doc_id or 0])]
        best = min(alike, key=lambda k: (-len(HARD[k] or ""), k == 0, k))
        assert (r.keep_id or 0, r.group_size, r.kept) == (best, len(alike), best == (r.doc_id or 0))
    assert exact_dedup.exact_dedup(hard.limit(0)).count() == 0
    kept = exact_dedup.drop_duplicates(hard)
    assert kept.columns == hard.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute_components(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    items = sorted(sets)
    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 85 * max(len(x), len(y)) and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_near_duplicates_match_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    texts, k = {}, 0
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts[k], k = " ".join(copy), k + 1
    texts |= {k: None, k + 1: " ", k + 2: "A b", k + 3: "a  B"}
    frame = spark.createDataFrame([(a, b, 0) for a, b in texts.items()], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame).collect()}
    assert got == brute_components(texts)
    assert near_dup.near_duplicates(frame.limit(0)).count() == 0


def test_near_duplicates_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_minhash(spark, SMALL).collect()}
    assert got == brute_components({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})


def test_rows_that_share_an_id_go_by_their_texts(spark):
    """A repeated and a null id, each with a text of its own and a copy of document 3."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(3, text(3) + " "), (7, text(7)), (7, text(3)), (None, text(8)), (None, text(3)), (9, None), (9, text(9))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = exact_dedup.drop_duplicates(frame)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([rows[0], rows[1], rows[3], rows[5], rows[6]])
    near = text(3).replace("3w59", "other")
    rows = [(3, text(3)), (7, text(7)), (7, near), (7, near), (None, text(8)), (None, near), (9, None), (9, text(9))]
    kept = near_dup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([rows[0], rows[1], *rows[4:]])


def test_licenses_base_places(hard):
    got = {r.doc_id: r for r in licenses.scan_licenses(hard).collect()}
    assert len(got) == len(HARD)
    for k, text in enumerate(HARD):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
        places, labels = [], set()
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            p = phrase.split()
            found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        r = got[k or None]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan_licenses(hard.limit(0)).count() == 0


NOTICES = {
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n \n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.",
}


def test_licenses_are_those_of_all_runs_of_paragraphs(spark):
    rng = random.Random(9)
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    prose = lambda n: " ".join(rng.choice(["the", "of", "license", "copy", "conditions", "and", "to", "word", "notice", "any"]) for _ in range(n))
    texts = [f"{prose(30)}\n\nCopyright 2020 A. Name\n\n{t}\n\n\n{prose(30)}" for t in NOTICES.values()]
    for _ in range(300):
        whole = (rng.choice(licenses.TEMPLATES)[1] if rng.random() < 0.7 else prose(60)).split()
        kept = [w for w in whole if rng.random() < rng.choice([0.8, 0.9, 1.0])] + prose(rng.randrange(20)).split()
        for _ in range(rng.randrange(6)):
            kept.insert(rng.randrange(len(kept) + 1), rng.choice(["\n\n", "\n \t\n", "\n\n\n", f"\n\n{prose(rng.choice([5, 90]))}\n\n"]))
        texts.append(" ".join(kept))
    texts += [None, "", "\n\n", "\n\n a \n\n"]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        blocks = [x for x in map(words, re.split(r"\n[ \t]*(?=\n)", text or "")) if x]
        labels, best = set(got[k].base_labels.split(",")) - {""}, float(got[k].n_base > 0)
        for label, template in licenses.TEMPLATES:
            own = set(words(template))
            for i in range(len(blocks)):
                for j in range(i, len(blocks)):
                    share = len(own & set().union(*blocks[i : j + 1])) / len(own)
                    if sum(map(len, blocks[i + 1 : j])) <= len(words(template)) and share >= 0.8:
                        labels, best = labels | {label}, max(best, share)
        assert (got[k].labels, round(got[k].score, 9)) == (",".join(sorted(labels)), round(best, 9)), text
    assert [label in got[k].labels.split(",") for k, label in enumerate(NOTICES)] == [True] * 3


def test_quality_on_held_out_labels(spark):
    folder = f"{DATA}/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.op8_quality(spark, folder).collect() if r.held_out and labels.get(r.doc_id) in (0, 1)]
    right = [(labels[r.doc_id], r.predicted == labels[r.doc_id]) for r in rows]
    assert np.mean([x for _, x in right]) >= 0.95
    assert np.mean([x for y, x in right if y == 0]) >= 0.7 and sum(y == 0 for y, _ in right) >= 5
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_without_labels_and_on_hard_rows(spark, hard):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(hard, empty)
    assert {r.score for r in quality.score_quality(hard, model).collect()} == {0.5}
    assert quality.keep_good(hard, model).count() == len(HARD)
    model = quality.train(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"), spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"))
    assert quality.score_quality(hard, model).count() == len(HARD)
    assert quality.score_quality(hard.limit(0), model).count() == 0


def test_html_on_a_page_and_hard_rows(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=1>Home</a></li><li><a href=2>About</a></li></ul></nav><article><h1>A headline of this page</h1>"
        "<p>The first paragraph &amp; its <b>bold</b>   words, long enough to be prose.</p><script>var x='</p>';</script><p>A second paragraph&nbsp;follows, with more sentences. It ends here.</p></article>"
        "<footer><p>Copyright notice</p></footer></body></html>"
    )
    rows = [(1, "u", page, 0), (2, None, None, 0), (None, "u", "", 0), (4, "u", "<p" * 5000, 0), (5, "u", "<div>" * 3000 + "x", 0), (1, "u", page, 0)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = html_extract.extract(frame, html_extract.default_model()).collect()
    assert len(got) == 6
    texts = [r.text for r in got if r.page_id == 1]
    assert texts == ["A headline of this page\nThe first paragraph & its bold words, long enough to be prose.\nA second paragraph follows, with more sentences. It ends here."] * 2
    assert all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id in (2, None)] == ["", ""]


def test_html_after_elements_that_close_themselves(spark):
    article = "<h1>A headline of this page</h1><p>The first paragraph, long enough to be{} prose.</p><p>A second paragraph follows, with more sentences. It ends here.</p>"
    icons = ["", "<svg/>", '<svg class="icon" />', "<math/>", "<SVG viewBox='0 0 1 1'/>", "<svg><path/>x</svg>", '<svg/><svg><g>x</g></svg><math />']
    pages = [f"<html><body><nav><a href=1>{icon}Home</a></nav><article>{icon}{article.format(icon)}</article></body></html>" for icon in icons]
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("u"))
    got = {r.page_id: r.text for r in html_extract.extract(frame, html_extract.default_model()).collect()}
    assert "The first paragraph, long enough to be prose.\nA second paragraph follows" in got[0] and set(got.values()) == {got[0]}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_length_is_that_of_the_table():
    rng = random.Random(2)
    for _ in range(50):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(1, 64))], [rng.randrange(6) for _ in range(80)]
        masks = np.array([[sum(1 << i for i, x in enumerate(a) if x == y) for y in b]], np.uint64)
        assert decontaminate.common_length(masks)[0] == lcs(a, b)


def test_windows_are_those_of_all_spans(monkeypatch):
    """Without a cosine, every window of every row against every passage, in groups of a few passages."""
    rng = np.random.default_rng(6)
    sizes = np.array([3, 9, 20, 33, 50, 64, 5, 40, 12, 30])
    words = rng.integers(1, 2**63, 40).astype(np.uint64)
    passages = [words[rng.integers(0, 40, n)] for n in sizes]
    rows = [words[rng.integers(0, 40, n)] for n in (0, 1, 15, 16, 17, 90, 200)]
    rows += [np.concatenate([rows[5], p[: max(1, len(p) * 9 // 10)], rows[4]]) for p in passages]
    answer = np.concatenate([np.arange(n) >= n * 3 // 4 for n in sizes])
    block = decontaminate.Passages(list(range(len(sizes))), np.concatenate(passages), np.append(0, np.cumsum(sizes)), answer)
    latent = decontaminate.Latent(rng.uniform(0.11, 3, decontaminate.BUCKETS).astype(np.float32), rng.normal(size=(decontaminate.BUCKETS, 8)).astype(np.float32))
    want = set()
    for r, row in enumerate(rows):
        cells = range(0, len(row), decontaminate.BLOCK)
        for p, passage in enumerate(passages):
            n, m = len(passage), -(-(len(passage) + decontaminate.BLOCK - 1) // decontaminate.BLOCK)
            need, part = (n, n) if n < decontaminate.SHORT else (-(-3 * n // 4), -(-n // 2))
            tail = passage[n * 3 // 4 :].tolist()
            for c in cells:
                span = row[max(0, c - decontaminate.BLOCK) : c + (m + 1) * decontaminate.BLOCK].tolist()
                length = lcs(passage.tolist(), span)
                idf = [float(latent.idf[b]) for b in decontaminate._buckets(passage)]
                held = sum(x for x, w in zip(idf, passage.tolist()) if w in span)
                if length >= need or length >= part and lcs(tail, span) >= 0.75 * len(tail) and held >= decontaminate.WEIGHT * sum(idf):
                    want.add((r, p, length))
    monkeypatch.setattr(decontaminate, "GROUP", 3)
    got = decontaminate.Matcher(latent, block, -2.0).find(np.concatenate(rows), np.append(0, np.cumsum([len(x) for x in rows])))
    assert set(zip(*(x.tolist() for x in got[:3]))) == want and want


def test_planted_leaks_are_found_and_clean_documents_left(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.01/benchmark.parquet").collect()}
    rng, rows, want = random.Random(4), [], set()
    # texts without any item, so what is planted is all there is
    clean = [t for t in (r.text or "" for r in docs) if not any(x in t for x in items.values())]
    for k, (item, text) in enumerate(items.items()):
        words = clean[k % len(clean)].split()
        own = re.sub("[a-z]", lambda m: m[0].upper(), text).split()  # words fold A-Z only
        for _ in range(len(own) // 10):
            if k % 2:
                del own[rng.randrange(len(own))]
            else:
                own[rng.randrange(len(own))] = "other"
        at = rng.randrange(len(words) + 1)
        rows.append((1000 + k, " ".join(words[:at] + own + words[at:]), 7))
        want.add((1000 + k, item))
    rows += [(k, t, 7) for k, t in enumerate(clean)] + [(9000, None, 7), (9001, "", 7), (None, "x " * 50_000, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame([*items.items(), (None, None), (-1, "")], "item_id long, text string")
    latent = decontaminate.fit(frame)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, benchmark, latent).collect()}
    every = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, benchmark, latent, cosine=-2.0).collect()}
    assert got <= every and len(got) >= 0.97 * len(every)
    assert {d for d, _ in got} <= {d for d, _ in want} and len(got & want) >= 0.97 * len(want)
    kept = decontaminate.drop_leaks(frame, benchmark, latent)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {d for d, *_ in rows} - {d for d, _ in got}
    assert decontaminate.find_leaks(frame.limit(0), benchmark).count() == 0
    assert decontaminate.find_leaks(frame, benchmark.limit(0), latent).count() == 0


def test_leaks_in_repeated_words_and_reworded_leaks_are_all_found(spark):
    """Whole items amid runs of repeated words, and items of which half of the words and the answer are left."""
    rng = random.Random(8)
    texts = [r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.01/benchmark.parquet").collect()}
    benchmark = spark.createDataFrame([*items.items()], "item_id long, text string")
    (block,) = decontaminate.benchmark_passages(benchmark)
    long = [t.split() for t in texts if len(t.split()) > 150 and not any(x in t for x in items.values())]
    rows, kinds = [], {"repeated": set(), "reworded": set()}
    for k, item in enumerate(block.items):
        words = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", items[item])
        answer = block.answer[block.at[k] : block.at[k + 1]]
        assert len(words) == len(answer)
        few = [w for w in rng.sample(long[k % len(long)], 4) for _ in range(40)]
        rows.append((k, " ".join(few[:90] + words + few[90:])))
        kinds["repeated"].add((k, item))
        other, gone = long[(k + 1) % len(long)], np.flatnonzero(~answer).tolist()
        for i in rng.sample(gone, min(len(gone), len(words) // 2)):
            words[i] = rng.choice(other)
        rows.append((1000 + k, " ".join(other[:60] + words + other[60:120])))
        kinds["reworded"].add((1000 + k, item))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    latent = decontaminate.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, benchmark, latent).collect()}
    assert {k: len(x & got) for k, x in kinds.items()} == {k: len(x) for k, x in kinds.items()}
    assert decontaminate.drop_leaks(frame, benchmark, latent).count() == 0


def test_items_over_a_passage_leave_no_short_passage(spark):
    """The last words of long items stand in many clean documents; whole items, or their last 64 words, are leaks."""
    clean = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if r.text]
    common = [w for w, _ in Counter(w for _, t in clean for w in re.findall("[a-z]+", t)).most_common(3)]
    items = {n: [f"w{n}x{k}" for k in range(n - n % 64)] + common[: n % 64] for n in (64, 65, 66, 130)}
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    (block,) = decontaminate.benchmark_passages(benchmark)
    sizes = sorted(zip(block.items, np.diff(block.at).tolist()))
    assert sizes == [(64, 64), (65, 64), (65, 64), (66, 64), (66, 64), (130, 64), (130, 64), (130, 64)]
    rows = clean + [(-n, f"{clean[n][1]} {' '.join(w)}") for n, w in items.items()] + [(-1000 - n, " ".join(w[-64:])) for n, w in items.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    latent = decontaminate.fit(frame)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, benchmark, latent).collect()}
    assert got == {(-n, n) for n in items} | {(-1000 - n, n) for n in items}
    assert {r.doc_id for r in decontaminate.drop_leaks(frame, benchmark, latent).collect()} == {k for k, _ in clean}


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{SMALL}/labels.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    scored = quality.score_quality(docs, quality.train(docs, labels)).collect()
    left = {r.doc_id: texts[r.doc_id] for r in scored if r.predicted}
    first = {}
    for k in sorted(left, key=lambda k: (-len(left[k] or ""), k)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]", "", left[k] or ""), k)
    left = {k: left[k] for k in first.values()}
    left = {k: left[k] for k, (_, c) in brute_components(left).items() if k == c}
    stage = docs.where(F.col("doc_id").isin(list(left)))
    leaks = {r.doc_id for r in decontaminate.find_leaks(stage, benchmark, cosine=-2.0).collect()}
    got = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in got.collect()} == set(left) - leaks
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
