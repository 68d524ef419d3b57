"""Pages written by hand, word weights, sorted runs and long texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from twinlake.llm import chat, decontaminate, exact_dedup, html_extract, quality

PROSE = "The ferry left the harbour before dawn, and by noon the islands were far behind us, low and blue on the horizon."
MORE = "Nobody on deck spoke much; the wind had turned in the night, and the captain watched the glass with growing doubt."


def text_of(spark, page):
    return html_extract.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), html_extract.default_model()).first().text


def test_names_that_the_generator_does_not_list(spark):
    adverts = ["div class='dfp-slot'", "div class=gpt-ad-unit", "aside id=sponsored_box", "div class=taboola-wrap"]
    for opening in adverts:
        tag = opening.split()[0]
        page = f"<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>The ferry</h1><p>{PROSE}</p><{opening}>Buy two lamps for the price of one today</{tag}><p>{MORE}</p></article><footer>&copy; All rights</footer></body></html>"
        assert text_of(spark, page) == f"The ferry\n{PROSE}\n{MORE}", opening
    for outer, inner in (("div class=replies", "div class=reply"), ("section id=discussion", "div class=response-item")):
        tags = outer.split()[0], inner.split()[0]
        page = f"<html><body><article><h1>The ferry</h1><p>{PROSE}</p><p>{MORE}</p></article><{outer}><h2>Replies</h2><{inner}><p>I took that boat once, never again.</p></{tags[1]}><{inner}><p>Lovely story, thanks.</p></{tags[1]}></{tags[0]}><footer>Contact</footer></body></html>"
        assert text_of(spark, page) == f"The ferry\n{PROSE}\n{MORE}", outer


def test_elements_within_their_like_that_are_no_text(spark):
    page = f"<body><article><p>{PROSE}<svg><g><svg width='1>2'><text>inner</text></svg><text>outer</text></g></svg></p><svg/><template><template>a</template>b</template><p>{MORE}</p><math><mi>x</mi></math></article></body>"
    assert text_of(spark, page) == f"{PROSE}\n{MORE}"
    assert [x.text for x in html_extract.leaf_blocks("<p>a<svg><svg>b</svg>c")] == ["a"]  # not closed: to the end


def test_a_page_of_over_a_megabyte(spark):
    page = "<html><body><article><h1>Long</h1>" + f"<p>{PROSE}</p>\n<p>{MORE}</p>" * 5000 + "</article><footer>end</footer></body></html>"
    got = text_of(spark, page)
    assert len(page) > 1_000_000 and got == "Long" + f"\n{PROSE}\n{MORE}" * 5000


def test_weights_are_those_of_the_latent_space(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    assert np.allclose(decontaminate.weights(docs).idf, decontaminate.fit(docs).idf)
    none = decontaminate.weights(docs.limit(0))
    assert np.allclose(none.idf, decontaminate.fit(docs.limit(0)).idf) and none.basis is None


def test_the_latent_space_decides_on_leaks_that_are_not_whole(spark, monkeypatch):
    item = " ".join(f"word{k}" for k in range(40))
    partly = " ".join(f"word{k}" if k % 8 else "other" for k in range(40))
    rows = [(1, item), (2, partly), (3, PROSE), (4, MORE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = lambda **how: sorted(r.doc_id for r in decontaminate.drop_leaks(docs, benchmark, **how).collect())
    assert kept() == [3, 4] == sorted({1, 2, 3, 4} - {r.doc_id for r in decontaminate.find_leaks(docs, benchmark).collect()})
    real = decontaminate.fit(docs)
    # a latent space in which the words that the second document lacks stand for all the others' opposite
    lacks = np.unique(decontaminate._buckets(decontaminate.textscan.hash_words(" ".join(f"word{k}" for k in range(0, 40, 8)), "alnum")))
    basis = np.zeros_like(real.basis)
    basis[:, 0], basis[lacks, 0] = -1, 100
    assert kept(latent=decontaminate.Latent(real.idf, basis)) == [2, 3, 4]
    assert kept(latent=decontaminate.Latent(real.idf, None)) == [3, 4]


def test_merges_keep_runs_sorted_by_range(spark):
    rows = spark.range(3000, numPartitions=9).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 700).cast("string")).alias("text"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(rows).collect()}
    sizes = {k: len(range(k, 3000, 700)) for k in range(700)}
    assert got == {k: (k % 700 if len(str(k)) else 0, sizes[k % 700]) for k in range(3000)}
    entries = rows.select(F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(1).alias("n_bytes"), F.lit(1).cast("long").alias("check"), "doc_id")
    runs = exact_dedup.merge(exact_dedup.first_runs(entries, F.struct(F.col("doc_id").alias("keep_id"))), 3)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    lines = [x.lstrip(" +-:*()0123456789") for x in plan.splitlines()]
    top = [x.split("(")[0].split(" ")[0] for x in lines if x.startswith(("SortAggregate", "HashAggregate", "Sort ", "Exchange", "AQEShuffleRead"))]
    assert top[0] == "SortAggregate" and "HashAggregate" not in top  # merges walk sorted rows
    assert runs.groupBy("run", "digest").count().where("count > 1").count() == 0


def test_all_passages_of_a_long_text_teach_and_count(spark):
    bad = "!!! $$$ ### BUY NOW ||| " * 200
    good = (PROSE + " ") * 200
    docs = spark.createDataFrame([(k, (good if k % 2 else bad)) for k in range(1, 60)] + [(100, good * 12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)] + [(100, 1)], "doc_id long, quality int")
    scored = {r.doc_id: r.score for r in quality.score_quality(docs, quality.train(docs, labels)).collect()}
    assert scored[100] >= 0.3 > max(scored[k] for k in range(2, 60, 2))
    assert len(quality.passages(np.frombuffer((good * 12).encode(), np.uint8), np.array([0, len(good) * 12]))[0]) > 512


def test_long_turns_are_formatted_whole(spark):
    text = "</s>[INST] " * 100_000
    rows = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(rows).first()
    assert [t.text for t in r.turns] == [text, text]


@pytest.mark.parametrize("texts", [["word"], ["two words", "one"], ["", "one", " "], ["one", "one", "one one one"], ["a b a b", "a"]])
def test_a_text_of_one_word_may_end_a_piece(spark, texts):
    """A text has the passages that it has alone, wherever it stands in a piece."""

    def described(*some):
        coded = [t.encode() for t in some]
        return quality.passages(np.frombuffer(b"".join(coded), np.uint8), np.append(0, np.cumsum([len(b) for b in coded])))

    x, bounds = described(*texts)
    for k, text in enumerate(texts):
        np.testing.assert_allclose(x[bounds[k] : bounds[k + 1]], described(text, "some more words")[0][:-1], atol=1e-12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    model = quality.train(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int"))
    assert quality.score_quality(docs, model).count() == len(texts)
    assert quality.keep_good(docs, model).count() <= len(texts)
