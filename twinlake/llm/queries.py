"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    from twinlake.llm import bpe

    path = path or tokenizer_file("byte_bpe_50k.json")
    return bpe.round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query
def op1_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), path)


@query
def op2_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    from twinlake.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), path or tokenizer_file("word_bpe_49k.json"))


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlake.llm import chat

    hard = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    chats = chat.format_chats(rows.unionByName(hard))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    # what the loss mask covers, not what the turns were read as
    cut = lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))
    loss = F.array_join(F.transform("loss_spans", lambda s: chat.unescape(cut(s))), "")
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), turns.alias("turns"), loss.alias("loss"), "formatted").select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlake.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlake.checkpoints import cut, drop_folder, shared_folder
    from twinlake.llm import warc

    folder = shared_folder(spark, "warc")
    warc.write_records(warc.page_payloads(table(spark, sf_dir, "pages"))).write.option("compression", "zstd").parquet(folder)
    records = cut(warc.read_records(spark.read.parquet(folder)))
    drop_folder(spark, folder)
    return warc.with_revisits(records)


def _oracles() -> None:
    from twinlake.llm import chat, exact_dedup, hard_negatives, licenses, near_dup, url_filter, vector_codes, warc

    ORACLES["op4_chat_format"] = chat.ORACLE
    ORACLES["op6_minhash"] = near_dup.ORACLE
    ORACLES["op7_exact_dedup"] = exact_dedup.ORACLE
    ORACLES["op9_licenses"] = licenses.oracle()
    ORACLES["op10_warc"] = warc.ORACLE
    ORACLES["op11_url_filter"] = url_filter.ORACLE
    ORACLES["op12_hard_negatives"] = hard_negatives.ORACLE
    ORACLES["op13_vector_codes"] = vector_codes.oracle()


_oracles()


@query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlake.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlake.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlake.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlake.llm import html_extract

    return html_extract.extract(table(spark, sf_dir, "pages"), html_extract.default_model())


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlake.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlake.llm import url_filter

    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, spark.createDataFrame(url_filter.QUERY_RULES, url_filter.RULES), url_filter.junk_list(pages))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlake.llm import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlake.llm import vector_codes

    return vector_codes.encode(table(spark, sf_dir, "embeddings"))
