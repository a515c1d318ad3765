"""The thin queries over the driver's tables, one for each operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskengine.session import shared_path


def tokenizer_path() -> str:
    """The installed byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(column: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == part, F.lit(False))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(_table(spark, sf_dir, "documents"))


def packed_pieces(docs: DataFrame) -> DataFrame:
    """Pieces of all documents with their place in packed sequences and a digest of their ids."""
    from riskengine.llm import packing

    pieces = packing.tokenize_pieces(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, packing.estimate_pieces(docs))


def op2_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskengine.llm import media_audio

    return media_audio.digest_media(media_audio.store_texts(_table(spark, sf_dir, "documents")))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskengine.llm import lm_kneser_ney as lm

    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 5, 1))
    model = lm.train(docs.filter("NOT held_out"))
    found = lm.score(docs.select("text", F.struct("doc_id", "held_out").alias("key")), model, "key")
    return found.select("key.doc_id", "key.held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


#: The url rules of op4.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models learn from the urls that a rule decides."""
    from riskengine.llm import url_filter

    ruled = url_filter.apply_rules(_table(spark, sf_dir, "pages"), [url_filter.Rule(*r) for r in RULES])
    return url_filter.judge(ruled, url_filter.train(ruled)).select("page_id", "host", "path", "rule", "verdict", "url_score")


def language_model(docs: DataFrame):
    """Fitted on documents with a language whose crc32 of the id does not leave 1 when divided by 3."""
    from riskengine.llm import langid_crf

    return langid_crf.train(docs.filter(~held_out("doc_id", 3, 1)))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskengine.llm import langid_crf

    docs = _table(spark, sf_dir, "documents")
    found = langid_crf.predict(docs, language_model(docs))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskengine.llm import simhash_anchor

    found = simhash_anchor.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def toxicity_model(docs: DataFrame, labels: DataFrame):
    """Fitted on labelled documents whose crc32 of the id is not divisible by 5."""
    from riskengine.llm import toxicity_ftrl

    return toxicity_ftrl.train(docs, labels.filter(~held_out("doc_id", 5, 0)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskengine.llm import toxicity_ftrl

    docs = _table(spark, sf_dir, "documents")
    found = toxicity_ftrl.score(docs, toxicity_model(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("toxicity").alias("score"), toxicity_ftrl.is_toxic().cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskengine.llm import decontamination

    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskengine.llm import license_scan

    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with a stale last reply; masks as ``start-end`` texts."""
    from riskengine.llm import preference_format as pf

    found = pf.format_preferences(pf.stale_reply_pairs(pf.conversation_turns(_table(spark, sf_dir, "conversations"))))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias(c)
    return found.select("conv_id", "prompt_turns", "prompt", "chosen", "rejected", said("chosen_mask"), said("rejected_mask"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive is written to the shared folder and read back from there."""
    from riskengine.llm import warc

    archive = warc.archive_pages(_table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return warc.read_back(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskengine.llm import prefix_trie as trie

    nodes = trie.build(trie.share_openings(trie.numbered_turns(_table(spark, sf_dir, "conversations"))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskengine.llm import whitening

    rows = _table(spark, sf_dir, "embeddings")
    return whitening.transform(rows, whitening.fit(rows))


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_media_audio, op3_lm_score, op4_url_filter, op5_language_id, op6_simhash, op7_toxicity, op8_decontamination, op9_license_scan, op10_preference_format, op11_warc, op12_prefix_trie, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    from riskengine.llm import license_scan, preference_format, prefix_trie, warc

    return {"op9_license_scan": license_scan.oracle(), "op10_preference_format": preference_format.ORACLE, "op11_warc": warc.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE}
