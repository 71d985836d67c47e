"""The opN queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import html_extraction, language_id, lexical_search, media, mixing, near_dedup, oracles, packing, phrases, quality, sharding, token_counts, url_filters, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``rows``."""
    return sharding.shard(_table(spark, sf_dir, "documents"), 8)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the environment keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary())


#: (verdict, host, path) of the filter list.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


#: Parts of a host's name, between dots and hyphens, that label its urls as to be blocked.
JUNK_TERMS = ("ad", "ads", "adult", "bet", "bets", "casino", "click", "lotto", "pills", "poker", "porn", "popup", "scam", "spam", "track", "tracker", "viagra", "warez", "xxx")


def labelled_urls(pages: DataFrame) -> DataFrame:
    """(url, blocked) of every url that has a host: blocked if a part of the host's name is one of JUNK_TERMS.

    These are the labels that the trees learn from. What they judge by is lexical (lengths, shares, entropy, suffix statistics), not the terms.
    """
    host = url_filters.host_of("url")
    junk = host.rlike(r"(^|[.-])(" + "|".join(JUNK_TERMS) + r")([.-]|$)")
    return pages.select("url", host.alias("host"), junk.cast("int").alias("blocked")).filter("host <> ''").select("url", "blocked")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, and boosted trees where no rule fits, on every page's url. The trees learn from urls that no rule decides."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    rule, _ = url_filters.rule_for(url_filters.host_of("url"), url_filters.path_of("url"), RULES)
    model = url_filters.fit(labelled_urls(pages.filter(rule.isNull())))
    return url_filters.judge(pages, RULES, model)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at a similarity of 0.85."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(language_id.learnable(docs))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150 % of all words takes of each document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "source")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the log-likelihood ratio's verdict on every document."""
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr_score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an image and read back."""
    return media.round_trip(_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical_search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extraction.extract(_table(spark, sf_dir, "pages"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language."""
    return phrases.mine(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_token_counts": op2_token_counts,
    "op3_url_filters": op3_url_filters,
    "op4_near_dedup": op4_near_dedup,
    "op5_language_id": op5_language_id,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_media_columns": op10_media_columns,
    "op11_lexical_search": op11_lexical_search,
    "op12_html_extraction": op12_html_extraction,
    "op13_phrases": op13_phrases,
}

ORACLES: dict[str, str] = {"op1_sharding": oracles.OP1, "op4_near_dedup": oracles.OP4, "op6_warc": oracles.OP6, "op11_lexical_search": oracles.OP11, "op13_phrases": oracles.OP13}
