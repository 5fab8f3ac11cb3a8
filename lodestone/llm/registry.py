"""The queries op1_ to op13_ and the SQL of those that SQL can express."""

from __future__ import annotations

from lodestone.llm import codebooks, decontamination, lexical, matroska, minhash, mixing, personal, quality, secrets, sharding, substrings, toxicity, urlrules
from lodestone.llm.tables import read


def op1_quality(spark, sf_dir):
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(read(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_sharding(spark, sf_dir):
    return sharding.interleave(read(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_secret_scan(spark, sf_dir):
    return secrets.report(read(spark, sf_dir, "documents"))


def op7_media_columns(spark, sf_dir):
    return matroska.digests(read(spark, sf_dir, "documents"))


def op8_minhash(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_source_mixing(spark, sf_dir):
    return mixing.sequence(read(spark, sf_dir, "documents"))


def op10_url_filter(spark, sf_dir):
    return urlrules.judge(read(spark, sf_dir, "pages"), urlrules.RULES)


def op11_personal_data(spark, sf_dir):
    return personal.report(read(spark, sf_dir, "documents"))


def op12_vector_codes(spark, sf_dir):
    return codebooks.report(read(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark, sf_dir):
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict:
    return {"op4_sharding": sharding.ORACLE_SQL, "op6_secret_scan": secrets.ORACLE_SQL, "op9_source_mixing": mixing.ORACLE_SQL, "op10_url_filter": urlrules.oracle_sql(urlrules.RULES), "op12_vector_codes": codebooks.ORACLE_SQL, "op13_ranked_search": lexical.ORACLE_SQL}
