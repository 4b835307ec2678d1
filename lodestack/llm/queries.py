"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, langid, license_scan, lm, ngram_join, packing, quality, warc
from .common import in_thirds, materialise, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", exact_dedup.text_key(F.col("text")).alias("text_sha256"))
    keys = materialise(docs, "keys")
    marked = exact_dedup.mark_repeats(keys, "text_sha256", "doc_id")
    return marked.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = bpe.encode_digests(public_tokenizers.path("byte_bpe_50k.json"))
    return table(spark, sf_dir, "documents").select("doc_id", digests(F.col("text")).alias("d")).select("doc_id", "d.*")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialise(warc.write_archives(table(spark, sf_dir, "pages")), "archives")
    return warc.read_archives(archives).drop("url")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, F.col("vec_id") % 20 == 0)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    split = in_thirds("doc_id", 3)
    prototypes = langid.fit(docs.where(split != 1))
    return langid.with_language(docs, prototypes).select("doc_id", F.coalesce(split == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.concat_ws(",", "sentence_ids").alias("sentence_ids"), "n_sentences", F.concat_ws(",", "licences").alias("licences"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    split = in_thirds("doc_id", 4)
    labels = table(spark, sf_dir, "labels").where(split != 2).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(quality.sample_labelled(docs, labels))
    return quality.with_quality(docs, model).select("doc_id", F.coalesce(split == 2, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_best_fit_packing, op3_bpe, op4_warc, op5_ngram_jaccard_join, op6_nearest_neighbours, op7_lm_scoring, op8_language_id, op9_license_scan, op10_quality)
}


def _licence_sql() -> str:
    """Sentences and rules as values; a rule fires where its identifiers stand in a row and no earlier rule or match covers the place."""
    known = ", ".join(f"('{k}', '{v}')" for k, v in license_scan.SENTENCES.items())
    rules = ", ".join(f"({i}, '{' '.join(seq)} ', {len(seq)}, '{name}')" for i, (seq, name) in enumerate(license_scan.RULES))
    return rf"""
    with recursive known(s, id) as (values {known}), rules(rank, seq, len, name) as (values {rules}),
    texts as (select doc_id, lower(coalesce(text, '')) as t from documents),
    parts as (select doc_id, unnest(p) as s, generate_subscripts(p, 1) as i from (select doc_id, string_split_regex(regexp_replace(t, '\.[ \t\n\x0B\f\r]+', E'.\n', 'g'), '[\r\n]+') as p from texts where regexp_matches(t, 'licens|permi|warrant|rights reserved|redistribut|in the hope'))),
    clean as (select doc_id, i, trim(regexp_replace(regexp_replace(regexp_replace(s, '\.([^0-9]|$)', ' \1', 'g'), '[^a-z0-9.]+', ' ', 'g'), ' +', ' ', 'g')) as s from parts),
    ids as (select doc_id, list(id order by i) as ids from clean join known using (s) group by doc_id),
    walk(doc_id, ids, place, found) as (
      select doc_id, ids, 1, []::varchar[] from ids
      union all
      select w.doc_id, w.ids, w.place + coalesce(r.len, 1), case when r.name is null or list_contains(w.found, r.name) then w.found else list_append(w.found, r.name) end
      from walk w left join lateral (select len, name from rules where starts_with(array_to_string(w.ids[w.place:], ' ') || ' ', seq) order by rank limit 1) r on true where w.place <= len(w.ids)),
    done as (select doc_id, ids, found from walk where place > len(ids))
    select d.doc_id, coalesce(array_to_string(ids, ','), '') as sentence_ids, coalesce(len(ids), 0)::bigint as n_sentences, coalesce(array_to_string(found, ','), '') as licences
    from documents d left join done using (doc_id)"""


ORACLE_SQL = {
    "op1_exact_dedup": r"""
    with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
    select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256 from t window w as (partition by text_sha256)""",
    "op4_warc": """
    with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, ''))::bigint as payload_bytes from pages),
    k as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by h) else page_id end as keep from p)
    select page_id, payload_bytes, sha1(h) as payload_digest, case when page_id = keep then 'response' else 'revisit' end as record_type, case when page_id <> keep then keep end as refers_to from k""",
    "op6_nearest_neighbours": """
    with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and list_count(embedding) = len(embedding)),
    ok as (select * from v where len(list_filter(e, x -> not isfinite(x))) = 0 and len(list_filter(e, x -> x <> 0)) > 0)
    select 0 as never where false""",
    "op9_license_scan": _licence_sql(),
}
del ORACLE_SQL["op6_nearest_neighbours"]  # approximate: tested for recall
