"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from heritas.llm.common import held_out, stored, table


def op1_token_output(spark, sf_dir):
    import public_tokenizers

    from heritas.llm.token_output import token_output

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op2_bpe(spark, sf_dir):
    import public_tokenizers as P

    from heritas.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, content=False)


def op3_suffix_dedup(spark, sf_dir):
    from heritas.llm.suffix_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def tracked_hosts(pages):
    """The list that op4 blocks: hosts of at least one url with a utm_source
    parameter."""
    from heritas.llm.url_filter import with_host_path

    return with_host_path(pages.where(pages["url"].contains("utm_source="))).selectExpr("host AS key").distinct()


def op4_url_filter(spark, sf_dir):
    from heritas.llm.url_filter import judge

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, tracked_hosts(pages)).select("page_id", "host", "path", "rule", "verdict")


def op5_near_dedup(spark, sf_dir):
    from heritas.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op10_decontamination(spark, sf_dir):
    from heritas.llm.decontamination import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "similarity")


def op6_toxicity(spark, sf_dir):
    from heritas.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs.where(~held_out(docs["doc_id"])).join(labels, "doc_id"))
    found = score(docs, model)
    return found.select("doc_id", held_out(found["doc_id"]).alias("held_out"), "score", (found["score"] >= 0.3).cast("int").alias("predicted"))


def op7_pii(spark, sf_dir):
    from heritas.llm.pii import digest, personal_data

    return digest(personal_data(table(spark, sf_dir, "documents")))


def op8_language_id(spark, sf_dir):
    from heritas.llm.language_id import fit, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(docs["doc_id"])))
    found = predict(docs, model)
    return found.select("doc_id", held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_media_flac(spark, sf_dir):
    from heritas.llm.flac import decode_media, encode_media

    media = stored(encode_media(table(spark, sf_dir, "documents")), "media")
    return decode_media(media)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP4_SQL = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS bare
  FROM pages),
named AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(bare, ''), '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(coalesce(bare, ''), length(regexp_extract(coalesce(bare, ''), '^([^/]*)', 1)) + 1) AS path
  FROM cut),
listed AS (SELECT DISTINCT host FROM named WHERE strpos(url, 'utm_source=') > 0),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM named)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": OP4_SQL}
