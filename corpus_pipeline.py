"""Corpus pipeline: language ID, near-duplicates, benchmark decontamination,
personal data and byte-level BPE, each by one operator of heritas.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from heritas.llm.common import drop_stored, held_out, prepare, scope, stored, table


def language_id(spark, docs, sf_dir):
    """Drop documents that are in no language (`und`: null texts and texts without
    letters).  Ambiguous ones stay, whatever their length."""
    from heritas.llm.language_id import fit, flags

    prepare(spark)
    model = fit(docs.where(~held_out(docs["doc_id"])))
    # The whole row in one column, so that no name of docs clashes.
    found = docs.select(F.struct("*").alias("row"), flags(docs, model).alias("language"))
    return found.where("language.lang_pred <> 'und'").select("row.*")


def near_dedup(spark, docs, sf_dir):
    """Keep the smallest doc_id of each group of near-duplicates (five-word
    shingles, similarity 0.8); of rows with one doc_id, all or none stay."""
    from heritas.llm.near_dedup import near_duplicates

    gone = near_duplicates(docs, size=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark, docs, sf_dir):
    """Drop documents that hold a benchmark item (all rows of equal id and text)."""
    from heritas.llm.decontamination import contaminated, keyed

    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    key = ["row_key_a__", "row_key_b__"]
    rows = keyed(docs.select("doc_id", "text", F.struct("*").alias("row")))
    return rows.join(found.select(*key).distinct(), key, "left_anti").select("row.*")


def personal_data(spark, docs, sf_dir):
    """Replace personal data by <kind>; n_chars follows the text.  Every row stays."""
    from heritas.llm.pii import masked

    out = masked(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def bpe(spark, docs, sf_dir):
    """Ids of every text, and digests of ids and of the decoded bytes."""
    import public_tokenizers as P

    from heritas.llm.bpe import encode_decode

    return encode_decode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).drop("decoded")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("bpe", bpe)]

#: Hashed n-grams, components, SimHash and BPE can't be said in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents, each written as Parquet and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scope() as keep:
            docs = stored(stage(spark, before, sf_dir), f"stage-{name}")
            keep(docs)
        drop_stored(before)
    return docs
