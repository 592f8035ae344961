"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, tokens.

Every stage takes the documents that its predecessor kept and, but for the last, returns their
columns.  ``run`` applies all stages to the table ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidgraph.llm import decontam, langid, minhash, secrets, sentencepiece_codec
from bidgraph.llm.queries import PATTERN, PIECES, RANKS
from bidgraph.llm.text_stats import small_batches
from bidgraph.plans.storage import discard, materialize
from bidgraph.plans.tables import table


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _free(name: str, docs: DataFrame) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


#: Predicted languages that stay; None keeps every language that the documents' own labels name.
LANGUAGES: tuple[str, ...] | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = LANGUAGES) -> DataFrame:
    """Keep documents whose text is clearly in an accepted language; the label isn't asked.

    Rejected are texts predicted to be in another language than ``languages``, texts whose two
    nearest codewords are too close to tell apart, and null texts or texts without a letter
    (``und``).  Texts of any length are read whole; rows that repeat are judged each; without any
    labelled row nothing can be learnt and every document is rejected.
    """
    small_batches(spark)
    model = langid.fit(docs)
    name = _free("language", docs)
    found = docs.withColumn(name, langid.identify(F.col("text"), model, spark))
    accepted = model.languages if languages is None else languages
    return found.where(F.col(f"{name}.lang_pred").isin(*accepted) & ~F.col(f"{name}.ambiguous")).select(*_own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group that shares 80 % of its five-word shingles.

    Of rows that repeat an id the first by text, then language, source and length stays, nulls
    first.  Rows without an id, and empty texts, stay.
    """
    small_batches(spark)
    judged = minhash.near_duplicates(docs, width=5, percent=80)
    dropped, mark = _free("dropped", docs), _free("doc_id_", docs)
    gone = materialize(judged.where("NOT kept").select(F.col("doc_id").alias(mark)).distinct().withColumn(dropped, F.lit(True)), "dropped")
    kept = docs.join(gone, F.col("doc_id") == F.col(mark), "left").where(F.col(dropped).isNull()).select(*_own(docs))
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(mark)).withColumn(dropped, F.lit(True))
    repeated = materialize(repeated, "repeated_ids")
    if repeated.isEmpty():
        return kept
    marked = kept.join(repeated, F.col("doc_id") == F.col(mark), "left")
    once = marked.where(F.col(dropped).isNull()).select(*_own(docs))
    # The smallest row of an id is an aggregate and not a place in a window, as one id may hold a third of all rows.
    order = F.struct(*[c for c in ("text", "lang", "source", "n_chars") if c in docs.columns])
    first = marked.where(dropped).groupBy(F.col("doc_id").alias(mark)).agg(F.min_by(F.struct(*_own(docs)), order).alias(dropped))
    return once.unionByName(first.select(f"{dropped}.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item within its edit budget.

    Null and empty texts hold none and stay; rows that repeat are judged each; texts of any length
    are searched whole.
    """
    small_batches(spark)
    name = _free("benchmark_items", docs)
    matched = decontam.match_documents(docs, table(spark, sf_dir, "benchmark"), name=name)
    return matched.where(F.size(name) == 0).select(*_own(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each secret in a text by a mark; n_chars follows the new text.

    No row goes; a null text stays null, overlapping secrets get one mark, rows that repeat are
    redacted each.
    """
    small_batches(spark)
    name = _free("redacted", docs)
    found = docs.withColumn(name, secrets.redacted(F.col("text"), RANKS, PATTERN))
    hit, text = F.col(f"{name}.n_spans") > 0, F.col(f"{name}.text")
    changed = {"text": text, "n_chars": F.when(hit, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): token ids of each document, and what they decode to.

    A null text counts as empty and has the begin and end ids alone; rows that repeat are encoded
    each; other columns are not read.
    """
    small_batches(spark)
    coded = docs.select("doc_id", sentencepiece_codec.encode_decode(F.col("text"), PIECES).alias("c")).select("doc_id", "c.*")
    digests = F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", *digests)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]
#: The stages learn a model, search by hashes and run a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = materialize(stage(spark, docs, sf_dir), name)
        if k:
            discard(spark, docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
