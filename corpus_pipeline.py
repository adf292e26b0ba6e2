"""A corpus pipeline of five stages over the documents table.

Every stage takes (spark, docs, sf_dir) and judges all that the stage before kept. Rows and columns of documents stay as
they are except for what a stage decides: rows it removes, and ``text`` (with ``n_chars``, if there is one) where it
removes lines. The last stage adds ``piece_ids`` and ``round_trip``.
"""

from pyspark.sql import functions as F

from palisade.llm import decontaminate, jaccard, lines, pieces, quality
from palisade.llm.common import GAP, cleaned, ready, stored, table


def _with_text(docs, done, text: str):
    """Rows of ``done`` with the columns of ``docs``, their text replaced by the column ``text``."""
    new = {"text": F.col(text)} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return done.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def quality_rules(spark, docs, sf_dir):
    """Failing lines go, and documents that are too short, too repetitive or lose too much."""
    ready(spark)
    return _with_text(docs, quality.judged(docs).where("kept"), "clean_text")


def line_dedup(spark, docs, sf_dir):
    """Line runs that occur earlier go; documents that consist of such runs only go with them."""
    ready(spark)
    done = lines.deduplicated(docs)
    left = (F.col("n_removed") == 0) | (F.regexp_replace("kept_text", GAP, "") != "")
    changed = done.where(left).withColumn("kept_text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    return _with_text(docs, changed, "kept_text")


def near_duplicates(spark, docs, sf_dir):
    """One document of each class of near copies stays (five-word shingles, Jaccard similarity 0.8)."""
    ready(spark)
    return jaccard.representatives(docs)


def decontamination(spark, docs, sf_dir):
    """Documents with a passage of a benchmark item go."""
    ready(spark)
    found = decontaminate.matched(docs, table(spark, sf_dir, "benchmark"), spans=True)
    return found.where(F.size("matches") == 0).select(*(f"`{c}`" for c in docs.columns))


def sentence_pieces(spark, docs, sf_dir):
    """Piece ids of every text, and whether they decode to it."""
    import public_tokenizers

    ready(spark)
    return pieces.checked(docs, pieces.load_model(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination), ("sentencepiece", sentence_pieces),
]
# Edit distances, walks and pieces have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents; each result is written as Parquet and read again, scratch tables go."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with cleaned(spark):
            docs = stored(stage(spark, docs, sf_dir), name, outer=True)
    return docs
