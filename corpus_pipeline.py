"""From raw documents to packed training sequences: toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of ``documents``. ``run`` writes each stage's result to the shared folder and reads it back.

An empty table passes through. Nulls, empty texts and repeated rows are treated as the operators state:
a null text is an empty one; rows of one near-duplicate group, repeated rows among them, leave one row; a text
that stands wholly earlier in the corpus stays as an empty document.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from anontext.llm import best_fit, similar_dedup, span_dedup, toxicity
from anontext.llm.common import stored, table
from anontext.llm.queries import tokenizer

TOXIC = 0.5


def drop_toxic(spark, docs, sf_dir):
    """Score whole texts with a model fitted to the labelled documents; those at or above TOXIC go."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    return toxicity.score(docs, model, name=name).where(F.col(name) < TOXIC).drop(name)


def drop_near_duplicates(spark, docs, sf_dir):
    """Of each group linked by a Jaccard similarity of 0.8 on five words the document with the smallest id stays."""
    return similar_dedup.keep_one(docs)


def drop_repeated_spans(spark, docs, sf_dir):
    """Words covered by a passage that stands earlier go; other texts stay as they are, byte by byte."""
    others = [c for c in docs.columns if c != "text"]
    out = span_dedup.remove_repeats(docs, others, {"text": "string"})
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark, docs, sf_dir):
    """Token pieces placed in sequences of 2048."""
    return best_fit.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_spans", drop_repeated_spans),
    ("packing", pack),
]

#: SQL expresses neither the network nor the tokeniser; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
