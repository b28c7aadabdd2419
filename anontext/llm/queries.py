"""One query per operator over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from anontext.llm import (
    balanced_shards,
    best_fit,
    chat_rotation,
    code_vectors,
    exact_dedup,
    fingerprint_dedup,
    forest_search,
    hard_negatives,
    hmm_score,
    piece_codec,
    span_dedup,
    stable_dedup,
    toxicity,
)
from anontext.llm.common import held_out, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark, sf_dir):
    return piece_codec.piece_digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out("doc_id", 0)))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_chat_rotation(spark, sf_dir):
    return chat_rotation.rotate(table(spark, sf_dir, "conversations"))


def op4_hmm_score(spark, sf_dir):
    scored = hmm_score.score_texts(table(spark, sf_dir, "documents"), ~held_out("doc_id", 1))
    return scored.select("doc_id", (~F.col("_train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_forest_search(spark, sf_dir):
    return forest_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_fingerprint_dedup(spark, sf_dir):
    return fingerprint_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_balanced_shards(spark, sf_dir):
    return balanced_shards.balance(table(spark, sf_dir, "documents"))


def op8_span_dedup(spark, sf_dir):
    return span_dedup.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"], {
        "n_words": "long", "n_removed": "long", "kept_sha256": "string"})


def op9_stable_dedup(spark, sf_dir):
    return stable_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op10_best_fit(spark, sf_dir):
    return best_fit.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_equal_average(spark, sf_dir):
    coded = code_vectors.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", code_vectors.hex_code().alias("code"), "error", "label_error", "codebooks_sha256")


def op12_hyperplane_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_heavy_split(spark, sf_dir):
    marked = exact_dedup.mark_copies(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_toxicity": op2_toxicity,
    "op3_chat_rotation": op3_chat_rotation,
    "op4_hmm_score": op4_hmm_score,
    "op5_forest_search": op5_forest_search,
    "op6_fingerprint_dedup": op6_fingerprint_dedup,
    "op7_balanced_shards": op7_balanced_shards,
    "op8_span_dedup": op8_span_dedup,
    "op9_stable_dedup": op9_stable_dedup,
    "op10_best_fit": op10_best_fit,
    "op11_equal_average": op11_equal_average,
    "op12_hyperplane_negatives": op12_hyperplane_negatives,
    "op13_heavy_split": op13_heavy_split,
}

SQL: dict[str, str] = {
    "op3_chat_rotation": chat_rotation.SQL,
    "op8_span_dedup": span_dedup.SQL,
    "op11_equal_average": code_vectors.SQL,
    "op12_hyperplane_negatives": hard_negatives.SQL,
    "op13_heavy_split": exact_dedup.SQL,
}
