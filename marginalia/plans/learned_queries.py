"""Queries of operators that learn from the table: entities, clusters and vectors of texts. They have no SQL; tests hold them against plain versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import entities, latent, lexicon, similarity, valence
from marginalia.sources import io

from .bindings import query


@query("a8_named_entities")
def named_entities(spark, sf_dir):
    """The ten commonest entities of each label over all documents."""
    d = io.table(spark, sf_dir, "documents")
    return entities.top(entities.tag(d, entities.fit(d, "doc_id"), "doc_id"))


#: Words of the test tables' invented languages, with strengths.
STRENGTHS = {"the": 1.5, "of": -1.2, "les": 2.0, "des": -1.5, "und": 1.0, "der": -0.8, "las": 1.1, "los": -1.4, "stupid": -3.0, "idiot": -3.0, "trash": -2.5}


@query("v6_valence")
def valence_scores(spark, sf_dir):
    """Compound score and shares of every text."""
    out = valence.valence_scores(io.table(spark, sf_dir, "documents"), "doc_id", "text", STRENGTHS)
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in valence.NAMES])


@query("a10_valence_registers")
def valence_registers(spark, sf_dir):
    """How many texts of each language have which register, by their valence."""
    d = io.table(spark, sf_dir, "documents")
    found = valence.registers(d.withColumn("kind", F.lit("online_text_entry")), "doc_id", "kind", "text", STRENGTHS)
    return found.join(d.select("doc_id", "lang"), "doc_id").groupBy("lang", "register").agg(F.count("*").alias("n"))


@query("v1_class_kmeans")
def class_kmeans(spark, sf_dir):
    """Every class of vectors in clusters of its own."""
    return similarity.class_kmeans(io.table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query("v5_text_vectors")
def text_vectors(spark, sf_dir):
    """A vector for each text of a class, from the weights of its terms."""
    weights = lexicon.term_weights(io.table(spark, sf_dir, "documents"), "doc_id", "source")
    return latent.text_vectors(weights, "doc_id", "term", "weight")[0]
