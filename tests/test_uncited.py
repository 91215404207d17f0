"""Uncited entries of the registered query against all citations of the audit."""
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_orphan_references_counts_every_citation(spark):
    from __spark_entry__ import queries
    from registry import manuscript
    audit = manuscript._audit(spark, SF)
    keys = lambda df: {(r[0], r[1]) for r in df.collect()}
    used = keys(audit.citations.where("reference is not null").select("doc_id", "reference"))
    used |= keys(audit.citations.where("candidates is not null").select("doc_id", F.explode("candidates")))
    assert keys(queries()["orphan_references"](spark, SF)) == keys(audit.references.select("doc_id", "ref_id")) - used
