"""Curation of paired training sequences, expressed as Spark DataFrame plans."""
