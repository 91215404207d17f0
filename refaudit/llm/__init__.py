"""Training-data operators: de-duplication, sharding, language, scoring, packing, output files and mixing."""
