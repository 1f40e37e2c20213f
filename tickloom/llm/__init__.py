"""Training-data operators: deduplication, packing, decontamination, scoring, quality, licences, shards, chat."""
