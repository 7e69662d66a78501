"""Training-data operators: extraction, filtering, deduplication, decontamination and tokenisation."""
