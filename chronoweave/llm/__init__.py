"""Training-data operators: decontamination, scoring, token output, deduplication, sharding, mixing, language ID,
nearest neighbours and personal data. Nothing else in the package imports this one."""
