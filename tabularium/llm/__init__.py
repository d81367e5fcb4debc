"""Training-data operators: near-duplicates, decontamination, scoring, packing and chat rendering."""
