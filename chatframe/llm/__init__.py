"""Training-data operators: filtering, dedup, mixing, packing, media and token counts."""
