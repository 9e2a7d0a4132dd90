"""Training-data operators: filtering, matching, packing and formatting of large text corpora."""
