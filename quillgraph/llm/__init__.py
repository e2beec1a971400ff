"""Training-data operators: encoding, classification, packing, filtering and near-duplicate search.

Nothing outside this folder imports it (``__spark_entry__`` only adds its queries if it is there).
"""
