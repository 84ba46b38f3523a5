"""Operators of a large-scale training-data pipeline.

Thirteen operators over the tables ``documents``, ``labels``, ``conversations``,
``embeddings`` and ``pages`` (sharding, line and document de-duplication,
fingerprints, packing, toxicity, BPE, secret scans, chat formatting, whitening,
HTML extraction, Merkle manifest).  Nothing else in the library imports this
package; ``__spark_entry__.py`` adds its queries when it is present.
"""
