"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; its queries are in
``folio.llm.queries`` and their SQL in ``folio.llm.oracles``.

Conventions shared by all operators: an operator reads only the columns it
names, so further columns (also ones named like an output) never disturb it;
texts are processed whole; a null text is an empty text; an empty table gives
an empty result with the same schema.
"""
