"""Training-data operators.

Nothing else in the library imports this subpackage.  Every operator is a
function from DataFrames to a DataFrame; the thin ``opN_`` queries that apply
them to the standard tables are registered in :mod:`quarrylight.llm.queries`.
"""
