"""Training-data operators (search, chat, classifiers, packing, near-duplicates,
mixing, token files, page extraction, language-model scoring, quality rules).

Nothing else in the library imports this subpackage; its queries are in
:mod:`sparkpairs.llm.queries`, their DuckDB spelling in
:mod:`sparkpairs.llm.oracle`.
"""
