"""Training-data operators: thirteen operators and the corpus pipeline's stages.

Nothing else in the package imports this folder; ``queries.py`` holds the
registered queries and ``__spark_entry__`` adds them when it can be imported.
"""
