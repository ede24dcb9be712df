"""Training-data operators on Spark (language-model corpora). Nothing else in the library imports this subpackage."""
