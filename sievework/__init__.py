"""PySpark engine for curating, auditing and evaluating large labelled corpora."""
