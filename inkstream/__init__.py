"""inkstream: document search, social-graph analytics and corpus maintenance as PySpark plans."""
