"""Evidence retrieval, checking and scoring over long documents and reported facts, as Spark plans."""
