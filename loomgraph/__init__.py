"""Knowledge-graph construction over text corpora, expressed as Spark plans."""
