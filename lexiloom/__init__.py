"""lexiloom: a text-similarity analytics engine written as Spark plans."""
