"""tessel: building, querying and evaluating a corpus of citable documents on Spark."""
