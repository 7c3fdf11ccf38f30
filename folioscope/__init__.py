"""folioscope: quality analytics over large documentation corpora, on Spark DataFrames."""
