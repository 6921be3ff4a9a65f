"""Table operators: DataFrame in, DataFrame out; compose with ``df.transform``."""
