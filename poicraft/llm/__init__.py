"""Operations of a training-data pipeline as Spark jobs.

Each module holds one operator with a general interface (DataFrame in, DataFrame
out); ``queries`` applies them to the benchmark tables. Nothing else in the
library imports this subpackage.

Rules shared by all operators:

* a text that is null reads as empty, unless the docstring says otherwise;
* operators select the columns they need and return their own columns only, so
  extra columns of the input, whatever their names, never clash;
* repeated rows are kept: every input row gives one result row;
* an empty table gives an empty result with the same columns.
"""
