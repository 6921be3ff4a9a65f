"""poicraft — points-of-interest and business-directory analytics on Spark.

Column functions live in :mod:`poicraft.functions`, table operators in
:mod:`poicraft.operators`, readers/writers in :mod:`poicraft.sources` and
:mod:`poicraft.sinks`, end-to-end compositions in :mod:`poicraft.plans`.
Everything is expressed with the DataFrame API; no Python UDF is used.
"""

__version__ = "0.1.0"
