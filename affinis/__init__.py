"""affinis — set-based recommendation analytics on Spark.

Every public function takes DataFrames (plus plain parameters) and returns a
DataFrame.  Nothing loops over users on the driver, nothing reads a clock:
the reference time ``as_of`` is always an argument.

Sub-packages:

* ``sources``   — readers for the rating / item / interaction inputs and the
  file formats (CSV, LIBSVM, JSON), plus the sinks.
* ``functions`` — column-level helpers (keys, casts, parsing, feature vectors,
  declared item schemas).
* ``operators`` — the relational building blocks (ingest, candidates,
  similarity, popularity, models, hybrid, evaluation).
* ``plans``     — whole jobs composed from the operators and the registry of
  named queries.
* ``streaming`` — the Structured Streaming ingest and the stateful learner.
"""

from affinis.params import Params

__all__ = ["Params"]
