"""assay: evaluation analytics for language-model test runs, expressed as Spark jobs.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing is collected to the driver.  Subpackages:

* ``sources``   - readers for tables, case files, scenarios, reports, artifacts, raw payloads; sinks.
* ``functions`` - Column-level building blocks (text hygiene, hashing, money, judge parsing).
* ``operators`` - DataFrame -> DataFrame operators (evaluators, verdicts, costs, metrics, audit ...).
* ``streaming`` - the same windowed / stateful logic under Structured Streaming.
* ``plans``     - fixture views over the driver tables and the query catalog.
"""

__version__ = "0.1.0"
